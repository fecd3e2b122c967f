"""Chat formatting by schema fingerprinting (operator 4); DataFrame functions only.

Conversations arrive as JSON records of different layouts. Each record is read once as a variant;
the nested field paths that it has, out of all paths that some layout names, are joined and
hashed: this fingerprint selects the layout whose declared paths hash alike, and the layout's
mapping turns the record into canonical turns (role, text). Records that are structs already are not
written as JSON: their schema's paths are hashed alike and the same mapping reads their fields.

The template writes a turn as ``### role: text</turn>`` and a line feed. Inside roles and texts a
backslash is doubled and one is put into every control string, so none of the template's own
marks can stand in a text; dropping one backslash before any character gives the text back. The
loss mask is a list of spans (start, chars) in code points of the output that cover exactly the
assistants' escaped texts.

Defined cases: a null or missing text or role is empty; turns of rows are ordered by turn (null
first), then role, then text; a record whose fingerprint no layout has gets layout null and no
turns; repeated turns stay. JSON that is malformed gets no layout; a JSON record of LONG bytes or more,
which the variant's limits may refuse (20 million characters a string, 128 MiB a record), raises if
it cannot be read, so that no long conversation is lost silently.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuflow.llm.common import table

TURN = "struct<role:string,text:string>"
END = "</turn>\n"
LONG = 20_000_000
#: Names that other layouts use for the canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """A declared layout: its nested field paths, and how each turn is found."""

    name: str
    paths: tuple[str, ...]
    #: Either (array field, role field, text field) or ((role, path), ...) for single turns.
    items: tuple[str, str, str] | None = None
    singles: tuple[tuple[str, str], ...] = ()
    rename: bool = True


def listed(name: str, field: str, role: str, text: str, extra: tuple[str, ...] = (), rename: bool = True) -> Layout:
    return Layout(name, (field, f"{field}[0].{role}", f"{field}[0].{text}", *extra), (field, role, text), (), rename)


def single(name: str, *turns: tuple[str, str]) -> Layout:
    return Layout(name, tuple(p for _, p in turns), None, turns)


LAYOUTS = (
    listed("turns", "turns", "role", "text", rename=False),
    listed("messages", "messages", "role", "content"),
    listed("from_value", "conversations", "from", "value"),
    Layout("system_messages", ("system", "messages", "messages[0].role", "messages[0].content"),
           ("messages", "role", "content"), (("system", "system"),)),
    single("prompt_completion", ("user", "prompt"), ("assistant", "completion")),
    single("prompt_response", ("user", "prompt"), ("assistant", "response")),
    single("system_prompt_response", ("system", "system"), ("user", "prompt"), ("assistant", "response")),
    single("question_answer", ("user", "question"), ("assistant", "answer")),
    single("instruction", ("user", "instruction"), ("assistant", "output")),
    single("instruction_input", ("user", "instruction"), ("user", "input"), ("assistant", "output")),
    single("chosen", ("user", "prompt"), ("assistant", "chosen")),
)


def path_hash(paths: Column) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(paths), "\n"))


def fingerprint(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of the record's nested field paths, out of those that a layout names."""
    known = sorted({p for x in layouts for p in x.paths})
    there = [F.when(F.try_variant_get(record, f"$.{p}", "variant").isNotNull(), F.lit(p)) for p in known]
    return path_hash(F.array_compact(F.array(*there)))


def schema_paths(schema: T.StructType, above: str = "") -> list[str]:
    """The nested field paths of a typed record, as a variant of it has them."""
    found = []
    for f in schema.fields:
        found.append(above + f.name)
        inner, path = f.dataType, above + f.name
        if isinstance(inner, T.ArrayType):
            inner, path = inner.elementType, path + "[0]"
        if isinstance(inner, T.StructType):
            found += schema_paths(inner, path + ".")
    return found


def variant_field(record: Column) -> Callable[[str, str], Column]:
    return lambda path, kind: F.try_variant_get(record, f"$.{path}", kind)


def struct_field(record: Column) -> Callable[[str, str], Column]:
    return lambda path, kind: record[path].cast(kind)


def turns_of(get: Callable[[str, str], Column], layout: Layout) -> Column:
    """The mapping of one layout: array of (role, text); ``get`` reads a field as a type."""
    def renamed(role: Column) -> Column:
        if not layout.rename:
            return role
        table = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
        return F.coalesce(F.try_element_at(table, F.lower(role)), role)

    def turn(role: Column, text: Column) -> Column:
        return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    parts = []
    if layout.singles:
        parts.append(F.array(*[turn(F.lit(role), get(path, "string"))
                               for role, path in layout.singles]))
    if layout.items:
        field, role, text = layout.items
        rows = get(field, f"array<struct<`{role}`:string,`{text}`:string>>")
        parts.append(F.transform(rows, lambda x: turn(renamed(x[role]), x[text])))
    return F.concat(*parts)


def canonical(df: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``df`` plus fingerprint, layout and turns from records: JSON (malformed: no layout) or structs."""
    empty = F.array().cast(f"array<{TURN}>")
    if isinstance(df.schema[record].dataType, T.StructType):
        known = {p for x in layouts for p in x.paths}
        paths = {p for p in schema_paths(df.schema[record].dataType) if p in known}
        x = next((x for x in layouts if set(x.paths) == paths), None)
        turns = turns_of(struct_field(F.col(record)), x) if x else F.lit(None)
        return df.withColumns({"fingerprint": path_hash(F.array(*map(F.lit, sorted(paths)))),
                               "layout": F.lit(x.name if x else None).cast("string"),
                               "turns": F.coalesce(turns, empty)})
    parsed = df.withColumn("__llm_record", F.when(F.octet_length(record) >= LONG, F.parse_json(record)).otherwise(
        F.try_parse_json(record)))
    parsed = parsed.withColumn("fingerprint", fingerprint(F.col("__llm_record"), layouts))
    layout = turns = None
    for x in layouts:
        hit = F.col("fingerprint") == path_hash(F.array(*map(F.lit, x.paths)))
        made = turns_of(variant_field(F.col("__llm_record")), x)
        layout = F.when(hit, x.name) if layout is None else layout.when(hit, x.name)
        turns = F.when(hit, made) if turns is None else turns.when(hit, made)
    return parsed.withColumn("layout", layout).withColumn("turns", F.coalesce(turns, empty)).drop("__llm_record")


def escape_text(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.replace(out, F.lit("### "), F.lit("#\\## "))


def escape_role(role: Column) -> Column:
    return F.replace(escape_text(role), F.lit(": "), F.lit(":\\ "))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(df: DataFrame, turns: str = "turns", trained: str = "assistant") -> DataFrame:
    """``df`` plus formatted and loss_spans: array of (start, chars) in code points."""
    def head(t: Column) -> Column:
        return F.concat(F.lit("### "), escape_role(t["role"]), F.lit(": "))

    parts = F.transform(turns, lambda t: F.struct(
        head(t).alias("head"), escape_text(t["text"]).alias("body"), (t["role"] == trained).alias("loss")))
    start = F.struct(F.lit(0).cast("long").alias("at"),
                     F.array().cast("array<struct<start:bigint,chars:bigint>>").alias("spans"))

    def add(acc: Column, p: Column) -> Column:
        body_at = acc["at"] + F.length(p["head"])
        chars = F.length(p["body"]).cast("long")
        return F.struct((body_at + chars + len(END)).alias("at"), F.when(p["loss"], F.concat(
            acc["spans"], F.array(F.struct(body_at.alias("start"), chars.alias("chars"))))).otherwise(
            acc["spans"]).alias("spans"))

    return (df.withColumn("__llm_parts", parts)
            .withColumn("formatted", F.array_join(F.transform("__llm_parts", lambda p: F.concat(
                p["head"], p["body"], F.lit(END))), ""))
            .withColumn("loss_spans", F.aggregate("__llm_parts", start, add, lambda acc: acc["spans"]))
            .drop("__llm_parts"))


def read_turns(formatted: Column) -> Column:
    """The turns read back from formatted text."""
    rows = F.split(formatted, END)
    rows = F.slice(rows, 1, F.size(rows) - 1)

    def turn(row: Column) -> Column:
        at = F.instr(row, ": ")
        return F.struct(unescape(F.substring(row, F.lit(5), at - 5)).alias("role"),
                        unescape(F.substring(row, at + 2, F.length(row))).alias("text"))
    return F.transform(rows, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """Texts under the loss mask, unescaped, in order."""
    return F.transform(spans, lambda s: unescape(F.substring(
        formatted, (s["start"] + 1).cast("int"), s["chars"].cast("int"))))


def records_of_rows(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """One struct of layout ``turns`` per conversation of a (key, turn, role, text) table."""
    item = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("t"))
    turns = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return grouped.select(key, F.struct(turns.alias("turns")).alias("record"))


def op4_chat_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    made = format_turns(canonical(records_of_rows(rows.unionByName(extra))))
    read = made.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("t"),
                       F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    return read.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""),
               256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


QUERIES: dict[str, Callable] = {"op4_chat_fingerprint": op4_chat_fingerprint}
ORACLES = {"op4_chat_fingerprint": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## ') AS t,
    replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## '), ': ', ':\ ') AS r
  FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(r) + length(t) + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""}
