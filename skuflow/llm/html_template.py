"""HTML main-text extraction by equivalence-class template deduction (operator 6).

A page is read as a stream of tokens: elements, told apart by the path of their ancestors (as a hash
of the parent's path and the name, so depth costs nothing), and the text of blocks. The reader's time
grows with the page's length only. Tokens of same-host pages whose occurrence vectors (count on each page) are
equal form an equivalence class. A vector is never built: every page adds one hash of (page,
count) to an exclusive-or per token, so equal vectors have equal sums. Classes that are frequent enough and
whose paths nest in paths of other such classes make up the host's template: its element paths,
and the block texts that stand on every page. Pages count once per distinct text of their own main
slot, and pages without one not at all, so copies and empty pages neither make nor hide a template.
What remains are the slots. The main slot is the
article element if the template has one with half of the slots' text, else the deepest container that
holds all unmarked blocks (a strict parent of blocks, so headings, lists and tables beside paragraphs
stay). A class or id that hints at a menu or sidebar is ignored on an element with most of the page's
text, unless an article beside it has text.

The second pass extracts, for each page, the blocks inside the main slot in page order, without
the host's template texts and without the parts that hold menus, headers, footers, sidebars,
notices, adverts, forms and comments. A page without the host's main slot, or of a host with too
few pages, is read by the same choice of slot made on that page alone.

Defined cases: a quote outside an attribute's value is a character like others; a tag whose end is hidden
by quotes for the rest of the page ends at the next > or <, as all tags after it; null or empty html gives an empty text; a null or unusual url counts as host "";
repeated pages are repeated rows.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuflow.llm.common import slices, staged, table

MIN_PAGES = 5               # pages that a class must occur on
MIN_SHARE = 0.5             # and their share of the host's pages
# A quoted value follows an equals sign; any other quote is a character like others.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>|<[!?][^>]*>""", re.S)
# The same for a page on which a value's quotes swallow all ends of tags.
PLAIN_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>|<[!?][^>]*>""", re.S)
OPENS = re.compile(r"</?[a-zA-Z]")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data dfn em font i img input ins del kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp template".split())
#: Elements that never hold main text.
NOT_MAIN = frozenset("nav header footer aside form head script style title textarea noscript iframe template button "
                     "select svg dialog menu object canvas video audio math".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|popup|modal|newsletter|"
    r"subscribe|sidebar|side|menu|nav\w*|breadcrumbs?|footer|header|share|sharing|social|related|comments?|disqus|"
    r"respond|replies|reply|widget|toolbar)(?:$|[\s_-])", re.I)
#: Opening one of these ends an open element of the same row.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
        "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"},
         "th": {"table", "tr"}, "option": {"select"}}
ARTICLE = re.compile(r"(?:article|main)(?:[#.].*)?")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"


def element_name(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """(name with id and class, without digits; whether it can hold main text; whether its id or class hints not)."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}
    words = f"{found.get('id', '')} {found.get('class', '')}"
    main = tag not in NOT_MAIN and found.get("role", "").lower() not in ROLES
    hint = tag not in ("html", "body", "main") and bool(HINT.search(words))
    name = tag + ("#" + found["id"] if found.get("id") else "") + (
        "." + ".".join(found["class"].split()) if found.get("class") else "")
    return re.sub(r"[0-9/]+", "", name) if "=" in attributes else name, main, hint


class Page:
    """Elements in page order, each after its parent, and blocks of text. Number 0 is the page itself."""

    def __init__(self) -> None:
        self.parent, self.path, self.depth = [0], [0], [0]      # a path is the hash of its parent's and the name
        self.article, self.main, self.hint = [False], [True], [False]
        self.blocks: list[tuple[int, str]] = []

    def open(self, parent: int, tag: str, attributes: str) -> int:
        name, main, hint = element_name(tag, attributes)
        self.parent.append(parent)
        self.path.append(child_path(self.path[parent], name))
        self.depth.append(self.depth[parent] + 1)
        self.article.append(bool(ARTICLE.fullmatch(name)))
        self.main.append(self.main[parent] and (main or tag == "header" and self.article[parent]))
        self.hint.append(hint)
        return len(self.parent) - 1

    def below(self, own: list[int]) -> list[int]:
        """Sums of ``own`` over each element and all elements in it."""
        total = list(own)
        for e in range(len(total) - 1, 0, -1):
            total[self.parent[e]] += total[e]
        return total

    def main_blocks(self) -> list[bool]:
        """Which blocks may be main text; hints of elements with most of the text do not count."""
        n = len(self.parent)
        chars, clean = [0] * n, [0] * n
        hinted = [False] * n
        for e in range(1, n):
            hinted[e] = hinted[self.parent[e]] or self.hint[e]
        for e, text in self.blocks:
            if self.main[e]:
                chars[e] += len(text)
                clean[e] += not hinted[e]
        chars, clean = self.below(chars), self.below(clean)
        articles = {self.path[e] for e in range(1, n) if self.article[e] and clean[e]}
        # A hinted element stays if it lies in every article that has text without hints.
        around, out = [0] * n, [False] * n
        for e in range(1, n):
            up = self.parent[e]
            around[e] = around[up] + (self.article[e] and self.path[e] in articles)
            out[e] = out[up] or self.hint[e] and not (2 * chars[e] > chars[0] and around[up] == len(articles))
        return [self.main[e] and not out[e] for e, _ in self.blocks]

    def slot_chars(self, ok: list[bool]) -> list[int]:
        """Main text of the blocks that each element holds as a slot: those in elements inside it, an article's own too."""
        own = [0] * len(self.parent)
        for (e, text), main in zip(self.blocks, ok):
            if main:
                own[e] += len(text)
        return [c - (0 if e == 0 or self.article[e] else own[e]) for e, c in enumerate(self.below(own))]

    def inside(self, slot: int) -> list[bool]:
        """Whether each element is one of path ``slot`` or lies in one."""
        found = [self.path[0] == slot] * len(self.parent)
        for e in range(1, len(found)):
            found[e] = found[self.parent[e]] or self.path[e] == slot
        return found


def read_page(page: str) -> Page:
    """The page's elements and blocks; time grows with the length only, however deep or broken the page is."""
    read = Page()
    tags, stack = [""], [0]                     # open elements
    places: dict[str, list[int]] = {}           # positions on the stack of each open tag
    text: list[str] = []

    def end_block() -> None:
        if text:
            words = html_lib.unescape("".join(text)).split()
            if words:
                read.blocks.append((stack[-1], " ".join(words)))
            text.clear()

    def close(k: int) -> None:
        while len(stack) > k:
            stack.pop()
            places[tags.pop()].pop()

    at, n = 0, len(page)
    last = page.rfind(">")          # no tag ends after it
    pattern = TAG
    while at < n:
        m = pattern.search(page, at) if at < last or page.find("<!--", at) >= 0 else None
        if pattern is TAG and at < last:
            first = OPENS.search(page, at, m.start() if m else n)
            if first and page.find(">", first.start()) >= 0:
                pattern = PLAIN_TAG             # a tag is open, its end within a value
                continue
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:
                continue
            if places.get(tag):
                end_block()
                close(places[tag][-1])
            elif tag == "p":
                end_block()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at) if at < last else None
            at = end.end() if end else n
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in INLINE:
            continue
        end_block()
        if tag in VOID:
            continue
        ends = ENDS.get(tag, {"p"})
        if tag in STOPS:            # the outermost element of its row, up to the list or table around it
            stop = max((places[t][-1] for t in STOPS[tag] if places.get(t)), default=0)
            rows = [places[t][bisect_right(places[t], stop)] for t in ends if places.get(t) and places[t][-1] > stop]
            if rows:
                close(min(rows))
        else:
            while tags[-1] in ends:
                close(len(stack) - 1)
        element = read.open(stack[-1], tag, m[3])
        places.setdefault(tag, []).append(len(stack))
        stack.append(element)
        tags.append(tag)
    end_block()
    return read


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def child_path(path: int, name: str) -> int:
    return signed(xxhash.xxh3_64_intdigest(f"{path}/{name}"))


def text_token(path: int, text: str) -> int:
    return signed(xxhash.xxh3_64_intdigest(f"{path}\n{text}"))


TOKENS = ("host string, content bigint, page bigint, "
          "tokens array<struct<token:bigint,parent:bigint,depth:int,article:boolean,count:bigint,chars:bigint>>")
TOKEN_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct(
    [("token", pa.int64()), ("parent", pa.int64()), ("depth", pa.int32()), ("article", pa.bool_()), ("count", pa.int64()),
     ("chars", pa.int64())]))]


def page_tokens(page: str) -> tuple[int, int, list[dict]] | None:
    """(hash of the main text, hash of all blocks and paths, tokens) of a page, none without main text.

    A token is a path with its parent's, or a text, whose parent is null; depth 0 is the page itself. It has a count and
    the characters of possible main text that its elements hold.
    """
    read = read_page(page)
    ok = read.main_blocks()
    chars = read.slot_chars(ok)
    slot = main_slot(read, ok, chars)
    if slot is None:
        return None
    found: dict[int, list] = {}
    for e, path in enumerate(read.path):
        t = found.setdefault(path, [read.path[read.parent[e]], read.depth[e], read.article[e], 0, 0])
        t[3] += 1
        t[4] += chars[e] if e else 0
    for e, text in read.blocks:
        found.setdefault(text_token(read.path[e], text), [None, None, False, 0, 0])[3] += 1
    within = read.inside(slot)
    main = "\n".join(t for (e, t), may in zip(read.blocks, ok) if may and within[e])
    whole = repr((read.path, [(read.path[e], may, t) for (e, t), may in zip(read.blocks, ok)]))
    return text_token(0, main), text_token(0, whole), [
        {"token": t, "parent": up, "depth": d, "article": art, "count": n, "chars": c}
        for t, (up, d, art, n, c) in found.items()]


def deduce(pages: DataFrame, html: str = "html", url: str = "url", min_pages: int = MIN_PAGES,
           min_share: float = MIN_SHARE) -> DataFrame:
    """One row per host with a template: host, main (path of the main slot), texts (their tokens)."""
    src = pages.select(host(F.col(url)).alias("host"), F.col(html).cast("binary").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in slices([len(b or b"") for b in bodies], 4 << 20):
                rows: dict[tuple, tuple] = {}       # of the pages of a content, the one with the least hash
                for h, b in zip(hosts[lo:hi], bodies[lo:hi]):
                    made = page_tokens((b or b"").decode())
                    if made and ((h, made[0]) not in rows or made[1] < rows[h, made[0]][2]):
                        rows[h, made[0]] = (h, *made)
                cols = [*zip(*rows.values())] or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, TOKEN_TYPES)],
                                                 names=["host", "content", "page", "tokens"])

    distinct = src.mapInArrow(run, TOKENS).groupBy("host", "content").agg(F.min_by("tokens", "page").alias("tokens"))
    tokens = (distinct.select("host", "content", F.inline("tokens")).groupBy("host", "token", "parent", "depth", "article")
              .agg(F.count("*").alias("pages"), F.sum("count").alias("total"),
                   F.bit_xor(F.xxhash64("content", "count")).alias("vector"), F.sum("chars").alias("chars")))
    tokens = staged(tokens.where(F.col("pages") >= min_pages), "page-tokens")
    size = tokens.where("depth = 0").select("host", F.col("pages").alias("n"))
    frequent = tokens.where("depth IS NULL OR depth > 0").join(size, "host").where(
        (F.col("pages") >= min_share * F.col("n")) & (F.col("depth").isNotNull() | (F.col("pages") == F.col("n"))))
    # A class: the tokens of a host with one occurrence vector.
    classes = frequent.groupBy("host", "vector", "pages", "total").agg(F.collect_list(
        F.struct("parent", "depth", "article", "token", "chars")).alias("members"))
    template = classes.groupBy("host").agg(F.flatten(F.collect_list("members")).alias("m"))
    paths = F.filter("m", lambda x: x["depth"].isNotNull())
    names = F.map_from_entries(F.transform(F.array_distinct(F.transform("paths", lambda x: x["token"])),
                                           lambda x: F.struct(x, F.lit(True))))
    nested = F.filter("paths", lambda x: (x["depth"] == 1) | F.map_contains_key("names", x["parent"]))
    most = F.array_max(F.transform("nested", lambda x: x["chars"]))
    main = F.array_max(F.transform(
        F.filter("nested", lambda x: (x["chars"] > 0) & ((x["chars"] == F.col("most")) | (
            x["article"] & (x["chars"] * 2 >= F.col("most"))))),
        lambda x: F.struct(x["article"].alias("article"), F.when(x["article"], -x["depth"]).otherwise(x["depth"]).alias("depth"),
                           x["token"].alias("path"))))
    texts = F.transform(F.filter("m", lambda x: x["depth"].isNull()), lambda x: x["token"])
    return (template.withColumn("paths", paths).withColumn("names", names).withColumn("nested", nested)
            .withColumn("most", most).select("host", main["path"].alias("main"), texts.alias("texts")))


def host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def main_slot(read: Page, ok: list[bool], chars: list[int]) -> int | None:
    """The path of the main slot by a choice made on one page alone; 0 is the page itself."""
    if not any(ok):
        return None
    total: dict[int, int] = {}
    for path, c in zip(read.path, chars):
        total[path] = total.get(path, 0) + c
    most = max(total.values())
    articles, others = [], []
    for e, path in enumerate(read.path):
        if 2 * total[path] >= most and read.article[e]:
            articles.append((read.depth[e], path))
        if total[path] == most:
            others.append((read.depth[e], path))
    return min(articles)[1] if articles else max(others)[1]


def main_text(page: str, main: int | None, texts: frozenset[int]) -> str:
    read = read_page(page)
    ok = read.main_blocks()
    within = read.inside(main) if main is not None else []
    if main is None or not any(may and within[e] for (e, _), may in zip(read.blocks, ok)):
        main = main_slot(read, ok, read.slot_chars(ok))
        if main is None:
            return ""
        within = read.inside(main)
    slot = [(t, not (texts and text_token(read.path[e], t) in texts))
            for (e, t), may in zip(read.blocks, ok) if may and within[e]]
    # Pages that share most of their main text are versions of one page, not fillings of a template.
    whole = sum(len(t) for t, own in slot if own) * 2 < sum(len(t) for t, _ in slot)
    return "\n".join(t for t, own in slot if own or whole)


def extract(pages: DataFrame, html: str = "html", url: str = "url", min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` without the html, plus text and n_chars (code points of the text)."""
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    templates = staged(deduce(pages, html, url, min_pages), "page-templates")
    # The planner broadcasts the written templates if they are small, else joins by host.
    src = pages.select(*kept, F.col(html).cast("binary").alias("__llm_html"), host(F.col(url)).alias("__llm_host"))
    src = src.join(templates.withColumnsRenamed(
        {"host": "__llm_host", "main": "__llm_main", "texts": "__llm_texts"}), "__llm_host", "left").select(
        *kept, "__llm_html", "__llm_main", "__llm_texts")
    schema = T.StructType([src.schema[c] for c in kept] + [
        T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[tuple, frozenset] = {}
        for batch in batches:
            bodies, mains, texts = (batch.column(batch.num_columns - k).to_pylist() for k in (3, 2, 1))
            out = []
            for b, m, t in zip(bodies, mains, texts):
                key = tuple(t or ())
                if len(sets) > 4096:
                    sets.clear()
                out.append(main_text((b or b"").decode(), m, sets.setdefault(key, frozenset(key))))
            cols = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                names=[*kept, "text", "n_chars"])

    return src.mapInArrow(run, schema)


def op6_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op6_html_template": op6_html_template}
ORACLES: dict[str, str] = {}
