"""Golden cases for the scalar functions (FIXTURES.md §2) and their properties."""

from pyspark.sql import functions as F

from skuflow.functions import text as tx
from skuflow.functions.logs import is_error_line, line_timestamp
from skuflow.operators import ranking as rk


def _one(spark, expr, values, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def test_preprocess_golden(spark):
    cases = {
        "Capot para Coche XY": "capó para coche xy",
        " Paragolp delantero": "paragolpes delantero",
        "  Cofre con golpe   ": "capó con golpe",
        "Defensa trasera": "paragolpes trasera",
        "Faro Izquierdo Roto": "faro izquierdo roto",
        None: "",
        "capoté": "capoté",
        "Faro, (izq.)  Del.": "faro izq del",
    }
    got = _one(spark, tx.preprocess_text, list(cases))
    assert got == list(cases.values())


def test_clean_text_idempotent_and_unicode_whitespace(spark):
    vals = ["a  b\tc\n", "  X--Y  ", "", None]
    once = _one(spark, tx.clean_text, vals)
    twice = _one(spark, tx.clean_text, once)
    assert once == twice == ["a b c", "xy", "", ""]


def test_keep_null_and_keep_punct(spark):
    assert _one(spark, tx.clean_text_keep_null, [None, "  A  b. "]) == [None, "a b."]
    assert _one(spark, tx.normalize_keep_punctuation, [None, " A,　B "]) == ["", "a, b"]


def test_maker_key_and_title_case(spark):
    assert _one(spark, tx.clean_maker_name, ["Mercedes Benz", "Citroën", "B.M.W."]) == \
        ["mercedes_benz", "citroën", "bmw"]
    assert _one(spark, tx.title_case, ["mazda bt-50 x-line", "  renault LOGAN "]) == \
        ["Mazda Bt-50 X-Line", "Renault Logan"]


def test_tokens_and_bigrams(spark):
    df = spark.createDataFrame([("El Capó-del a b FARO2 x_y",)], "t string")
    toks = df.select(tx.tokenize("t").alias("tk"))
    assert toks.first()["tk"] == ["el", "capó", "del", "faro2", "x_y"]
    out = toks.select(tx.with_bigrams("tk").alias("g")).first()["g"]
    assert out == ["el", "capó", "del", "faro2", "x_y", "el capó", "capó del", "del faro2", "faro2 x_y"]
    one = spark.createDataFrame([(["solo"],), ([],)], "tk array<string>")
    assert [r[0] for r in one.select(tx.with_bigrams("tk")).collect()] == [["solo"], []]


def test_strip_accents(spark):
    assert _one(spark, tx.strip_accents, ["Señor Ñandú ÉCOLE façade ß"]) == ["Senor Nandu ECOLE facade ß"]


def test_invalid_dictionary_pattern_is_skipped(spark):
    pairs = [("(unclosed", "x"), (r"\bfoo\b", "bar"), (r"(\d+)cm", r"\1 cm")]
    got = _one(spark, lambda c: tx.apply_regex_dictionary(c, pairs), ["FOO 10cm"])
    assert got == ["bar 10 cm"]


def test_confidence_bands(spark):
    df = spark.createDataFrame([(0.70,), (0.69,), (0.40,), (0.39,)], "top_confidence double")
    assert [r[0] for r in df.select(rk.confidence_band()).collect()] == ["high", "medium", "medium", "low"]


def test_log_lines(spark):
    df = spark.createDataFrame([("2024-01-05 10:00:00 - app - INFO - No errors found in logs",),
                                ("2024-01-05 10:00:01 - app - INFO - started",),
                                ("Traceback (most recent call last):",)], "line string")
    rows = df.select(is_error_line("line").alias("e"), line_timestamp("line").alias("ts")).collect()
    assert [r["e"] for r in rows] == [True, False, True]
    assert rows[2]["ts"] is None and rows[0]["ts"] is not None


def test_strip_accents_covers_all_decomposable_letters(spark):
    import unicodedata
    texts = ["Ťřín Šťávy ąęş Ő ű", "ế ǘ ḗ Ά ё й", "e\u0301 n\u0303 plain", "Å \u212b", "日本 한국 Ø ß", ""]
    want = [unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)))
            for t in texts]
    assert _one(spark, tx.strip_accents, texts) == want
