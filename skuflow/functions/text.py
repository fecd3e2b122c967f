"""Text normalisation as native column expressions.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so it
runs inside whole-stage codegen; no Python UDF is involved. Character classes
are written out explicitly so that Java's regex engine gives the same result
as Python's ``str``/``re`` semantics the reference relies on.
"""

from __future__ import annotations

import re
import unicodedata
import warnings
from collections.abc import Iterable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results)
# ---------------------------------------------------------------------------
# ASCII punctuation removed by clean_text, in its natural order.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Default spelling corrections, applied in this order, case-insensitively.
SPELLING_CORRECTIONS: list[tuple[str, str]] = [
    (r"\bcapot\b", "capó"),
    (r"\bparagolp\b", "paragolpes"),
]

# Default term standardisation, applied in this order, case-insensitively.
TERM_STANDARDIZATION: list[tuple[str, str]] = [
    (r"\bcofre\b", "capó"),
    (r"\bdefensa\b", "paragolpes"),
]

# Whitespace as Python's ``str`` methods and ``re`` ``\s`` define it.
WHITESPACE_CLASS = ("[\\t\\n\\x0b\\f\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
                    "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]")
WHITESPACE_RUN = WHITESPACE_CLASS + "+"
# Python's Unicode word character: letters, digits/numerics and underscore.
WORD_CLASS = "[\\p{L}\\p{N}_]"
# The vectoriser's default token: a maximal run of two or more word characters
# (equivalent to ``\b\w\w+\b``).
TOKEN_PATTERN = WORD_CLASS + "{2,}"

def _accents() -> tuple[str, str]:
    """(letters, bases): every letter of the basic plane that is canonically one base and combining marks
    (Spark has no normalisation function), then the marks themselves, which have no base and go."""
    plane = [chr(c) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000]
    parts = {c: unicodedata.normalize("NFD", c) for c in plane}
    folded = {c: d[0] for c, d in parts.items()
              if d != c and not unicodedata.combining(d[0]) and all(unicodedata.combining(x) for x in d[1:])}
    marks = [c for c in plane if unicodedata.combining(c)]
    return "".join(folded) + "".join(marks), "".join(folded.values())


_ACCENTED, _FOLDED = _accents()


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def collapse_whitespace(col) -> Column:
    """Runs of whitespace become one space; leading/trailing removed (``' '.join(s.split())``)."""
    return F.trim(F.regexp_replace(_c(col), WHITESPACE_RUN, " "))


def py_strip(col) -> Column:
    """Python ``str.strip()``: removes all leading/trailing whitespace, not just spaces."""
    return F.regexp_replace(_c(col), f"^{WHITESPACE_RUN}|{WHITESPACE_RUN}$", "")


def clean_text(col) -> Column:
    """lower -> delete ASCII punctuation -> collapse whitespace; null -> ''."""
    lowered = F.lower(_c(col))
    no_punct = F.translate(lowered, PUNCTUATION, "")
    return F.coalesce(collapse_whitespace(no_punct), F.lit(""))


def normalize_keep_punctuation(col) -> Column:
    """lower + collapse whitespace, punctuation kept; null -> ''."""
    return F.coalesce(collapse_whitespace(F.lower(_c(col))), F.lit(""))


def clean_text_keep_null(col) -> Column:
    """lower, strip, collapse whitespace; null stays null."""
    return collapse_whitespace(F.lower(_c(col)))


def python_regex_to_java(pattern: str) -> str:
    """A Python regex as a Java pattern that matches the same text.

    ``(?iU)`` gives Python 3's case-insensitive Unicode matching (``\\b``, ``\\w`` over all
    letters); named groups and back-references are renamed, comments dropped. A pattern that Python
    or the JVM's own compiler refuses raises ``re.error`` here, once, on the driver.
    """
    re.compile(pattern)
    java = re.sub(r"\(\?P<([A-Za-z0-9]+)>", r"(?<\1>", pattern)
    java = re.sub(r"\(\?P=([A-Za-z0-9]+)\)", r"\\k<\1>", java)
    java = "(?iU)" + re.sub(r"(?<!\\)\(\?#[^)]*\)", "", java)
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            spark._jvm.java.util.regex.Pattern.compile(java)
        except Py4JJavaError as e:
            raise re.error(f"not a Java pattern: {pattern}") from e
    return java


def python_replacement_to_java(repl: str) -> str:
    """Python ``re.sub`` replacement text -> Java ``Matcher`` replacement text."""
    out = repl.replace("$", "\\$")
    out = re.sub(r"\\g<(\d+)>", r"$\1", out)
    out = re.sub(r"\\(\d+)", r"$\1", out)
    return out


def apply_regex_dictionary(col, pairs: Iterable[Sequence[str]]) -> Column:
    """fold ``regexp_replace`` over ordered (pattern, replacement) pairs.

    A pattern that does not compile is skipped with a warning.
    """
    out = _c(col)
    for pattern, repl in pairs:
        try:
            java_pattern = python_regex_to_java(pattern)
        except re.error as e:
            warnings.warn(f"skipped dictionary pattern {pattern!r}: {e}", stacklevel=2)
            continue
        out = F.regexp_replace(out, java_pattern, python_replacement_to_java(repl))
    return out


def correct_spelling(col, corrections=None) -> Column:
    """F5 with the default dictionary unless one is given."""
    return apply_regex_dictionary(col, SPELLING_CORRECTIONS if corrections is None else corrections)


def standardize_terms(col, standardization=None) -> Column:
    """F6 with the default dictionary unless one is given."""
    return apply_regex_dictionary(col, TERM_STANDARDIZATION if standardization is None
                                  else standardization)


def preprocess_text(col, corrections=None, standardization=None) -> Column:
    """clean_text -> spelling corrections -> term standardisation (order matters)."""
    return standardize_terms(correct_spelling(clean_text(col), corrections), standardization)


def training_context(maker, processed) -> Column:
    """F8: ``maker + ' ' + processed`` (null maker gives null, as string concat does)."""
    return F.concat(_c(maker), F.lit(" "), _c(processed))


def serving_context(description, maker=None, model_family=None, series=None,
                    model_year=None) -> Column:
    """``UPPER(maker) description maker family series year``, trimmed.

    Mirrors the two-step serving path: the form fields are joined and stripped,
    then the upper-cased maker is prepended when present.
    """
    def txt(c):
        return F.lit("") if c is None else F.coalesce(_c(c).cast("string"), F.lit(""))

    joined = py_strip(F.concat_ws(" ", txt(description), txt(maker), txt(model_family),
                                  txt(series), txt(model_year)))
    if maker is None:
        return joined
    m = _c(maker)
    return F.when(m.isNotNull() & (m != ""), F.concat(F.upper(m), F.lit(" "), joined)
                  ).otherwise(joined)


def clean_maker_name(col) -> Column:
    """lower, space -> '_', keep letters, digits and '_' (file-name key)."""
    return F.regexp_replace(F.replace(F.lower(_c(col)), F.lit(" "), F.lit("_")),
                            "[^\\p{L}\\p{N}_]", "")


def title_case(col) -> Column:
    """Python ``str.title()`` after ``strip()``.

    ``title()`` upper-cases the first letter of every run of letters (so
    ``bt-50 x-line`` -> ``Bt-50 X-Line``), which ``initcap`` does not do. The
    string is split into letter runs and non-letter runs and each run is
    ``initcap``-ed (a no-op on non-letter runs).
    """
    parts = F.regexp_extract_all(F.lower(py_strip(col)), F.lit("\\p{L}+|\\P{L}+"), 0)
    return F.array_join(F.transform(parts, lambda p: F.initcap(p)), "")


def strip_accents(col) -> Column:
    """letters without their accents, whether precomposed or followed by combining marks."""
    return F.translate(_c(col), _ACCENTED, _FOLDED)


def tokenize(col) -> Column:
    """F16: lower-cased tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(TOKEN_PATTERN), 0)


def with_bigrams(tokens) -> Column:
    """unigrams followed by adjacent bigrams (``ngram_range=(1, 2)``).

    Pass a column *reference* (materialise the tokens first): the array is
    sliced twice and zipped, one pass per row.
    """
    t = _c(tokens)
    n = F.size(t)
    bigrams = F.zip_with(F.slice(t, 1, n - 1), F.slice(t, 2, n - 1),
                         lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(n >= 2, F.concat(t, bigrams)).otherwise(t)


def truthy(col) -> Column:
    """Python truthiness of a text field: not null and not ''."""
    c = _c(col)
    return c.isNotNull() & (c != "")


def text_or_empty(col) -> Column:
    """``fillna('')`` + cast to string."""
    return F.coalesce(_c(col).cast("string"), F.lit(""))
