"""DuckDB renderings of the text functions, for oracles only.

RE2 (DuckDB) has ASCII ``\\b``/``\\w``; the oracles therefore spell the same
Unicode classes explicitly, mirroring ``skuflow.functions.text``.
"""

from __future__ import annotations

from skuflow.functions.text import PUNCTUATION, TOKEN_PATTERN, WHITESPACE_RUN

PUNCT_RE = "[" + "".join("\\" + c for c in PUNCTUATION) + "]"
NONWORD = "[^\\pL\\pN_]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_ws(e: str) -> str:
    return f"regexp_replace({e}, {lit('^' + WHITESPACE_RUN + '|' + WHITESPACE_RUN + '$')}, '', 'g')"


def collapse(e: str) -> str:
    return f"trim(regexp_replace({e}, {lit(WHITESPACE_RUN)}, ' ', 'g'))"


def clean_text(e: str) -> str:
    no_punct = f"regexp_replace(lower({e}), {lit(PUNCT_RE)}, '', 'g')"
    return f"coalesce({collapse(no_punct)}, '')"


def keep_punct(e: str) -> str:
    return f"coalesce({collapse(f'lower({e})')}, '')"


def keep_null(e: str) -> str:
    return collapse(f"lower({e})")


def replace_word(e: str, word: str, repl: str) -> str:
    """Case-insensitive whole-word replacement with Unicode word boundaries (applied twice
    so adjacent occurrences sharing a delimiter are all replaced)."""
    pat = lit(f"(^|{NONWORD}){word}({NONWORD}|$)")
    r = lit("\\1" + repl + "\\2")
    once = f"regexp_replace({e}, {pat}, {r}, 'gi')"
    return f"regexp_replace({once}, {pat}, {r}, 'gi')"


def preprocess(e: str) -> str:
    out = clean_text(e)
    for word, repl in [("capot", "capó"), ("paragolp", "paragolpes"),
                       ("cofre", "capó"), ("defensa", "paragolpes")]:
        out = replace_word(out, word, repl)
    return out


def title(e: str) -> str:
    return ("array_to_string(list_transform(regexp_extract_all(lower(" + strip_ws(e) +
            "), '\\pL+|\\PL+'), lambda p: upper(p[1]) || p[2:]), '')")


def tokens(e: str) -> str:
    return f"regexp_extract_all(lower({e}), {lit(TOKEN_PATTERN)})"


def clean_maker(e: str) -> str:
    return f"regexp_replace(replace(lower({e}), ' ', '_'), '[^\\pL\\pN_]', '', 'g')"


def token_sort(e: str) -> str:
    s = strip_ws(e)
    return (f"CASE WHEN {s} = '' THEN '' ELSE array_to_string(list_sort(regexp_split_to_array({s}, "
            f"{lit(WHITESPACE_RUN)})), ' ') END")


def lcs(a: str, b: str) -> str:
    return f"""(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE list_reduce(
    list_transform(range(1, length({a}) + 1), lambda i: substr({a}, i, 1)),
    lambda prev, ca: list_reduce(range(1, length({b}) + 1),
        lambda row, j: list_append(row, CASE WHEN ca = substr({b}, j, 1) THEN prev[j] + 1
                                        ELSE greatest(prev[j + 1], row[j]) END), [0]),
    list_transform(range(0, length({b}) + 1), lambda k: 0))[length({b}) + 1] END)"""
