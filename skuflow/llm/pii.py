"""Personal data by anchor expansion (operator 8).

One Aho-Corasick automaton finds the anchors of a text in a single scan: at-signs, plus signs,
digits, URL schemes and identifier cues. From each anchor a deterministic local parser expands
to the left and right, finds the boundaries of the value and validates it. Parsers read the text
once: each kind remembers where its last match ended, so matches of a kind never overlap.

Base kinds: email, ip (parts at most 255), card (12 to 19 digits passing Luhn), phone (9 to 15
digits after a plus sign). Added kinds: login (a URL whose authority holds user:password@), iban
(after an IBAN cue, valid modulo 97), account (an identifier of at least six digits right
after an account, SSN or passport cue) and secret (a value assigned to a token, key, secret or password
cue or following Bearer: letters and digits of at least ``SECRET_BITS`` bits a character, of 16
characters or more, 8 after a password cue).

Defined cases: a null text is empty and has no spans; spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from skuflow.llm.common import table, with_text_columns

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "account", "secret")
RANK = {k: i for i, k in enumerate(KINDS)}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
DIAL = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOGIN = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+@(?:\[[0-9A-Fa-f:.]+\]|[A-Za-z0-9.-]+)(?::[0-9]+)?")
IBAN = re.compile(r"[\s:#.]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
IDENTIFIER = re.compile(
    r"(?: ?(?:number|no\.?|id|#))?[\s:#=]{1,3}([A-Z0-9](?:[A-Z0-9-]{4,32})[A-Z0-9])(?![A-Za-z0-9])")
SCHEMES = ("http://", "https://", "ftp://", "postgres://", "mysql://", "mongodb://", "redis://", "ssh://")
SECRET = re.compile(r"""["']?\s{0,3}(?:[:=]|=>|:=)\s{0,3}["'`]?([A-Za-z0-9_+/.~-]{8,}={0,2})""")
BEARER = re.compile(r"\s{1,3}([A-Za-z0-9_+/.~-]{16,}={0,2})")
SECRET_CUES = ("token", "secret", "api_key", "api-key", "apikey", "access_key", "access-key", "private_key", "secret_key",
               "password", "passwd", "pwd", "bearer")
SHORT_CUES = ("password", "passwd", "pwd")
SECRET_BITS = 2.5
IDENTIFIER_CUES = ("account", "acct", "ssn", "passport")


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    out.add_word("@", "@")
    out.add_word("+", "+")
    for d in "0123456789":
        out.add_word(d, "0")
    for s in SCHEMES:
        out.add_word(s, "://")
    for cue in ("IBAN", "iban", "Iban"):
        out.add_word(cue, "iban")
    for cue in IDENTIFIER_CUES:
        for form in (cue, cue.upper(), cue.capitalize()):
            out.add_word(form, "account")
    for cue in SECRET_CUES:
        kind = "bearer" if cue == "bearer" else "password" if cue in SHORT_CUES else "secret"
        for form in (cue, cue.upper(), cue.capitalize()):
            out.add_word(form, kind)
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def iban_valid(value: str) -> bool:
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def secret_like(value: str, least: int) -> bool:
    """Whether a value is random enough: letters and digits, and its own characters' entropy."""
    if len(value) < least or not any(c.isdigit() for c in value) or not any(c.isalpha() for c in value):
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= SECRET_BITS


def spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """All (start, end, kind) of ``text``, by start, then kind."""
    out = []
    email = quad = card = phone = 0     # where the last match of a kind ended
    for at, kind in anchors.iter(text):
        if kind == "0":
            if at >= card:
                m = DIGITS.match(text, at)
                if m:
                    card = m.end()
                    number = m.group().replace(" ", "").replace("-", "")
                    if 12 <= len(number) <= 19 and luhn(number):
                        out.append((at, card, "card"))
                else:
                    card = at + 1
            if at >= quad:
                m = QUAD.match(text, at)
                if m:
                    quad = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                        out.append((at, quad, "ip"))
                else:   # no other start in this run of digits can match either
                    quad = at + 1
                    while quad < len(text) and text[quad] in "0123456789":
                        quad += 1
        elif kind == "@":
            start = at
            while start > email and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email = m.end()
                out.append((start, email, "email"))
        elif kind == "+":
            if at >= phone and (m := DIAL.match(text, at)):
                phone = m.end()
                if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    out.append((at, phone, "phone"))
        elif kind == "://":
            if m := LOGIN.match(text, at + 1):
                start = at - 2
                while start > 0 and text[start - 1].isascii() and text[start - 1].isalpha():
                    start -= 1
                out.append((start, m.end(), "login"))
        elif kind == "iban":
            if (m := IBAN.match(text, at + 1)) and iban_valid(m.group(1)):
                out.append((m.start(1), m.end(1), "iban"))
        elif kind in ("secret", "password", "bearer"):
            m = (BEARER if kind == "bearer" else SECRET).match(text, at + 1)
            if m:
                value = m.group(1).rstrip(".-")
                if secret_like(value, 8 if kind == "password" else 16):
                    out.append((m.start(1), m.start(1) + len(value), "secret"))
        elif (m := IDENTIFIER.match(text, at + 1)) and sum(c.isdigit() for c in m.group(1)) >= 6:
            out.append((m.start(1), m.end(1), "account"))
    return sorted(set(out), key=lambda s: (s[0], RANK[s[2]], s[1]))


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus ``pii`` array<struct<start, end, kind>>, sorted by start, then kind."""
    item = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                         T.StructField("kind", T.StringType())])

    def make():
        anchors = automaton()
        return lambda texts: [[[dict(zip(("start", "end", "kind"), s)) for s in spans((t or b"").decode(), anchors)]
                               for t in texts]]

    return with_text_columns(df, text, [T.StructField("pii", T.ArrayType(item))], make)


def digests(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without the text, plus counts of the base kinds, their digest, and all spans as text."""
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in BASE]
    fields += [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]

    def make():
        anchors = automaton()

        def run(texts):
            out: list[list] = [[] for _ in fields]
            for t in texts:
                found = spans((t or b"").decode(), anchors)
                base = [s for s in found if s[2] in BASE]
                for i, k in enumerate(BASE):
                    out[i].append(sum(s[2] == k for s in base))
                joined = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
                out[-2].append(hashlib.sha256(joined.encode()).hexdigest())
                out[-1].append(",".join(f"{k}:{a}:{b}" for a, b, k in found))
            return out
        return run

    return with_text_columns(df, text, fields, make, keep=[c for c in df.columns if c != text])


def mask(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every span of ``text`` replaced by its kind in angle brackets.

    Overlapping spans are replaced by the first one's kind over their union; a null text stays null.
    """
    def make():
        anchors = automaton()

        def one(t):
            if t is None:
                return None
            s = t.decode()
            out, last, end = [], 0, -1
            for a, b, kind in spans(s, anchors):
                if a < end:
                    end = last = max(end, b)
                    continue
                out += [s[last:a], f"<{kind.upper()}>"]
                end = last = b
            return "".join([*out, s[last:]])

        return lambda texts: [[one(t) for t in texts]]

    kept = [c for c in df.columns if c != text]
    return with_text_columns(df, text, [T.StructField(text, T.StringType())], make,
                             keep=kept).select(*df.columns)


def op8_pii_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op8_pii_anchor_expansion": op8_pii_anchor_expansion}
ORACLES: dict[str, str] = {}
