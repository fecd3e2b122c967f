"""BPE encoding and decoding with content-defined chunk reuse (operator 3).

A rolling hash cuts every text into content-defined chunks, so equal passages of different
documents give equal chunks. A chunk is encoded once per task and then reused from a store whose
bytes are bounded; encoder and store end with the task, so that nothing of them stays in a worker. Chunks are encoded on their own, so the tokens around a chunk join may be wrong;
a join is repaired by re-encoding the text between the last sure boundary of the left chunk and
the first sure boundary of the right one, and the window grows over further chunks until both
sides have a token boundary exactly at the window's ends. A boundary is sure where white space
follows a printable character: the pre-tokeniser starts a piece there whatever stands around it.

Defined cases: a null text is encoded as the empty text (no tokens, decodes to ""); repeated rows
give repeated results; the special token's string is one special id wherever it occurs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuflow.llm.common import table, with_text_columns

CHUNK_BITS = 11             # a cut every 2**11 characters on average
MIN_CHUNK, MAX_CHUNK = 256, 16384
STORE_BYTES = 16 << 20      # of chunks and their ids that one task keeps
# A piece starts at this white space in any context.
SURE = re.compile("(?<=[!-~À-ɏ])[ \n]")


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> dict:
    """Vocabulary of a byte-level BPE tokenizer file: id -> bytes, and special strings -> id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"], spec["model"]
    if (model["type"], pre["type"], spec["normalizer"], pre["add_prefix_space"]) != (
            "BPE", "ByteLevel", None, False):
        raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    alphabet = byte_alphabet()
    pieces = {i: bytes(alphabet[c] for c in s) for s, i in model["vocab"].items()
              if s not in special}
    order = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))]
             for m in model["merges"]]
    if order != sorted(order):
        raise ValueError(f"{path}: ids are not in merge order")
    return {"pieces": pieces, "special": special}


def held(text: str, encoded: tuple) -> int:
    """Bytes that a stored chunk takes at most, with its objects."""
    return 4 * len(text) + encoded[0].nbytes + 500


class ChunkEncoder:
    """Encodes and decodes texts, keeping the encodings of chunks it has seen."""

    def __init__(self, vocabulary: dict, store_bytes: int = STORE_BYTES,
                 chunk_bits: int = CHUNK_BITS, min_chunk: int = MIN_CHUNK,
                 max_chunk: int = MAX_CHUNK) -> None:
        pieces, self.special = vocabulary["pieces"], vocabulary["special"]
        self.encoding = tiktoken.Encoding(
            "chunks", pat_str=public_tokenizers.PATTERN,
            mergeable_ranks={b: i for i, b in pieces.items()}, special_tokens={})
        size = max([*pieces, *self.special.values()]) + 1
        self.bytes = [b""] * size
        for i, b in pieces.items():
            self.bytes[i] = b
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.decimal = [str(i) for i in range(size)]
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") \
            if self.special else None
        self.bits, self.least, self.most = chunk_bits, min_chunk, max_chunk
        self.store: dict[str, tuple] = {}
        self.stored, self.limit = 0, store_bytes
        self.reused = self.encoded = 0

    def cuts(self, text: str) -> list[int]:
        """Chunk ends: where the hash of the last 16 characters has its top bits zero."""
        n = len(text)
        if n <= self.least:
            return [n]
        h = np.frombuffer(text.encode("utf-32-le"), np.uint32) * np.uint32(0x9E3779B1)
        for k, factor in ((1, 0x85EBCA6B), (2, 0xC2B2AE35), (4, 0x27D4EB2F), (8, 0x165667B1)):
            h[k:] = h[k:] + (h[:-k] ^ (h[:-k] >> np.uint32(15))) * np.uint32(factor)
        ends, last = [], 0
        for c in (np.flatnonzero(h >> np.uint32(32 - self.bits) == 0) + 1).tolist() + [n]:
            while c - last > self.most:
                last += self.most
                ends.append(last)
            if c - last >= self.least or c == n and c > last:
                ends.append(c)
                last = c
        return ends

    def chunk(self, text: str) -> tuple:
        """(ids, first sure character and its token, last sure character and its token)."""
        got = self.store.pop(text, None)
        if got is None:
            self.encoded += 1
            got = self._encode_chunk(text)
            self.stored += held(text, got)
            while self.stored > self.limit and self.store:
                old = next(iter(self.store))
                self.stored -= held(old, self.store.pop(old))
        else:
            self.reused += 1
        self.store[text] = got
        return got

    def _encode_chunk(self, text: str) -> tuple:
        ids = np.array(self.encoding.encode_ordinary(text), np.int32)
        first = SURE.search(text, 1)
        if first is None:
            return ids, None
        head = tail = first.start()
        for back in (64, 1024, len(text)):
            found = [m.start() for m in SURE.finditer(text, max(head, len(text) - back))]
            if found:
                tail = found[-1]
                break
        ends = np.cumsum(self.lengths[ids])
        spots = [len(text[:p].encode()) for p in (head, tail)]
        at = np.searchsorted(ends, spots)
        if any(ends[i] != s for i, s in zip(at, spots)):   # no token ends here: widen the window
            return ids, None
        return ids, (head, int(at[0]) + 1, tail, int(at[1]) + 1)

    def encode(self, text: str) -> np.ndarray:
        parts = self.split.split(text) if self.split else [text]
        out: list[np.ndarray] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(np.array([self.special[part]], np.int32))
            elif part:
                out += self._encode_part(part)
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def _encode_part(self, text: str) -> list[np.ndarray]:
        ends = self.cuts(text)
        if len(ends) == 1:
            return [self.chunk(text)[0]]
        out, window, last = [], "", 0
        for end in ends:
            part = text[last:end]
            ids, sure = self.chunk(part)
            if sure is None:            # no agreement inside this chunk: the window covers it
                window += part
            else:
                head, head_token, tail, tail_token = sure
                if last:
                    out.append(np.array(self.encoding.encode_ordinary(window + part[:head]), np.int32))
                else:
                    head_token = 0      # the text starts here, so its first tokens are right
                out.append(ids[head_token:tail_token])
                window = part[tail:]
            last = end
        out.append(np.array(self.encoding.encode_ordinary(window), np.int32))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def _vocabulary(spark: SparkSession, path: str | None):
    return spark.sparkContext.broadcast(load(path or public_tokenizers.path("byte_bpe_50k.json")))


def encode(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``df`` plus ``ids`` array<int>, ``n_tokens`` and ``round_trip`` (decoding gives the text)."""
    vocabulary = _vocabulary(df.sparkSession, path)
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())),
              T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())]

    def make():
        coder = ChunkEncoder(vocabulary.value)

        def run(texts):
            plain = [(t or b"").decode() for t in texts]
            ids = [coder.encode(t) for t in plain]
            same = [coder.decode(i.tolist()) == t for i, t in zip(ids, plain)]
            return [ids, [len(i) for i in ids], same]
        return run

    return with_text_columns(df, text, fields, make)


def encode_digests(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``df`` plus n_tokens, ids_sha256 and decoded_sha256; ids and decoded texts stay in the task."""
    vocabulary = _vocabulary(df.sparkSession, path)
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]

    def make():
        coder = ChunkEncoder(vocabulary.value)

        def sha(x: str) -> str:
            return hashlib.sha256(x.encode()).hexdigest()

        def run(texts):
            out: list[list] = [[], [], []]
            for t in texts:
                ids = coder.encode((t or b"").decode()).tolist()
                out[0].append(len(ids))
                out[1].append(sha(",".join(map(coder.decimal.__getitem__, ids))))
                out[2].append(sha(coder.decode(ids)))
            return out
        return run

    return with_text_columns(df, text, fields, make, keep=[c for c in df.columns if c != text])


def decode(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` plus ``decoded`` string (null ids: null; ids outside the vocabulary: nothing)."""
    vocabulary = _vocabulary(df.sparkSession, path)
    @F.pandas_udf("string")
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = ChunkEncoder(vocabulary.value)
        size = len(coder.bytes)
        for col in columns:
            yield col.map(lambda x: None if x is None else coder.decode([i for i in map(int, x) if 0 <= i < size]))

    return df.withColumn("decoded", run(F.col(ids)))


def op3_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op3_bpe_chunk_reuse": op3_bpe_chunk_reuse}
ORACLES: dict[str, str] = {}
