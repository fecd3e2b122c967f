"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from skuflow.session import delete_path, scratch_path

# Bytes to the word alphabet: A-Z lower-cased, digits, a-z and all non-ASCII kept, the rest a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256))


BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters; none for null."""
    return text.translate(WORD_BYTES).split() if text else []


def trim() -> None:
    """Give freed memory back to the system: Python workers live on and serve later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):   # not glibc
        pass


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, in the JVM and in the workers, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes sum to about ``limit`` at most (one row may exceed it)."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def with_text_columns(df: DataFrame, text: str, fields: list[T.StructField],
                      make: Callable[[], Callable[[list[bytes | None]], list[list]]],
                      slice_bytes: int = 4 << 20, keep: list[str] | None = None) -> DataFrame:
    """Columns of ``df`` plus ``fields`` computed from the UTF-8 bytes of ``text``.

    ``make()`` runs once a task and returns a function from a list of texts to one list per
    field. Rows stay where they are (no shuffle); texts reach the function whole, in slices of
    about ``slice_bytes``. Input columns named like a new field are replaced by it.
    """
    names = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    src = df.select(*[df[c] for c in kept], df[text].cast("binary").alias("__llm_text"))
    schema = T.StructType([src.schema[c] for c in kept] + list(fields))
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        types = None
        for batch in batches:
            if types is None:
                from pyspark.sql.pandas.types import to_arrow_type
                types = [to_arrow_type(x.dataType) for x in fields]
            body = batch.column(batch.num_columns - 1)
            for lo, hi in slices(pc.binary_length(body).fill_null(0).to_pylist(), slice_bytes):
                new = f(body.slice(lo, hi - lo).to_pylist())
                cols = [batch.column(i).slice(lo, hi - lo) for i in range(len(kept))]
                cols += [pa.array(v, type=t) for v, t in zip(new, types, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=[*kept, *(x.name for x in fields)])
                del new, cols
        del f
        trim()

    return src.mapInArrow(run, schema)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back (cuts the lineage there)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove staged tables after their last reader."""
    for t in tables:
        delete_path(t.sparkSession, t.staged_path)
