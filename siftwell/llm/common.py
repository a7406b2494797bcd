"""Shared plumbing of the training-data operators: table reading, staging, Arrow helpers."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once by the vectorised kernels; bounds a worker's memory for any batch size.
SLICE_BYTES = 2 << 20

#: Settings while a table is staged.
STAGING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}

WORD_SPACE = r"[\x20\x09-\x0D]+"
LOWER_AZ = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n: the split into learning and held-out rows."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(n)


def unit_hash(c: Column, seed: int = 0) -> Column:
    """A deterministic number in [0, 1) for a row, for samples that need no shuffle."""
    return F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(1 << 30)).cast("double") / float(1 << 30)


def staging_root(spark: SparkSession) -> str:
    """The shared folder that the session names; one of our own only in a local session that names none (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "/tmp/checkpoints"
    return root.rstrip("/") + "/siftwell"


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a table in the shared folder and read it back: cuts lineage and survives lost executors.

    Shuffle files of the write are of no use once the table is there, so Spark drops them at its end.
    Batches for Python are bounded by bytes: long texts don't come by the ten thousand.
    path: where an earlier table of the caller's, no longer needed, is overwritten.
    """
    spark = df.sparkSession
    path = path or f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in STAGING}
    for k, v in STAGING.items():
        spark.conf.set(k, v)
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The table with a key column, and the column's name: distinct numbers in the order of doc_id.

    The key is doc_id itself where every row has one of its own. Otherwise rows are numbered once, in a
    staged table, by doc_id and then text; rows without doc_id come last.
    """
    key = free_name(docs, "row_key")
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if odd.isEmpty():
        return docs.withColumn(key, F.col("doc_id")), key
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first())
    return staged(ordered.withColumn(key, F.monotonically_increasing_id()), "numbered"), key


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_KEPT: dict = {}
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def trimmed() -> None:
    """Give memory that is free, but held in pieces by the allocators, back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(run):
    """A function over batches that gives free memory back at its end: idle workers wait in the memory they had."""

    def whole(batches):
        yield from run(batches)
        trimmed()

    return whole


def kept(key, make=lambda: None):
    """What a worker process keeps between tasks, of one operator at a time.

    Workers are used again by later stages: whatever an earlier operator has left there goes as soon
    as another one asks, so a worker never holds the stores of two.
    """
    if key not in _KEPT:
        _KEPT.clear()
        trimmed()
        _KEPT[key] = make()
        trimmed()
    return _KEPT[key]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """(first row, end row) runs whose text is about `limit` bytes at most; a longer text stands alone."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(column)
    lengths = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    ends = np.cumsum(lengths)
    i = 0
    while i < n:
        base = ends[i] - lengths[i]
        j = max(i + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield i, min(j, n)
        i = min(j, n)


def joined_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and the n + 1 offsets; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]
