"""Helpers shared by the training-data operators: scratch tables, text chunks and vectorised hashing."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Text bytes handled at once inside a task; bounds a Python worker's memory whatever the row count of a batch.
CHUNK_BYTES = 2 << 20
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a local one is made only where none is set, as in tests."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="netquill-")
        spark.sparkContext.setCheckpointDir(path)
    return path


@contextlib.contextmanager
def clean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are deleted as soon as it ends, since nothing reads them again."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Rows of what runs inside go to Python tasks in batches of about ``size`` at most, however long the rows."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with clean_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` wrote, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents_of(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra columns can't clash with those an operator adds."""
    return docs.select(*[docs[c] for c in columns])


def mod_of_id(column, n: int):
    """crc32 of an integer id's decimal text, modulo n: the fold rule of the labelled operators."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(n)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches holding about ``limit`` bytes of text, with the texts as UTF-8 (null: empty)."""
    for batch in batches:
        column_ = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(column_), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = min(int(np.searchsorted(ends, before + limit)) + 1, len(ends))
            yield batch.slice(start, stop - start), [x or b"" for x in column_.slice(start, stop - start).to_pylist()]
            start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift rounds) applied element-wise."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse, up to n."""
    global _powers
    if len(_powers[0]) < n:
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(n, U64(base))
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers = (made[0], made[1])
    return _powers


def range_hashes(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of ranges of code points."""
    power, inverse = _power_tables(len(codes) + 1)
    total = np.zeros(len(codes) + 1, U64)
    np.cumsum(mix64(codes.astype(U64) + U64(1 + (seed << 32))) * power[: len(codes)], out=total[1:])
    return mix64((total[starts + lengths] - total[starts]) * inverse[starts] + lengths.astype(U64))


def hashed_words(texts: list[bytes], lower: bool = True, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text with A-Z lower-cased.

    Returns 64-bit word hashes in order, the first word's number for each text (one more entry at the end),
    the words' start and end bytes, and the (lower-cased) joined bytes they point into. ``lower=False`` leaves letters as they
    are; ``between`` says of each byte whether it parts words (a line feed must).
    """
    joined = b"\n".join([*texts, b""]) if texts else b""
    joined = joined.lower() if lower else joined
    data = np.frombuffer(joined, np.uint8)
    firsts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=firsts[1:])
    space = between[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64))
    return hashes, np.searchsorted(starts, firsts), starts, ends, joined


def list_array(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
