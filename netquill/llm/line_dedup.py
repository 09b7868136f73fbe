"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of ``(key_hi, key_lo, n_docs, keeper)``, bucketed and sorted by the key: for each line key the number of
documents that held it and the document that keeps it. All runs have the same buckets, so that a batch meets each of them by a
merge join that moves and sorts the batch alone. A batch is aggregated by key and anti-joined with the runs: keys that no run
knows enter with their largest ``doc_id`` as keeper, the others add to the count and bring no keeper. The first batch that
brings a key hence decides who keeps it. ``fanout`` runs of a level are compacted into one run of the next. Runs lie in
a shared folder with a manifest, where a later call finds them again.

Cases: null or empty text is one empty line; rows with a null ``doc_id`` are returned whole (their lines neither count nor go);
rows repeating a ``doc_id`` count as one document and each loses that document's lines from its own text; an empty table gives
an empty result; further columns are ignored unless kept.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquill.llm.common import documents_of, materialize, shared_dir, text_chunks

BLANK = b" \t\n\x0b\x0c\r"
KEYS = "doc_id long, key_hi long, key_lo long"
KEY = ["key_hi", "key_lo"]
#: Keys held by more than a share of 1 / HEAVY of all lines, so HEAVY of them at most, are broadcast in place of being shuffled to.
HEAVY = 2000
#: Lets a scan of a bucket that is one sorted file count as sorted.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def _key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of a line's key, or None for a key below ``min_chars`` code points."""
    line = line.strip(BLANK).lower()  # bytes.lower() changes A-Z alone
    if len(line) < min_chars or len(line) < 4 * min_chars and len(line.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(line)


def line_keys(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """One row per document and distinct long line key."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            ids, high, low = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                for key in {k for line in text.split(b"\n") if (k := _key(line, min_chars))}:
                    ids.append(doc_id)
                    high.append(int.from_bytes(key[:8], "big", signed=True))
                    low.append(int.from_bytes(key[8:], "big", signed=True))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, high, low)], names=["doc_id", *KEY])

    return documents_of(docs, "doc_id", "text").where("doc_id is not null").mapInArrow(keys, KEYS)


@contextlib.contextmanager
def _ordered_buckets(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(ORDERED, "false")
    spark.conf.set(ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(ORDERED, before)


class LineRuns:
    """The levelled runs under ``directory``, a folder that driver and executors share.

    A run is a folder of sorted bucket files. The newest complete manifest lists the runs that count; it is written by
    ``commit``, after them, so a call that is lost half-way leaves what was there before, and folders that no manifest lists are
    ignored. Any session finds the runs by the manifest: tables are made over the folders for the time of the call alone. One
    call at a time may write.
    """

    def __init__(self, spark: SparkSession, directory: str, fanout: int = 2):
        self.spark, self.directory, self.fanout = spark, directory, fanout
        self.files = spark._jvm.org.apache.hadoop.fs.Path(directory).getFileSystem(spark._jsc.hadoopConfiguration())
        self.version, self.levels, self.made, self.gone = 0, [[]], [], []
        # as many buckets as shuffles have partitions, unless runs are there already
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        done = self.files.globStatus(self._path("manifest", "*", "_SUCCESS")) or []
        if done:
            self.version = max(int(x.getPath().getParent().getName()) for x in done)
            kept = json.loads(spark.read.text(f"{directory}/manifest/{self.version}").first()[0])
            self.levels, self.buckets = kept["levels"], kept["buckets"]
        for name in (n for level in self.levels for n in level):
            columns = f"({', '.join(f'{k} LONG' for k in KEY)}, n_docs LONG, keeper LONG)"
            by = ", ".join(KEY)
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} {columns} USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{directory}/{name}'")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.directory, *parts]))

    def _level(self, level: int) -> list[str]:
        while len(self.levels) <= level:
            self.levels.append([])
        return self.levels[level]

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def joined(self, keys: DataFrame) -> DataFrame:
        """A batch (rows of ``line_keys``, of documents that no earlier batch had) as a run: ``keeper`` for unknown keys alone."""
        batch = keys.groupBy(*KEY).agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
        for run in self.runs():
            known = run.where("keeper is not null").select(*KEY, F.lit(True).alias("known"))
            batch = batch.join(known.hint("merge"), KEY, "left").withColumn("keeper", F.when(F.col("known").isNull(), F.col("keeper"))).drop("known")
        return batch

    def add(self, keys: DataFrame) -> None:
        with _ordered_buckets(self.spark):
            self._append(self.joined(keys), 0)

    def _save(self, run: DataFrame, level: int) -> str:
        name = f"run_{level}_{uuid.uuid4().hex}"
        run.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet").option("path", f"{self.directory}/{name}").saveAsTable(name)
        self.made.append(name)
        return name

    def _append(self, run: DataFrame, level: int) -> None:
        self._level(level).append(self._save(run, level))
        while len(self._level(level)) >= self.fanout:
            merged = self._merge(self._level(level), level + 1)
            self._level(level).clear()
            level += 1
            self._level(level).append(merged)

    def _merge(self, tables: list[str], level: int) -> str:
        """One run in place of several: counts added up; of the rows of a key one at most has a keeper, that of the first batch."""
        while len(tables) > 1:
            a, b = (self.spark.table(t).select(*KEY, F.col("n_docs").alias(f"n_{s}"), F.col("keeper").alias(f"keeper_{s}")) for s, t in zip("ab", tables[:2]))
            both = a.join(b.hint("merge"), KEY, "full")
            counted = (F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))).alias("n_docs")
            name = self._save(both.select(*KEY, counted, F.coalesce("keeper_a", "keeper_b").alias("keeper")), level)
            for table in tables[:2]:
                self.gone.append(table)
                if table in self.made:  # no manifest lists it
                    self._delete(table)
            tables = [name, *tables[2:]]
        return tables[0]

    def _delete(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.files.delete(self._path(table), True)

    def compacted(self) -> DataFrame:
        """All runs merged into one."""
        there = [t for level in self.levels for t in level]
        if len(there) > 1:
            with _ordered_buckets(self.spark):
                whole = self._merge(there, len(self.levels))
            self.levels = [[] for _ in self.levels] + [[whole]]
        return self.runs()[0]

    def commit(self) -> None:
        """The runs there are now are those that later calls find; what they replace is deleted."""
        self.version += 1
        text = json.dumps({"levels": self.levels, "buckets": self.buckets})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.directory}/manifest/{self.version}")
        for table in self.gone:
            self._delete(table)
        self.files.delete(self._path("manifest", str(self.version - 1)), True)
        self.close()

    def close(self) -> None:
        """Forget the tables; the folders stay."""
        for table in (t for level in self.levels for t in level):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def drop(self) -> None:
        self.close()
        self.files.delete(self._path(), True)


def _batches(keys: DataFrame, n: int) -> list[DataFrame]:
    """``keys`` in ``n`` ranges of doc_id that hold about as many rows each, from the greatest ids down."""
    cuts = keys.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.01) if n > 1 else []
    cuts = sorted({int(x) for x in cuts}, reverse=True)
    above = [F.lit(True), *(F.col("doc_id") < x for x in cuts)]
    below = [*(F.col("doc_id") >= x for x in cuts), F.lit(True)]
    return [keys.where(a & b) for a, b in zip(above, below)]


def dedup_lines(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2, keep: tuple[str, ...] = ("doc_id",), directory: str | None = None
) -> DataFrame:
    """The ``keep`` columns of every row with ``kept_text``, ``n_lines`` and ``n_dropped``.

    Lines whose key has at least ``min_chars`` code points and is held by at least ``min_docs`` documents stay only in the
    largest ``doc_id`` holding it. ``batches`` ranges of doc_id, the greatest first, are fed to the runs one after the other.
    With ``directory``, a folder that driver and executors share, the runs found there count as batches before these, whose
    keepers stay, and the runs are left there for the next call, of this session or another.
    """
    spark = docs.sparkSession
    given = documents_of(docs, *dict.fromkeys(("doc_id", "text", *keep)))
    keys = materialize(line_keys(given, min_chars), "line-keys")
    runs = LineRuns(spark, directory or f"{shared_dir(spark)}/line-runs-{uuid.uuid4().hex}", fanout)
    earlier = bool(runs.runs())
    for batch in _batches(keys, batches):
        runs.add(batch)
    repeated = materialize(runs.compacted().where(F.col("n_docs") >= min_docs), "line-repeated")
    if directory is None:
        runs.drop()
    else:
        runs.commit()
    often = keys.count() // HEAVY
    if earlier:  # counts of this call's rows, since a stored count says nothing about them
        here = keys.groupBy(*KEY).agg(F.count("*").alias("here")).where(F.col("here") > often)  # under HEAVY keys
        heavy = F.broadcast(materialize(repeated.join(here, KEY).select(*KEY, "keeper"), "line-heavy"))
        light = repeated.drop("n_docs").join(heavy.select(*KEY), KEY, "left_anti")
    else:
        heavy = F.broadcast(repeated.where(F.col("n_docs") > often).drop("n_docs"))  # under HEAVY keys
        light = repeated.where(F.col("n_docs") <= often).drop("n_docs")
    held = keys.join(heavy, KEY).unionByName(keys.join(heavy.select(*KEY), KEY, "left_anti").join(light, KEY))
    gone = held.where("doc_id <> keeper").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct(*KEY)).alias("__gone"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*keep).schema]

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(parts, "__text"):
            kept, n_lines, n_dropped = [], [], []
            for text, gone in zip(texts, batch.column(batch.num_columns - 1).to_pylist()):
                lines = text.split(b"\n")
                bad = {x["key_hi"].to_bytes(8, "big", signed=True) + x["key_lo"].to_bytes(8, "big", signed=True) for x in gone or ()}
                stay = [x for x in lines if _key(x, min_chars) not in bad] if bad else lines
                kept.append(b"\n".join(stay).decode())
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            made = [pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[*keep, "kept_text", "n_lines", "n_dropped"])

    rows = given.select(*keep, F.col("doc_id").alias("__doc"), F.col("text").alias("__text"))
    named = rows.where("__doc is not null").join(gone, F.col("__doc") == F.col("__id"), "left").drop("__doc", "__id")
    nameless = rows.where("__doc is null").select(*keep, "__text", F.lit(None).cast(gone.schema["__gone"].dataType).alias("__gone"))
    return named.unionByName(nameless).mapInArrow(cut, ", ".join([*kinds, "kept_text string, n_lines long, n_dropped long"]))
