"""The training-corpus pipeline: language ID, line dedup, near-dedup, source mixing and piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's
docs. All but the last return the columns of ``documents``, and further columns of the input go with the first.

Cases, for all stages: rows with null and repeated ids pass from stage to stage, each with its own text, except that a repeated
id is one document where lines and near-duplicates are counted; a null or empty text has no language and goes in the first
stage; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netquill.llm.common import materialize, read_table
from netquill.llm.language_id import predict, train
from netquill.llm.line_dedup import dedup_lines
from netquill.llm.minhash_dedup import near_duplicates
from netquill.llm.piece_sampling import encode
from netquill.llm.source_mixing import mix_sources

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Below this cosine with the best language a text counts as no language; texts of a single known word are above it.
MIN_LANGUAGE_SCORE = 0.05
#: Share of the mixed corpus for named sources; the others keep their proportions.
TARGETS = {"src0": 0.2}
MEAN_RATE = 1.25


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (no letters, or near no prototype); sets ``lang`` where it is null.

    The prototypes learn from all rows that have a language."""
    languages, prototypes = train(docs)
    labelled = predict(docs, languages, prototypes, COLUMNS)
    kept = labelled.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each text by its lines that stay; a document left without any word goes, one that was empty before stays."""
    cut = dedup_lines(docs, keep=COLUMNS)
    kept = cut.where((F.col("n_dropped") == 0) | F.col("kept_text").rlike("[^\\x20\\x09-\\x0D]"))
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return kept.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, that with the smallest ``doc_id``."""
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs.select(*COLUMNS), TARGETS, MEAN_RATE).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source`` and the sampled segmentations of each text.

    Copies of a document, as mixing makes them, are numbered by their id and text, and each copy draws its own samples; rows
    without an id draw by their text."""
    text = F.xxhash64(F.col("text"))
    copy = F.row_number().over(Window.partitionBy("doc_id").orderBy(text))
    named = docs.where("doc_id is not null").withColumn("key", F.xxhash64("doc_id", copy))
    nameless = docs.where("doc_id is null").withColumn("key", text)
    rows = named.unionByName(nameless)
    return encode(rows, keep=("doc_id", "lang", "source"), key=F.col("key"))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("source_mixing", mixing_stage),
    ("piece_encoding", encoding_stage),
]

#: SQL can't express the learned language profiles nor the lattice sampling.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
