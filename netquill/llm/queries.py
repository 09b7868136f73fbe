"""One query for each training-data operator, applied to its whole table, and the oracles that SQL can express.

The operator modules are imported when a query runs, so that listing the queries stays light.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquill.llm import oracles
from netquill.llm.common import read_table


def op1_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netquill.llm.mtree_search import top_k

    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netquill.llm.suffix_tree_lm import score_documents

    return score_documents(read_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netquill.llm.url_filter import judge_urls

    return judge_urls(read_table(spark, sf_dir, "pages"))


def op5_projected_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netquill.llm.projected_search import nearest

    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


#: Shares of the mixed corpus in op2; the other sources keep their proportions.
MIX_TARGETS = {"src0": 0.2, "src1": 0.1, "src2": 0.05}
MIX_RATE = 1.25


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netquill.llm.source_mixing import mix_sources

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs, MIX_TARGETS, MIX_RATE)


def op6_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of every text with a hash of their ids; ``exact`` says that the ids decode to the text."""
    from netquill.llm.piece_sampling import encode

    encoded = encode(read_table(spark, sf_dir, "documents"), verify=True)
    ids = (F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"))
    return encoded.select("doc_id", "sample", *ids, "log_prob", "perturbed", "log_inclusion", "exact")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netquill.llm.toxicity import score_documents

    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netquill.llm.line_dedup import dedup_lines

    out = dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netquill.llm.minhash_dedup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netquill.llm.language_id import identify

    return identify(read_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netquill.llm.prefix_trie import prefix_trie

    return prefix_trie(read_table(spark, sf_dir, "conversations"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netquill.llm.substring_dedup import dedup_substrings

    out = dedup_substrings(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netquill.llm.ranked_search import rank_documents

    return rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=50)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = (op1_mtree_search, op2_source_mixing, op3_suffix_tree_lm, op4_url_filter, op5_projected_search, op6_piece_sampling, op7_toxicity, op8_line_dedup, op9_minhash_dedup, op10_language_id, op11_prefix_trie, op12_substring_dedup, op13_ranked_search, pipeline)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
