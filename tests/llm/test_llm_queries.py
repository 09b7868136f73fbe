import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from netquill.llm import queries
from tests.oracle import connect, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_oracle(spark, name):
    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(connect(SF).execute(queries.oracle_sql()[name]).df())


def test_samples_decode(spark):
    out = queries.op6_piece_sampling(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert out.where("not exact").count() == 0 and out.select("doc_id").distinct().count() == docs


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    made = queries.op10_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id")
    assert made.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        if name == "language_id":
            assert docs.count() >= 0.97 * start
        docs = docs.persist()
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert encoded.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert queries.queries()["pipeline"](spark, SF).count() == encoded.count()


ODD = [
    (1, "a line that several documents share\nfirst text", "en", "a", 5), (1, "a line that several documents share\nanother text of this id", "en", "a", 5),
    (2, "a line that several documents share\nsecond", None, None, None), (3, "a line that several documents share", "en", "b", 5),
    (4, None, "en", "a", 0), (5, "", "en", "a", 0), (None, "a text without an id", "en", "a", 5), (6, "long words " * 3000, "en", "src0", 5),
]


def odd(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)


def test_line_stage_keeps_each_row_its_text(spark):
    got = sorted((r["doc_id"] or 0, r["text"] or "", r["n_chars"]) for r in corpus_pipeline.line_stage(spark, odd(spark, ODD), SF).collect())
    kept = {1: ["another text of this id", "first text"], 2: ["second"], 3: ["a line that several documents share"], 4: [""], 5: [""], 0: ["a text without an id"], 6: ["long words " * 3000]}
    assert [(i, t) for i, t, _ in got] == sorted((i, t) for i, ts in kept.items() for t in ts)
    assert all(n == len(t) for _, t, n in got if t)
    assert corpus_pipeline.line_stage(spark, odd(spark, ODD[:0]), SF).count() == 0


def test_copies_draw_their_own_samples(spark):
    text = "unlikely extraordinary internationalization of segmentations"
    rows = [(1, text, "en", "a", 5)] * 6 + [(None, text, "en", "a", 5), (2, None, "en", "a", 5)]
    got = corpus_pipeline.encoding_stage(spark, odd(spark, rows), SF).where("sample = 1").collect()
    assert len(got) == 8 and len({tuple(r["ids"]) for r in got if r["doc_id"] == 1}) > 1
    assert corpus_pipeline.encoding_stage(spark, odd(spark, rows[:0]), SF).count() == 0
