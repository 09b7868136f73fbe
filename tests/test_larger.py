import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netquill.operators import baseline, models
from netquill.plans import catalog
from netquill.plans.adapters import conn
from tests.oracle import rows


@pytest.fixture(scope="module")
def busy(spark, tmp_path_factory):
    """More events in ten days than a baseline learns from."""
    d = str(tmp_path_factory.mktemp("busy"))
    i = F.col("id")
    events = spark.range(60_000).select(
        i.alias("event_id"), F.timestamp_micros(i * 20_000_003).alias("ts"), (i % 50).alias("user_id"), F.concat(F.lit("t"), (i % 4).cast("string")).alias("event_type"),
        (F.pmod(F.xxhash64("id"), F.lit(10_000 + i)) / 100).alias("value"), F.format_string('{"k": %d}', i * 7 % 97).alias("props"),
    )
    events.coalesce(1).write.parquet(f"{d}/events.parquet")
    return d


@pytest.mark.parametrize("name", ["b3_profiles", "b5_baseline_p_values", "m13_time_parts"])
def test_queries_of_more_than_the_cap_equal_their_oracles(spark, busy, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{busy}/events.parquet/*.parquet'")
    assert rows(catalog.queries()[name](spark, busy).toPandas()) == rows(con.execute(catalog.oracle_sql()[name]).df())


def test_a_split_by_time_is_exact(spark):
    for n, share in ((200_001, 0.5), (200_001, 0.3), (7, 0.5), (1, 0.5)):
        df = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(10**12)).cast("double").alias("ts")).repartition(5)
        assert models.time_split(df, share=share, accuracy=100).where("part = 0").count() == -int(-n * share // 1)
    ties = spark.createDataFrame([(t,) for t in [1.0] * 3 + [2.0] * 5 + [3.0] + [None]], "ts double")
    assert sorted(map(str, (r["part"] for r in models.time_split(ties).collect()))) == ["0"] * 8 + ["1", "None"]


def test_a_split_by_time_is_exact_whatever_order_its_rows_come_in(spark):
    def shuffled(frames):  # another order at each evaluation, as parts come from executors
        yield pd.concat(frames).sample(frac=1, random_state=int.from_bytes(os.urandom(4)))

    df = spark.range(300_001, numPartitions=2).select(F.pmod(F.xxhash64("id"), F.lit(10**12)).cast("double").alias("ts")).mapInPandas(shuffled, "ts double")
    for _ in range(3):
        assert models.time_split(df, accuracy=100).where("part = 0").count() == 150_001


@pytest.fixture(scope="module")
def busier(spark, tmp_path_factory):
    """Events that reach the cap of a learning set before its ten days, and go on beyond them."""
    d = str(tmp_path_factory.mktemp("busier"))
    i = F.col("id")
    events = spark.range(90_000).select(
        i.alias("event_id"), F.timestamp_micros(i * 10_000_003).alias("ts"), (i % 50).alias("user_id"), F.concat(F.lit("t"), (i % 4).cast("string")).alias("event_type"),
        (F.pmod(F.xxhash64("id"), F.lit(10_000 + i)) / 100).alias("value"), F.format_string('{"k": %d}', i * 7 % 97).alias("props"),
    )
    events.coalesce(1).write.parquet(f"{d}/events.parquet")
    return d


@pytest.mark.parametrize("name", ["b3_profiles", "b5_baseline_p_values"])
def test_baselines_that_end_learning_at_the_cap_equal_their_oracles(spark, busier, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{busier}/events.parquet/*.parquet'")
    assert rows(catalog.queries()[name](spark, busier).toPandas()) == rows(con.execute(catalog.oracle_sql()[name]).df())


def test_learning_ends_at_the_flow_at_which_the_reference_arms(spark, busier):
    flows = conn(spark, busier)
    seen = [(r["ts"], r["rid"]) for r in flows.select("ts", "rid").orderBy("ts", "rid").collect()]
    for min_flows, min_s, cap in ((500, 864_000, 50_000), (500, 864_000, 89_000), (1500, 600, 50_000)):
        learn = []
        for ts, rid in seen:  # OnlineBaseline.observe: arms by number and span, or by its max_learn_flows
            learn.append(rid)
            if len(learn) >= min_flows and ts - seen[0][0] >= min_s or len(learn) >= cap:
                break
        learned = baseline.learning_set(flows, min_flows, min_s, cap)
        assert learned.agg(F.count("*"), F.max("rank"), F.max("rid")).first()[:] == (len(learn), len(learn), learn[-1])
