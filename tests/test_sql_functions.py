from pyspark.sql import functions as F

from netquill.functions import net, sql, text


def test_sql_functions_equal_the_column_functions(spark):
    names = sql.register(spark)
    assert "nq_entropy" in names and "nq_in_cidr" in names
    values = ["", None, "a", "aab", "Example.COM.", "www.x1z9qk.co.uk", "10.1.2.3", "10.1.2.300", "192.168.7.9", "fe80::1", "strength", "ÄÖ.example", " a.b ", "..", "8.8.8.8"]
    rows = spark.createDataFrame([(v, float(i) * 7.5) for i, v in enumerate(values)], "s string, ts double")
    rows.createOrReplaceTempView("nq_rows")
    columns = {
        "entropy": text.entropy(F.col("s")), "consonant_run": text.consonant_run(F.col("s")), "ip_long": net.ip_long(F.col("s")), "labels": text.labels(F.col("s")),
        "time_bucket": net.bucket(F.col("ts"), 10.0).cast("long"),
    }
    for name, column in columns.items():
        given = "ts, 10.0D" if name == "time_bucket" else "s"
        got = [r[0] for r in spark.sql(f"SELECT nq_{name}({given}) FROM nq_rows ORDER BY ts").collect()]
        want = [r[0] for r in rows.orderBy("ts").select(column).collect()]
        same = [abs(a - b) < 1e-12 if isinstance(a, float) else a == b for a, b in zip(got, want)]
        assert all(same), (name, got, want)
    for network in ("10.0.0.0/8", "192.168.7.9", "8.8.0.0/15", "0.0.0.0/0"):
        got = [r[0] for r in spark.sql(f"SELECT nq_in_cidr(s, '{network}') FROM nq_rows ORDER BY ts").collect()]
        assert got == [r[0] for r in rows.orderBy("ts").select(net.in_cidr(F.col("s"), [network])).collect()]
    plan = spark.sql("SELECT nq_entropy(s) FROM nq_rows WHERE nq_in_cidr(s, '10.0.0.0/8')")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Subquery" not in plan


def test_count_min_bounds(spark):
    from netquill.operators.windows import count_min, count_min_estimates

    rows = spark.range(30_000).select(F.lit(1).alias("g"), F.when(F.col("id") < 9000, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 3000).cast("string"))).alias("key"))
    sketch = count_min(rows, F.col("key"), ["g"], width=400)
    assert sketch.count() <= 2000
    true = {r["key"]: r["count"] for r in rows.groupBy("key").count().collect()}
    got = {r["key"]: r["estimate"] for r in count_min_estimates(rows.select("g", "key").distinct(), sketch, "key", ["g"], width=400).collect()}
    over = [got[k] - n for k, n in true.items()]
    assert got.keys() == true.keys() and min(over) >= 0
    assert sum(x > 2.72 / 400 * 30_000 for x in over) <= 0.0068 * len(over)
