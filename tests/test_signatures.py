import random
import re

import pytest
from pyspark.sql import functions as F

from netquill.operators.signatures import scan_signatures

DDL = "rule string, string_id string, kind string, pattern string, at_offset int, min_hits int, max_size bigint"


def plain(body, rules):
    """Each string looked for by itself."""
    found = {}
    for rule, name, kind, pattern, at, least, most in rules:
        if body is None or pattern is None or (most is not None and len(body) > most):
            continue
        text, flags = re.escape(pattern.encode()), 0
        if kind == "nocase":
            flags = re.IGNORECASE
        elif kind == "hex":
            text, flags = b"".join(b"." if p in ("..", "??") else re.escape(bytes.fromhex(p)) for p in re.findall("..", pattern)), re.DOTALL
        elif kind == "regex":
            text = pattern.encode()
        hit = re.compile(text, flags)
        if hit.search(body) if at is None else hit.match(body, at):
            found.setdefault((rule, least), set()).add(name)
    return {(rule, len(ids), tuple(sorted(ids))) for (rule, least), ids in found.items() if len(ids) >= least}


def test_a_thousand_rules_equal_each_string_by_itself(spark):
    draw = random.Random(3)
    word = lambda n: "".join(draw.choice("abAB\u00e9.") for _ in range(n))
    rules = []
    for i in range(1000):
        least = draw.choice([1, 2, 3])
        for j in range(3):
            kind, at = draw.choice(["text", "nocase", "hex", "regex"]), draw.choice([None, None, None, 0, 3])
            pattern = word(draw.choice([1, 2, 4, 6]))
            if kind == "hex":
                pattern = "".join(draw.choice(["..", "??"]) if draw.random() < 0.3 else f"{b:02x}" for b in pattern.encode())
            elif kind == "regex":
                pattern = re.escape(pattern) + "[ab]{2}"
            rules.append((f"r{i}", f"s{j}", kind, pattern, at, least, draw.choice([None, None, 60])))
    rules += [("wild", "a", "hex", "....", None, 1, None), ("empty", "a", "text", "", None, 1, None), ("null", "a", "text", None, None, 1, None)]
    bodies = [(i, bytes(word(draw.choice([0, 5, 50, 400])).encode())) for i in range(60)] + [(60, None), (61, bytes(range(256)) * 20)]
    got = scan_signatures(spark.createDataFrame(bodies, "path long, content binary").repartition(3), spark.createDataFrame(rules, DDL)).collect()
    want = {(i, *f) for i, body in bodies for f in plain(body, rules)}
    assert {(r["path"], r["rule"], r["hits"], tuple(r["strings"])) for r in got} == want and len(got) == len(want) > 1000


def test_the_scan_neither_shuffles_nor_joins(spark, capsys):
    rules = spark.createDataFrame([("r", "a", "text", "marker", None, 1, None)], DDL)
    scan_signatures(spark.range(3).select(F.col("id").alias("path"), F.lit("marker").alias("content")), rules).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") == 1


def test_rules_that_cant_be_read_are_refused(spark):
    with pytest.raises(ValueError):
        scan_signatures(spark.range(1).withColumn("content", F.lit("x")), spark.createDataFrame([("r", "a", "hex", "4D5", None, 1, None)], DDL), file_id="id")
