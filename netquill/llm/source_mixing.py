"""Mixing sources to target weights by Poisson replication.

A source with target weight w gets the mean repetition rate ``w * budget / rows``. A document's number of copies is the
Poisson quantile of a uniform number hashed from the seed and its ``doc_id``; documents are exploded by it and sorted by a
second hash, which shuffles them globally. Sources without a weight share what the named weights leave, in proportion to
their rows.

A rate above ``MAX_RATE`` is dealt over equal parts below it, whose independent quantiles add up to a Poisson number of the rate.

Cases: rows with a null or repeated ``doc_id`` draw the same number as others of that id; a null source counts among the
unnamed; weights must not exceed 1 in sum; a named source that has no rows leaves its share of the budget unused; an empty
table gives an empty result; all columns are kept, null and empty texts included, and ``copy`` (from 1) and ``shuffle_key``
follow: a column of the input by one of the names in ``OWN`` is an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RATE = 500.0
OWN = ("copy", "shuffle_key", "__n")


def poisson_cdf(rate: float) -> list[float]:
    """The distribution function at 0, 1, ... until it can't grow any more in double precision."""
    if not 0 <= rate <= MAX_RATE:
        raise ValueError(f"repetition rate {rate} is not between 0 and {MAX_RATE}")
    out, total, k = [], 0.0, 0
    while True:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate else float(k == 0)
        out.append(min(total, 1.0))
        k += 1
        if k > rate and (total >= 1.0 or len(out) > 1 and out[-1] == out[-2]):
            return out


def hashed_uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 over the seed and the parts."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _quantile(rate: float, seed: str, doc_id: Column) -> Column:
    """A row's Poisson number of mean ``rate``."""
    parts = max(1, math.ceil(rate / MAX_RATE))
    steps = F.array(*map(F.lit, poisson_cdf(rate / parts)))
    # the one-element array has the uniform number made once for all steps
    count = lambda u: F.transform(F.array(u), lambda x: F.size(F.filter(steps, lambda c: c <= x)))[0]
    first = count(hashed_uniform(seed, doc_id))
    if parts == 1:
        return first
    return F.aggregate(F.sequence(F.lit(1), F.lit(parts - 1)), first, lambda total, part: total + count(hashed_uniform(f"{seed} part", part, doc_id)))


def mix_sources(docs: DataFrame, targets: dict[str, float], mean_rate: float = 1.0, seed: str = "mix") -> DataFrame:
    """``docs`` replicated so that each named source makes up its target share of ``mean_rate`` times the rows."""
    if taken := sorted({*OWN} & {c.lower() for c in docs.columns}):
        raise ValueError(f"columns {taken} clash with those that mixing adds")
    rest = 1.0 - sum(targets.values())
    if rest < -1e-9 or any(w < 0 for w in targets.values()):
        raise ValueError("target weights must be at least 0 and at most 1 in sum")
    names = sorted(targets)
    group = F.when(F.col("source").isin(names), F.col("source")) if names else F.lit(None).cast("string")
    counts = {r["named"]: r["count"] for r in docs.groupBy(group.alias("named")).count().collect()}  # one row for each target, and one
    budget = mean_rate * sum(counts.values())
    # reciprocal order of operations kept simple, as the oracle must give the same doubles
    rates = {name: targets[name] * budget / counts[name] for name in names if name in counts}
    copies = _quantile(max(rest, 0.0) * budget / counts[None], seed, docs["doc_id"]) if None in counts else F.lit(0)
    for name, rate in rates.items():
        copies = F.when(docs["source"] == name, _quantile(rate, seed, docs["doc_id"])).otherwise(copies)
    drawn = docs.withColumn("__n", copies).where("__n > 0")
    spread = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")
    key = F.md5(F.concat_ws("|", F.lit(f"{seed} order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("copy").cast("string")))
    return spread.withColumn("shuffle_key", key).orderBy("shuffle_key")
