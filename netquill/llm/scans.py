"""Running sums over rows sorted across partitions, so that the rows of one key, however many, needn't meet in one task.

Rows are dealt in ranges of (key, order), sorted, and summed inside each task for each run of a key. A key that goes on in
later partitions has its sums carried over: only the last key of a partition can, so what the driver adds up is one row for
each partition at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.llm.common import materialize

#: From the position in its run and a batch to the terms that are summed, one array for each sum.
Terms = Callable[[np.ndarray, pa.RecordBatch], list[np.ndarray]]


def sorted_runs(df: DataFrame, key: str, order: list[str | Column], keep: list[str], terms: Terms, n_sums: int, modulus: int, tag: str) -> DataFrame:
    """A written table of ``keep`` with ``block`` (partition), ``at`` (place in the run, from 1), and for each sum i the row's
    term ``t<i>`` and the run's sum ``s<i>`` up to the row, modulo ``modulus`` (0: none)."""
    names = [f"{kind}{i}" for i in range(n_sums) for kind in "ts"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, carried = None, 0, [0] * n_sums
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
            goes_on = last is not None and keys[0] == last
            at = np.arange(len(keys)) - starts[run] + 1 + np.where(run == 0, count if goes_on else 0, 0)
            made = [pa.array(at, pa.int64())]
            for i, term in enumerate(terms(at, batch)):
                total = np.cumsum(term)
                before = np.where(starts > 0, total[starts - 1], 0)
                sums = total - before[run] + np.where(run == 0, carried[i] if goes_on else 0, 0)
                sums = sums % modulus if modulus else sums
                carried[i] = int(sums[-1])
                made += [pa.array(term, pa.int64()), pa.array(sums, pa.int64())]
            last, count = keys[-1], int(at[-1])
            columns = [batch.column(batch.schema.get_field_index(c)) for c in [*keep, "block"]]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=[*keep, "block", "at", *names])

    dealt = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order).withColumn("block", F.spark_partition_id())
    schema = ", ".join([*(f"`{c}` {dealt.schema[c].dataType.simpleString()}" for c in [*keep, "block"]), "at long", *(f"{c} long" for c in names)])
    return materialize(dealt.mapInArrow(scan, schema), tag)


def crossing(runs: DataFrame, key: str, n_sums: int) -> list[tuple[int, int, int, tuple[int, ...]]]:
    """(key, block, rows, sums) of each part of a key that lies in several blocks, in order; at most two parts for each block."""
    ends = sorted(map(tuple, runs.groupBy("block").agg(F.min(key), F.max(key)).collect()))
    split = {a[2] for a, b in zip(ends, ends[1:]) if a[2] == b[1]}
    if not split:
        return []
    sums = F.struct("at", *(f"s{i}" for i in range(n_sums)))
    wanted = F.broadcast(runs.sparkSession.createDataFrame([(k,) for k in split], "__key long"))
    parts = runs.join(wanted, runs[key] == wanted["__key"]).groupBy(key, "block").agg(F.max(sums).alias("end")).collect()
    return sorted((p[0], p[1], p[2][0], tuple(p[2])[1:]) for p in parts)
