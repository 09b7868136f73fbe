"""What the two vector searches share: valid vectors, pages of bounded size, and queries streamed over the pages.

Candidates are dealt to pages. A page's candidates and the queries that visit it meet in one task, candidates first: the
page's index is built once and the queries pass by in batches, so that memory holds one page and one batch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE_ROWS = 2048
#: Rows of the sample that the top of an index is fitted on, and the most cells it makes; both bound what tasks are sent.
SAMPLE_ROWS = 4096
MAX_CELLS = 256
HITS = "query_id long, vec_id long, score double"


def vectors_of(table: DataFrame, drop_zero: bool = False) -> DataFrame:
    """``vec_id, vec``: one valid vector (array<double>) for each id.

    Null ids, null vectors and vectors holding null or non-finite components are left out, as are those of another length
    than the longest valid one; of rows repeating an id the least vector in array order stays.
    """
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & fine)
    if drop_zero:
        rows = rows.where(F.exists("vec", lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    longest = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    return rows.where(F.size("vec") == longest)


def sample_of(vectors: DataFrame, n: int = SAMPLE_ROWS) -> np.ndarray:
    """``n`` vectors at most, chosen by a hash of their ids."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).select("vec").collect()
    return np.array([r["vec"] for r in rows], np.float64)


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64, copy=False)


def with_cells(vectors: DataFrame, cells: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Adds each vector's ``cell`` and its distance ``reach`` from what stands for the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, reach = cells(matrix(batch.column(1))) if len(batch) else (np.zeros(0, np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(reach, pa.float64())], names=[*batch.schema.names, "cell", "reach"])

    schema = T.StructType(vectors.schema.fields + [T.StructField("cell", T.IntegerType()), T.StructField("reach", T.DoubleType())])
    return vectors.mapInArrow(run, schema)


def paged(candidates: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Adds ``page``: a cell's rows are dealt over as many pages as hold ``PAGE_ROWS`` each."""
    pages = F.create_map(*[F.lit(x) for cell, n in counts.items() for x in (cell, math.ceil(n / PAGE_ROWS))])
    return candidates.withColumn("page", F.struct("cell", F.pmod(F.xxhash64(F.lit("page"), "vec_id"), pages[F.col("cell")]).cast("int").alias("part")))


def visits(queries: DataFrame, counts: dict[int, int], plan: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]], home: bool) -> DataFrame:
    """A row for each query and page to visit; ``plan`` gives the cells of each query from ids, vectors and bounds.

    ``home``: one page of each cell, chosen by the query's id, in place of all."""
    pages = {c: math.ceil(n / PAGE_ROWS) for c, n in counts.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ids, bounds = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            rows, cells, parts = [], [], []
            for i, own in enumerate(plan(ids, matrix(batch.column(1)), bounds)):
                for c in own.tolist():
                    for part in [int(ids[i]) % pages[c]] if home else range(pages[c]):
                        rows.append(i)
                        cells.append(c)
                        parts.append(part)
            page = pa.StructArray.from_arrays([pa.array(cells, pa.int32()), pa.array(parts, pa.int32())], names=["cell", "part"])
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int64())) for c in batch.columns), page], names=[*batch.schema.names, "page"])

    return queries.select("vec_id", "vec", "bound").mapInArrow(run, "vec_id long, vec array<double>, bound double, page struct<cell: int, part: int>")


def search_pages(candidates: DataFrame, visiting: DataFrame, index: Callable, search: Callable) -> DataFrame:
    """``search(index(ids, vectors), query_id, query, bound)`` for each visit gives the ids and scores of its best."""
    both = candidates.select("page", F.lit(0).alias("kind"), "vec_id", "vec", F.lit(0.0).alias("bound")).unionByName(
        visiting.select("page", F.lit(1).alias("kind"), "vec_id", "vec", "bound")
    )
    dealt = both.repartition("page").sortWithinPartitions("page", "kind").select("page.cell", "page.part", "kind", "vec_id", "vec", "bound")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, ids, vectors, built = None, [], [], None
        for batch in batches:
            cell, part, kind, vec_id = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            vec, bound = matrix(batch.column(4)), batch.column(5).to_numpy(zero_copy_only=False)
            found: tuple[list, list, list] = ([], [], [])
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(kind)]):
                if high == low:
                    continue
                if page != (cell[low], part[low]):
                    page, ids, vectors, built = (cell[low], part[low]), [], [], None
                if kind[low] == 0:
                    ids.append(vec_id[low:high])
                    vectors.append(vec[low:high])
                    continue
                if not ids:
                    continue
                if built is None:
                    built = index(np.concatenate(ids), np.concatenate(vectors))
                for i in range(low, high):
                    best, scores = search(built, int(vec_id[i]), vec[i], float(bound[i]))
                    found[0].extend([int(vec_id[i])] * len(best))
                    found[1].extend(best)
                    found[2].extend(scores)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, HITS)


def best_of(hits: DataFrame, k: int, largest: bool) -> DataFrame:
    """The ``k`` best hits of each query with their ``rank``, ties to the smaller id."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc() if largest else F.col("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Best:
    """The k best (score, id) of one search, lower scores first."""

    __slots__ = ("k", "scores", "ids")

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
        if len(scores) > self.k:
            order = np.lexsort((ids, scores))[: self.k]
            scores, ids = scores[order], ids[order]
        self.scores, self.ids = scores, ids

    def worst(self) -> float:
        return float(self.scores.max()) if len(self.scores) == self.k else math.inf
