"""Approximate nearest neighbours by stable projections, a kd-tree over them, and a chi-square stopping test.

Vectors are projected to ``PROJECTED`` dimensions by a fixed Gaussian matrix (a 2-stable distribution): a projected distance
pi between points at distance d makes pi^2 / d^2 chi-square distributed. The top of the kd-tree is split at the medians of a
bounded sample; below it stand pages, each a kd-tree over its rows. A query takes leaves in the order of their projected
distance and verifies rows on the original vectors, until chi2(pi^2 / d_k^2) reaches ``CONFIDENCE``: a true neighbour that
isn't found by then would have had to project beyond pi, which happens with a probability of 1 - CONFIDENCE at most. A first
visit to one page of the query's own cell gives it the d_k with which it enters all other cells within reach.

Cases: those of ``vectors_of``, zero vectors left out; ties go to the smaller id; a query with fewer candidates gets all it
can find, that is all; candidates with the query's own id are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.llm.paged_search import MAX_CELLS, PAGE_ROWS, Best, best_of, paged, sample_of, search_pages, vectors_of, visits, with_cells

PROJECTED = 8
CONFIDENCE = 0.95
LEAF = 32


def chi_square_cdf(x: float, degrees: int) -> float:
    """For an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def stop_ratio(degrees: int, confidence: float) -> float:
    """pi^2 / d_k^2 from which the stopping test holds."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, degrees) < confidence else (low, mid)
    return high


def projection(width: int) -> np.ndarray:
    return np.random.default_rng(11).normal(size=(width, PROJECTED))


class Tree:
    """A kd-tree in arrays: leaves with their boxes, split at medians of the widest side."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.leaves: list[np.ndarray] = []
        waiting = [np.arange(len(points))]
        while waiting:
            rows = waiting.pop()
            spread = np.ptp(points[rows], axis=0)
            if len(rows) <= leaf or not spread.any():
                self.leaves += np.array_split(rows, math.ceil(len(rows) / leaf)) if len(rows) > leaf else [rows]
                continue
            side = points[rows, spread.argmax()]
            order = np.argsort(side, kind="stable")
            waiting += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
        self.low = np.stack([points[r].min(0) for r in self.leaves])
        self.high = np.stack([points[r].max(0) for r in self.leaves])


def box_distance(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances from a point to boxes."""
    return (np.maximum(np.maximum(low - point, point - high), 0) ** 2).sum(-1)


def nearest(table: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each row for which ``is_query`` holds."""
    vectors = vectors_of(table, drop_zero=True)
    sample = sample_of(vectors)
    if not len(sample):
        return vectors.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    n = vectors.count()
    axes, ratio = projection(sample.shape[1]), stop_ratio(PROJECTED, CONFIDENCE)
    splits: list = []  # (axis, value, left, right) or a cell's number
    boxes: list[tuple[np.ndarray, np.ndarray]] = []

    def split(points: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> int:
        at = len(splits)
        spread = np.ptp(points, axis=0) if len(points) else np.zeros(PROJECTED)
        if depth == 0 or len(points) < 2 or not spread.any():
            splits.append(len(boxes))
            boxes.append((low, high))
            return at
        axis = int(spread.argmax())
        value = float(np.median(points[:, axis]))
        splits.append(None)
        below, above = high.copy(), low.copy()
        below[axis] = above[axis] = value
        left = split(points[points[:, axis] < value], low, below, depth - 1)
        right = split(points[points[:, axis] >= value], above, high, depth - 1)
        splits[at] = (axis, value, left, right)
        return at

    depth = min(int(math.log2(MAX_CELLS)), max(0, math.ceil(math.log2(n / PAGE_ROWS)) if n > PAGE_ROWS else 0))
    split(sample @ axes, np.full(PROJECTED, -np.inf), np.full(PROJECTED, np.inf), depth)
    box_low, box_high = (np.stack(x) for x in zip(*boxes))

    def cells(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, out = points @ axes, np.zeros(len(points), np.int64)
        waiting = [(0, np.arange(len(points)))]
        while waiting:
            at, rows = waiting.pop()
            if isinstance(splits[at], int):
                out[rows] = splits[at]
            else:
                axis, value, left, right = splits[at]
                less = flat[rows, axis] < value
                waiting += [(left, rows[less]), (right, rows[~less])]
        return out, np.zeros(len(points))

    dealt = with_cells(vectors, cells)
    counts = {r["cell"]: r["count"] for r in dealt.groupBy("cell").count().collect()}  # a row for each cell
    own = np.array(sorted(counts), np.int64)

    def at_home(ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        return [own[[box_distance(box_low[own], box_high[own], q).argmin()]] for q in queries @ axes]

    def within(ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        return [own[box_distance(box_low[own], box_high[own], q) <= ratio * b * b] for q, b in zip(queries @ axes, bounds)]

    def index(ids: np.ndarray, points: np.ndarray) -> tuple:
        flat = points @ axes
        return ids, points, flat, Tree(flat, LEAF)

    def answer(built: tuple, query_id: int, query: np.ndarray, bound: float) -> tuple[list[int], list[float]]:
        ids, points, flat, tree = built
        own_flat, best = query @ axes, Best(k)
        order = box_distance(tree.low, tree.high, own_flat)
        heap = list(zip(order.tolist(), range(len(order))))
        heapq.heapify(heap)
        while heap:
            near, leaf = heapq.heappop(heap)
            radius = min(best.worst(), bound)
            if near > ratio * radius * radius:  # the chi-square test holds for this leaf and all after it
                break
            rows = tree.leaves[leaf]
            rows = rows[((flat[rows] - own_flat) ** 2).sum(1) <= ratio * radius * radius]
            rows = rows[ids[rows] != query_id]
            distance = np.sqrt(((points[rows] - query) ** 2).sum(1))
            keep = distance <= radius
            best.add(distance[keep], ids[rows][keep])
        return best.ids.tolist(), best.scores.tolist()

    candidates = paged(dealt, counts)
    queries = vectors.where(is_query).withColumn("bound", F.lit(math.inf))
    first = best_of(search_pages(candidates, visits(queries, counts, at_home, home=True), index, answer), k, largest=False)
    bounds = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("known"))
    bounded = queries.join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("known", "bound"))
    hits = search_pages(candidates, visits(bounded, counts, within, home=False), index, answer)
    hits = hits.unionByName(first.drop("rank")).distinct()  # with the bound known, the test may leave out what the first visit found
    return best_of(hits, k, largest=False).select("query_id", "rank", "vec_id", "score")
