"""Exact top-k inner product search with an M-tree.

The inner product becomes a metric: candidates get one more component that brings them all to the greatest norm R, queries a
zero, so that distance^2 = |q|^2 + R^2 - 2 <q, c> falls as the inner product grows. The tree's root is a bounded set of routing
objects with covering radii over all rows; below it stand pages, each a bulk-loaded M-tree whose nodes keep covering radii and
the distances of their entries from their own routing object. Search is best-first: nodes by lower bound; an entry is skipped
without computing its distance where the stored parent distance already puts it out of reach. Every query first visits one
page of its nearest routing object, which gives it a bound, then all pages under routing objects within the bound.

Components are floor(256 * x). Scores are exact while every inner product stays below 2^53.

Cases: those of ``vectors_of``; ties go to the smaller id; a query with fewer candidates gets all; candidates with the
query's own id are left out; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.llm.paged_search import MAX_CELLS, PAGE_ROWS, Best, best_of, paged, sample_of, search_pages, vectors_of, visits, with_cells

FANOUT, LEAF = 16, 256  # entries of an inner node, rows of a leaf
SLACK = 1e-9  # of R^2: keeps rounding from closing a node that holds an equal score


def lifted(vectors: np.ndarray, square: float) -> np.ndarray:
    return np.column_stack((vectors, np.sqrt(np.maximum(square - (vectors**2).sum(1), 0))))


class Node:
    __slots__ = ("objects", "parent", "radius", "children", "ids")

    def __init__(self, objects, parent, radius=None, children=None, ids=None):
        self.objects, self.parent, self.radius, self.children, self.ids = objects, parent, radius, children, ids


def build(points: np.ndarray, ids: np.ndarray, above: np.ndarray | None = None) -> Node:
    """A bulk-loaded M-tree node over ``points``; ``above`` is the routing object it hangs from."""
    distance = np.zeros(len(points)) if above is None else np.sqrt(((points - above) ** 2).sum(1))
    if len(points) <= LEAF:
        return Node(points, distance, ids=ids)
    chosen = np.linspace(0, len(points) - 1, min(FANOUT, math.ceil(2 * len(points) / LEAF))).astype(int)
    norm = (points**2).sum(1)
    near = (norm[:, None] + norm[chosen][None, :] - 2 * points @ points[chosen].T).argmin(1)
    groups = [np.flatnonzero(near == g) for g in range(len(chosen))]
    groups = [g for g in groups if len(g)]
    if len(groups) == 1:  # equal points: halve them
        groups = np.array_split(groups[0], 2)
    objects = np.stack([points[g].mean(0) for g in groups])
    children = [build(points[g], ids[g], o) for g, o in zip(groups, objects)]
    radius = np.array([np.sqrt(((points[g] - o) ** 2).sum(1)).max() for g, o in zip(groups, objects)])
    parent = np.zeros(len(groups)) if above is None else np.sqrt(((objects - above) ** 2).sum(1))
    return Node(objects, parent, radius, children)


def search(root: Node, square: float, k: int, query_id: int, query: np.ndarray, bound: float) -> tuple[list[int], list[float]]:
    """Best-first search; ``bound`` is an inner product that the k-th best is known to reach."""
    top = np.append(query, 0.0)
    reach = float(query @ query) + square
    slack = SLACK * (reach + 1)
    best = Best(k)

    def limit() -> float:
        worst = min(best.worst(), -bound)
        return math.sqrt(max(reach + 2 * worst, 0) + slack) if worst < math.inf else math.inf

    heap: list = [(0.0, 0, root, None)]
    pushed = 0
    while heap:
        low, _, node, above = heapq.heappop(heap)
        far = limit()
        if low > far:
            break
        radius = node.radius if node.ids is None else 0.0
        open_ = np.arange(len(node.objects)) if above is None else np.flatnonzero(np.abs(above - node.parent) - radius <= far)
        if not len(open_):
            continue
        if node.ids is not None:
            open_ = open_[node.ids[open_] != query_id]
            scores = np.rint(node.objects[open_] @ top)
            keep = -scores <= min(best.worst(), -bound)
            best.add(-scores[keep], node.ids[open_][keep])
            continue
        distance = np.sqrt(((node.objects[open_] - top) ** 2).sum(1))
        lower = np.maximum(distance - node.radius[open_], 0)
        for i in np.flatnonzero(lower <= far):
            pushed += 1
            heapq.heappush(heap, (float(lower[i]), pushed, node.children[open_[i]], float(distance[i])))
    return best.ids.tolist(), (-best.scores).tolist()


def top_k(table: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k greatest inner products of each row for which ``is_query`` holds."""
    vectors = vectors_of(table).withColumn("vec", F.transform("vec", lambda x: F.floor(x * 256).cast("double")))
    n, square = vectors.agg(F.count("*"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))).first()
    square = square or 0.0
    routers = lifted(sample_of(vectors, min(MAX_CELLS, max(1, math.ceil(n / PAGE_ROWS)))).reshape(-1 if n else 0, 1 if not n else len(vectors.first()["vec"])), square)

    def nearest(points: np.ndarray) -> np.ndarray:
        norm = (points**2).sum(1)[:, None] + (routers**2).sum(1)[None, :] - 2 * points @ routers.T
        return np.sqrt(np.maximum(norm, 0))

    def cells(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distance = nearest(lifted(points, square))
        near = distance.argmin(1)
        return near, distance[np.arange(len(points)), near]

    dealt = with_cells(vectors, cells)
    covers = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("radius")).collect()  # a row for each routing object
    counts = {r["cell"]: r["n"] for r in covers}
    own = np.array(sorted(counts), np.int64)
    radius = np.array([next(r["radius"] for r in covers if r["cell"] == c) for c in own]) if len(own) else np.zeros(0)
    if not counts:
        return vectors.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))

    def at_home(ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        distance = nearest(np.column_stack((queries, np.zeros(len(queries)))))[:, own]
        return [own[[d.argmin()]] for d in distance]

    def within(ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        lower = nearest(np.column_stack((queries, np.zeros(len(queries)))))[:, own] - radius
        reach = (queries**2).sum(1) + square
        far = np.where(np.isfinite(bounds), np.sqrt(np.maximum(reach - 2 * bounds, 0) + SLACK * (reach + 1)) + 1e-4, np.inf)
        return [own[x <= f] for x, f in zip(lower, far)]

    def index(ids: np.ndarray, points: np.ndarray) -> Node:
        return build(lifted(points, square), ids)

    def answer(root: Node, query_id: int, query: np.ndarray, bound: float) -> tuple[list[int], list[float]]:
        return search(root, square, k, query_id, query, bound)

    candidates = paged(dealt, counts)
    queries = vectors.where(is_query).withColumn("bound", F.lit(-math.inf))
    first = best_of(search_pages(candidates, visits(queries, counts, at_home, home=True), index, answer), k, largest=True)
    bounds = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("known"))
    bounded = queries.join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("known", "bound"))
    hits = search_pages(candidates, visits(bounded, counts, within, home=False), index, answer)
    return best_of(hits, k, largest=True).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))
