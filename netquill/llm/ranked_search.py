"""Ranked lexical search without random access (NRA): impact-sorted lists are read in step, with an interval for each score.

1. One pass over the texts counts every document's terms and keeps the frequencies of the terms that some item asks for
   (64-bit hashes, confirmed by a second hash); a written table holds one row per document.
2. N, L and the document frequencies follow from that table; a term's weight is fixed then.
3. Documents are dealt into shards of at most ``shard`` postings. A task sorts a shard's postings by term and falling impact and
   reads each item's lists block by block. A document's lower bound is the sum of what was read; its upper bound adds, for each
   list in which it hasn't been seen, the largest impact not read yet. Reading goes on until no unseen document can reach the
   k-th lower bound, and until the intervals of all that can reach it have closed: members, ties and scores are exact then. A
   list that all of these have been seen in is not read further.
4. Shards are searched in two turns. The k-th best score of the first turn bounds each item's k-th best score from below, so in
   the second a shard stops as soon as nothing in it can reach that. The shards' best are ranked in two steps.

Items are taken in blocks that hold about ``ITEM_TERMS`` pairs of item and term; a task holds one block's terms.

Cases: a null text has no terms; items without terms have no rows; rows with one ``item_id`` are one item with the terms of
all; items without an id are left out; every row of documents is a document of its own (repeated ids are ranked each, in an
order of their own), and rows with a null ``doc_id`` count in N, L and df but aren't returned; equal scores go by ``doc_id``;
empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquill.llm.common import U64, documents_of, hashed_words, materialize, mix64, text_chunks

#: Bytes that belong to no term: all of ASCII but digits and letters.
BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Pairs of item and term in a block of items, about.
ITEM_TERMS = 1 << 20
#: One of so many documents is searched in the first turn.
FIRST_TURN = 8
HITS = "item_id long, doc_id long, score long, uid long"


def _second(starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges by other rules than ``hashed_words``: sums of mixed (place, byte)."""
    sizes = ends - starts
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    mixed = mix64(data[np.repeat(starts, sizes) + place].astype(U64) + (place.astype(U64) + U64(1) << U64(8)))
    total = np.concatenate((np.zeros(1, U64), np.cumsum(mixed)))
    last = np.cumsum(sizes)
    return total[last] - total[last - sizes]


def _terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    hashes, firsts, starts, ends, joined = hashed_words(texts, between=BETWEEN)
    return hashes, firsts, starts, ends, np.frombuffer(joined, np.uint8)


def item_terms(items: DataFrame) -> DataFrame:
    """The distinct ``item_id, h1, h2`` of the items' terms."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            hashes, firsts, starts, ends, data = _terms(texts)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            made = (np.repeat(ids, np.diff(firsts)).astype(np.int64), hashes.view(np.int64), _second(starts, ends, data).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["item_id", "h1", "h2"])

    given = documents_of(items, "item_id", "text").where("item_id is not null")
    return given.select(F.col("item_id").cast("long"), "text").mapInArrow(cut, "item_id long, h1 long, h2 long").distinct()


def postings(docs: DataFrame, h1: np.ndarray, h2: np.ndarray) -> DataFrame:
    """A row for each document with terms: ``uid, doc_id, n`` and the frequencies ``tf`` of the asked ``terms`` (places in h1, sorted)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for batch, texts in text_chunks(batches):
            hashes, firsts, starts, ends, data = _terms(texts)
            n = np.diff(firsts)
            place = np.minimum(np.searchsorted(h1, hashes), max(len(h1) - 1, 0))
            asked = np.flatnonzero(h1[place] == hashes) if len(h1) else np.zeros(0, np.int64)
            asked = asked[_second(starts[asked], ends[asked], data) == h2[place[asked]]]
            row = np.repeat(np.arange(len(n)), n)[asked]
            pair, tf = np.unique(row * max(len(h1), 1) + place[asked], return_counts=True)
            held = np.searchsorted(pair, np.arange(len(n) + 1) * max(len(h1), 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(held), pa.array(x.astype(np.int32))) for x in (pair % max(len(h1), 1), tf)]
            made = pa.RecordBatch.from_arrays([pa.array(uid + np.arange(len(n))), batch.column(0), pa.array(n.astype(np.int64)), *lists], names=["uid", "doc_id", "n", "terms", "tf"])
            uid += len(n)
            yield made.filter(pa.array(n > 0))

    given = documents_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return materialize(given.mapInArrow(count, "uid long, doc_id long, n long, terms array<int>, tf array<int>"), "postings")


class Shard:
    """The impact-sorted lists of some documents."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int):
        exact = n if not len(n) or 50 * int(n.max()) * n_docs < 1 << 63 else n.astype(object)
        m = (50 + 50 * exact * n_docs // n_terms).astype(np.int64)
        row = np.repeat(np.arange(len(n), dtype=np.int32), sizes)
        impact = 1_000_000_000 * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 20 * m[row])
        order = np.lexsort((-impact, terms))
        self.rows, self.impacts, self.size = row[order], impact[order], len(n)
        self.terms, self.starts = np.unique(terms[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(terms))

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of all documents that can be among an item's k best and score ``floor`` (over 0) or more."""
        place = np.searchsorted(self.terms, terms)
        there = np.flatnonzero(self.terms[np.minimum(place, len(self.terms) - 1)] == terms) if len(self.terms) else place[:0]
        lists = [(int(self.starts[p]), int(self.ends[p]), int(w)) for p, w in zip(place[there], weights[there])]
        lower = np.zeros(self.size, np.int64)
        read = [start for start, _, _ in lists]
        able, closed = None, False  # documents that can be members; whether unseen ones can't
        while True:
            unread = [w * int(self.impacts[at]) if at < end else 0 for at, (_, end, w) in zip(read, lists)]
            total = sum(unread)  # the upper bound of a document not seen in any list
            if any(at > start for at, (start, _, _) in zip(read, lists)) or not lists:
                kth = int(np.partition(lower, -k)[-k]) if self.size >= k else 0
                bar = max(kth, floor)
                missing = np.full(self.size, total, np.int64)
                seen = {}
                for i, (start, _, _) in enumerate(lists):
                    if unread[i]:
                        seen[i] = self.rows[start : read[i]]
                        missing[seen[i]] -= unread[i]
                closed = closed or total < bar
                able = np.flatnonzero((lower + missing >= bar) & (lower + missing > 0))
                if closed and not missing[able].any():
                    return able, lower[able]
                among = np.zeros(self.size, bool)
                among[able] = True
                if closed:  # lists in which all of these have been seen need no more reading, nor do others when none is left
                    skip = {i for i, rows in seen.items() if np.count_nonzero(among[rows]) == len(able)}
                else:
                    skip = set()
            else:
                skip = set()
            if total == 0:
                return able, lower[able]
            for i, (start, end, w) in enumerate(lists):
                if unread[i] and i not in skip:
                    stop = min(end, read[i] + block)
                    lower[self.rows[read[i] : stop]] += w * self.impacts[read[i] : stop]
                    read[i] = stop
            block *= 4


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Tables of at most ``limit`` postings (or one document)."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(np.diff(batch.column(batch.schema.get_field_index("terms")).offsets.to_numpy()))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = int(np.searchsorted(ends, before + limit - size, side="right"))
            stop = max(stop, start + (not held)) if stop <= start else stop
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1]) - before
                start = stop
            if start < batch.num_rows or size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _search(rows: DataFrame, asked: list[tuple[int, np.ndarray, np.ndarray]], floors: dict[int, int], k: int, shard: int, n_docs: int, n_terms: int) -> DataFrame:
    """Each shard's best for each item: ``item_id, doc_id, score, uid``."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _shards(batches, shard):
            table = table.combine_chunks()
            terms, tf = (table.column(c).combine_chunks() for c in ("terms", "tf"))
            sizes = np.diff(terms.offsets.to_numpy())
            lists = Shard(table.column("n").to_numpy(), sizes, terms.flatten().to_numpy(), tf.flatten().to_numpy(), n_docs, n_terms)
            doc_ids, uids = table.column("doc_id").to_numpy(), table.column("uid").to_numpy()
            for item, codes, weights in asked:
                found, scores = lists.best(codes, weights, k, floors.get(item, 1))
                top = np.lexsort((uids[found], doc_ids[found], -scores))[:k]
                found, scores = found[top], scores[top]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), item)), pa.array(doc_ids[found]), pa.array(scores), pa.array(uids[found])], names=["item_id", "doc_id", "score", "uid"])

    return rows.where("doc_id is not null and size(terms) > 0").mapInArrow(search, HITS)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each item, first among parts of the hits, then over all."""
    order = [F.desc("score"), "doc_id", "uid"]
    part = F.pmod(F.shiftright("uid", 40), F.lit(64)).alias("part")
    some = hits.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k).drop("part")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, shard: int = 1 << 20) -> DataFrame:
    """``item_id, rank, doc_id, score`` of each item's ``k`` best documents with a score above 0. A task holds ``shard`` postings at once."""
    pairs = materialize(item_terms(items), "item-terms")
    blocks = max(1, math.ceil(2 * pairs.count() / ITEM_TERMS))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    found = [_block(docs, pairs.where(F.col("block") == b), k, shard) for b in range(blocks)]
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def _block(docs: DataFrame, pairs: DataFrame, k: int, shard: int) -> DataFrame:
    asked = pairs.select("item_id", "h1", "h2").toArrow()  # about ITEM_TERMS rows at most
    keys = np.stack([asked.column(c).to_numpy().view(U64) for c in ("h1", "h2")], axis=1) if asked.num_rows else np.zeros((0, 2), U64)
    distinct, code = np.unique(keys, axis=0, return_inverse=True)
    index = postings(docs, distinct[:, 0].copy(), distinct[:, 1].copy())
    total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs, n_terms = int(total[0]), int(total[1])
    held = dict(map(tuple, index.select(F.explode("terms").alias("term")).groupBy("term").count().collect()))  # a row for each asked term
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held.get(t, 0) + 1))) for t in range(len(distinct))], np.int64)
    ids = asked.column("item_id").to_numpy()
    order = np.lexsort((code.ravel(), ids))
    ids, codes = ids[order], code.ravel()[order].astype(np.int32)
    starts = np.flatnonzero(np.concatenate((np.ones(min(len(ids), 1), bool), ids[1:] != ids[:-1])))
    items = [(int(ids[a]), codes[a:b], weight[codes[a:b]]) for a, b in zip(starts, np.append(starts[1:], len(ids)))]

    first = F.pmod(F.xxhash64("uid"), F.lit(FIRST_TURN)) == 0
    early = materialize(_ranked(_search(index.where(first), items, {}, k, shard, n_docs, n_terms), k), "search-first")
    floors = dict(map(tuple, early.where(F.col("rank") == k).select("item_id", "score").collect()))  # a row for each item
    late = _search(index.where(~first), items, floors, k, shard, n_docs, n_terms)
    return _ranked(early.drop("rank").unionByName(late), k).select("item_id", F.col("rank").cast("int"), "doc_id", "score")
