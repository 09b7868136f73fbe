"""Removal of long repeated passages by a compacted de Bruijn graph over words.

The edges of the graph are all windows of ``span`` words; windows that follow each other share a node of ``span - 1`` words.

1. Edges are packed: each window belongs to the ``k``-word gram in it whose hash is least, and the windows in a row that belong
   to one gram are one path, held as its words' 128-bit hash, its length and its coordinates (document, first word). Equal
   windows have equal grams whatever stands around them, so only grams found in several documents can carry repeats.
2. A gram that has the same path wherever it occurs has no branch: its windows occur together or not at all. Paths that always
   follow each other (as many joint occurrences as either has alone) are compacted: a Spark join finds the links, and pointer
   doubling, a join and a written table for each doubling, gives every path its unitig and place. An occurrence of a unitig is one
   row, however long.
3. Grams with several paths lie at branches: there each distinct path is opened into its windows, once, and windows are compared.
4. Every repeated unitig and path is verified at its coordinates: its words in each document must have the digest of those in the
   source, the smallest document holding it. If any hash collided, all is done anew with other hashes.
5. A window that also starts in a smaller document loses its words.

Cases: a null or empty text has no words; rows with a null ``doc_id`` are returned whole and are no source; rows that repeat a
``doc_id`` are one document (they don't take words from each other) and each loses words of its own text; an empty table gives
an empty result; further columns are ignored unless kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquill.llm.common import U64, discard, documents_of, hashed_words, materialize, range_hashes, text_chunks

#: A document's row: its id and a hash that tells apart the texts of one id.
DOC = ["doc_id", "part"]
PATHS = "doc_id long, part int, first int, n int, gram long, c1 long, c2 long"
#: Low bits of a gram's hash give way to its place, which decides among equal grams of a window.
PLACE = (1 << 16) - 1
STEP = 0x9E3D
UNSTEP = pow(STEP, -1, PLACE + 1)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row."""
    step = 1
    while 2 * step <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return np.minimum(values[: len(values) - (width - step)], values[width - step :])


def _paths(words: np.ndarray, firsts: np.ndarray, span: int, k: int, seed: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, gram, hash, hash) of each path in texts given as word hashes."""
    sizes = np.diff(firsts)
    windows = np.maximum(sizes - span + 1, 0)
    if not windows.any():
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    grams = range_hashes(words, np.arange(len(words) - k + 1), np.full(len(words) - k + 1, k), 3 * seed)
    inside = np.arange(len(grams)) - np.repeat(firsts[:-1], sizes)[: len(grams)]
    least = _least((grams & ~U64(PLACE)) | (inside * STEP & PLACE).astype(U64), span - k + 1)
    doc = np.repeat(np.arange(len(sizes)), windows)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows) + firsts[doc]
    least = least[at]
    starts = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]))))
    n = np.diff(np.append(starts, len(doc)))
    at, doc, least = at[starts], doc[starts], least[starts]
    first = at - firsts[doc]
    held = [range_hashes(words, at, n + span - 1, 3 * seed + i).view(np.int64) for i in (1, 2)]
    return doc, first, n, (least & ~U64(PLACE)).view(np.int64), *held


def packed_edges(docs: DataFrame, span: int, k: int, seed: int) -> DataFrame:
    """The paths of all documents."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            words, firsts, *_ = hashed_words(texts, lower=False)
            doc, first, n, gram, c1, c2 = _paths(words, firsts, span, k, seed)
            of = [batch.column(i).take(pa.array(doc)) for i in (0, 1)]
            made = [pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(gram), pa.array(c1), pa.array(c2)]
            yield pa.RecordBatch.from_arrays([*of, *made], names=[*DOC, "first", "n", "gram", "c1", "c2"])

    return docs.where("doc_id is not null").mapInArrow(pack, PATHS)


def _unitigs(single: DataFrame) -> DataFrame:
    """Occurrences ``doc_id, part, first, n`` (windows), ``gram, lo`` of the unitigs that branchless paths make up."""
    after = single.select(*DOC, F.col("first").alias("next"), F.col("gram").alias("y"), F.col("uses").alias("uses_y"))
    follow = single.withColumn("next", F.col("first") + F.col("n")).join(after, [*DOC, "next"])
    links = follow.groupBy("gram", "y").agg(F.count("*").alias("both"), F.min("uses").alias("ux"), F.min("uses_y").alias("uy"), F.min("n").alias("n"))
    chain = materialize(links.where("both = ux and both = uy").select(F.col("y").alias("id"), F.col("gram").alias("to"), F.col("n").cast("long").alias("before")), "graph-links")
    if not chain.isEmpty():
        moved = 1
        while moved:
            on = chain.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("before").alias("more"))
            step = chain.join(on, "to", "left").select("id", F.coalesce("far", "to").alias("to"), (F.col("before") + F.coalesce("more", F.lit(0))).alias("before"), F.col("far").isNotNull().alias("moved"))
            longer = materialize(step, "graph-doubling")
            discard(chain)
            chain, moved = longer.drop("moved"), longer.where("moved").limit(1).count()
    sizes = single.groupBy(F.col("gram").alias("id")).agg(F.min("n").alias("n"))
    long = chain.join(sizes, "id").groupBy(F.col("to").alias("gram")).agg(F.max(F.col("before") + F.col("n")).alias("whole"))
    heads = single.join(chain.select(F.col("id").alias("gram")), "gram", "left_anti")
    return heads.join(long, "gram", "left").select(*DOC, "first", F.coalesce("whole", "n").cast("int").alias("n"), "gram", "lo")


def _looked_up(docs: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """For each wanted path ``(first, n, a, b, lo, hi, opened)`` its words' digest, with ``at`` null, and for opened ones those of its windows."""
    lists = wanted.groupBy(*DOC).agg(F.collect_list(F.struct("first", "n", "a", "b", "lo", "hi", "opened")).alias("wanted"))
    joined = docs.where("doc_id is not null").join(lists, DOC).select("text", "wanted")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            out = []
            for text, asked in zip(texts, batch.column(1).to_pylist()):
                words = text.split()  # bytes are split at \x20 and \x09-\x0D alone
                for x in asked:
                    start, n, rest = x["first"], x["n"], (x["a"], x["b"], x["lo"], x["hi"])
                    out.append((*rest, None, *_digest(words[start : start + n + span - 1])))
                    if x["opened"]:
                        out += [(*rest, i, *_digest(words[start + i : start + i + span])) for i in range(n)]
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "lo", "hi", "at", "d1", "d2"])

    return materialize(joined.mapInArrow(read, "a long, b long, lo long, hi long, at long, d1 long, d2 long"), "graph-read")


def _digest(words: list[bytes]) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(b" ".join(words))
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _repeats(docs: DataFrame, span: int, k: int, seed: int) -> DataFrame | None:
    """Removed windows: ``doc_id, part, first, n`` with a bit ``mask`` of those of the ``n`` windows that go (null: all); None on a collision."""
    paths = materialize(packed_edges(docs, span, k, seed), "graph-paths")
    ends = [f(c).alias(f"{name}_{c}") for c in ("c1", "c2", "n") for f, name in ((F.min, "min"), (F.max, "max"))]
    grams = paths.groupBy("gram").agg(F.count("*").alias("uses"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), *ends).where("lo < hi")
    grams = grams.select("gram", "uses", "lo", F.expr("min_c1 = max_c1 and min_c2 = max_c2 and min_n = max_n").alias("single"))
    repeated = materialize(paths.join(grams, "gram"), "graph-repeated")
    discard(paths)

    unitigs = materialize(_unitigs(repeated.where("single")), "graph-unitigs")
    forks = repeated.where("not single")
    source = F.min(F.struct(*DOC, "first"))
    classes = forks.groupBy("c1", "c2").agg(source.alias("source"), F.max("doc_id").alias("hi"), F.min("n").alias("n"))
    opened = classes.select("source.*", "n", F.col("c1").alias("a"), F.col("c2").alias("b"), F.col("source.doc_id").alias("lo"), "hi", F.lit(True).alias("opened"))
    none = F.lit(None).cast("long")
    seen = forks.select(*DOC, "first", "n", F.col("c1").alias("a"), F.col("c2").alias("b"), none.alias("lo"), none.alias("hi"), F.lit(False).alias("opened"))
    whole = unitigs.select(*DOC, "first", "n", F.col("gram").alias("a"), none.alias("b"), none.alias("lo"), none.alias("hi"), F.lit(False).alias("opened"))
    read = _looked_up(docs, opened.unionByName(seen).unionByName(whole), span)
    differ = read.where("at is null").groupBy("a", "b").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("d1", "d2") for f in (F.min, F.max)))
    if differ.where("min_d1 <> max_d1 or min_d2 <> max_d2").limit(1).count():
        discard(repeated, unitigs, read)
        return None
    windows = read.where("at is not null")
    least = windows.groupBy("d1", "d2").agg(F.min("lo").alias("least"), F.max("hi").alias("most")).where("least < most").drop("most")
    covered = windows.join(least, ["d1", "d2"]).where("least < hi").groupBy("a", "b").agg(F.collect_list(F.struct("at", "least")).alias("covered"))
    bits = F.expr("aggregate(filter(covered, x -> x.least < doc_id), 0L, (m, x) -> m | shiftleft(1L, int(x.at)))")
    some = forks.join(covered, (F.col("c1") == F.col("a")) & (F.col("c2") == F.col("b"))).select(*DOC, "first", "n", bits.alias("mask")).where("mask <> 0")
    return unitigs.where("lo < doc_id").select(*DOC, "first", "n", none.alias("mask")).unionByName(some)


def dedup_substrings(docs: DataFrame, span: int = 50, k: int = 10, keep: tuple[str, ...] = ("doc_id",), seed: int = 0) -> DataFrame:
    """The ``keep`` columns of every row with ``kept_text`` (the words that stay, joined by a space), ``n_words`` and ``n_removed``.

    ``k`` may be from 1 to ``span``, with ``span - k`` below 63.
    """
    if not (1 <= k <= span and span - k < 63):
        raise ValueError("k must be from span - 62 to span")
    given = documents_of(docs, *dict.fromkeys(("doc_id", "text", *keep)))
    texts = given.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("part"), "text")
    gone = next((found for attempt in range(seed, seed + 8) if (found := _repeats(texts, span, k, attempt)) is not None), None)
    if gone is None:
        raise RuntimeError("hashes collided under eight seeds")
    lists = gone.groupBy(F.col("doc_id").alias("__id"), F.col("part").alias("__of")).agg(F.collect_list(F.struct("first", "n", "mask")).alias("__gone"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*keep).schema]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chunk in text_chunks(batches, "__text"):
            kept, n_words, n_removed = [], [], []
            for text, gone in zip(chunk, batch.column(batch.num_columns - 1).to_pylist()):
                words = text.split()
                stays = bytearray(b"\1") * len(words)
                for x in gone or ():
                    starts = [(0, x["n"])] if x["mask"] is None else [(i, 1) for i in range(x["n"]) if x["mask"] >> i & 1]
                    for at, n in starts:
                        stays[x["first"] + at : x["first"] + at + n + span - 1] = bytes(n + span - 1)
                left = [w for w, s in zip(words, stays) if s] if gone else words
                kept.append(b" ".join(left).decode())
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
            made = [pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[*keep, "kept_text", "n_words", "n_removed"])

    rows = given.select(*keep, F.col("doc_id").cast("long").alias("__doc"), F.hash("text").alias("__part"), F.col("text").alias("__text"))
    found = rows.where("__doc is not null").join(lists, (F.col("__doc") == F.col("__id")) & (F.col("__part") == F.col("__of")), "left")
    nameless = rows.where("__doc is null").select(*keep, "__text", F.lit(None).cast(lists.schema["__gone"].dataType).alias("__gone"))
    return found.select(*keep, "__text", "__gone").unionByName(nameless).mapInArrow(cut, ", ".join([*kinds, "kept_text string, n_words long, n_removed long"]))
