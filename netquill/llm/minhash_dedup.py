"""Near-duplicate groups by one-permutation MinHash with optimal densification, banding and star-shaped candidate edges.

1. Each text becomes its set of distinct five-word shingles (64-bit hashes). Documents with equal sets form one class, so
   exact copies never meet each other again.
2. One permutation of the shingles is cut into ``rows * bands`` bins; an empty bin copies the first occupied bin in a fixed
   random order of bins of its own (optimal densification), which keeps the collision probability at the Jaccard similarity.
3. Classes that share a band bucket are linked to one centre, the smallest class of all their buckets: one edge per class.
4. Edges are confirmed on full sets and closed into components. What is left, bucket mates that are still in different
   components, is confirmed too, so that no bucket pair is skipped: directly in buckets of up to ``SMALL`` classes; classes
   of larger ones meet only on shingles early in a rare-first order (a pair at the threshold shares one of the first quarter,
   and its first shared one leaves enough shingles behind it on both sides), so that the many that fit nothing don't meet.
   Both kinds must pass a comparison of parity bitmaps: two sets that differ in d shingles differ in d bits at most.
   Before pairs of large buckets are made, their classes are linked to centres of the smaller buckets that two bands make
   together, in turns: most of a dense group becomes one component by a few edges for each class, and its pairs are never made.
   Candidates are confirmed in turns: a few of each class, whose links join most classes of a dense group, so that the pairs
   inside a component need no look at their sets any more; then more of each, and at last all that are left.

At the threshold of 0.75, 5 rows and 50 bands miss a pair with a probability of 1.3e-6.

Cases: null or empty text and text without words has an empty set, links with nothing and is its own component; fewer than
five words make one shingle of the whole sequence; rows with a null ``doc_id`` link with nothing and have a null component
and are kept; rows repeating a ``doc_id`` are returned each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquill.llm.common import U64, documents_of, hashed_words, list_array, materialize, mix64, text_chunks
from netquill.llm.components import connected_components

SMALL = 16
#: Counters of the rare-first order, a power of two: 8 bytes each in a Python worker. The result doesn't depend on their number;
#: more of them order the shingles of a larger corpus better and so save candidates.
SLOTS = 1 << 18
CHUNK_SHINGLES = 1 << 20
#: Candidates of a class that are confirmed in each turn before the last.
TURNS = (4, 24)
#: Turns in which the classes of large buckets are linked to centres of the buckets of two bands, and such buckets of a class.
STAR_TURNS, DOUBLE_BANDS = 1, 16
EMPTY = np.iinfo(U64).max
BITS = 512  # of a set's parity bitmap


def shingle_sets(texts: list[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one per text and one more) and the distinct shingle hashes of each text, ascending."""
    hashes, firsts, *_ = hashed_words(texts)
    counts = np.diff(firsts)
    n = len(hashes)
    last = np.maximum(n - words + 1, 0)
    full = np.zeros(last, U64)
    for i in range(words):
        full = mix64(full + hashes[i : i + last] * U64(2 * i + 3))
    doc = np.repeat(np.arange(len(texts)), counts)
    whole = np.flatnonzero(doc[:last] == doc[words - 1 :][:last]) if last else np.zeros(0, np.int64)
    docs, values = [doc[whole]], [full[whole]]
    for d in np.flatnonzero((counts > 0) & (counts < words)):
        one = np.zeros(1, U64)
        for i in range(counts[d]):
            one = mix64(one + hashes[firsts[d] + i :][:1] * U64(2 * i + 3))
        docs.append(np.array([d]))
        values.append(mix64(one + U64(counts[d])))
    doc, value = np.concatenate(docs), np.concatenate(values)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return np.searchsorted(doc, np.arange(len(texts) + 1)), value


_orders: dict[int, np.ndarray] = {}


def _bin_orders(bins: int) -> np.ndarray:
    """For each bin a fixed random order of all bins."""
    if bins not in _orders:
        rank = mix64(np.arange(bins * bins, dtype=U64) + U64(0x5851F42D4C957F2D)).reshape(bins, bins)
        _orders[bins] = np.argsort(rank, axis=1)
    return _orders[bins]


def signatures(offsets: np.ndarray, values: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation minima per bin, densified. Rows of empty sets hold EMPTY."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    permuted = mix64(values ^ U64(0x2545F4914F6CDD1D))
    cell = doc * bins + (permuted % U64(bins)).astype(np.int64)
    order = np.lexsort((permuted, cell))
    cell, permuted = cell[order], permuted[order]
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    minima = np.full(n * bins, EMPTY, U64)
    minima[cell[first]] = permuted[first]
    minima = minima.reshape(n, bins)
    filled, turns = minima.copy(), _bin_orders(bins)
    row, column = np.nonzero((minima == EMPTY) & (np.diff(offsets) > 0)[:, None])
    for turn in range(bins):
        if not len(row):
            break
        got = minima[row, turns[column, turn]]
        found = got != EMPTY
        filled[row[found], column[found]] = got[found]
        row, column = row[~found], column[~found]
    return filled


def band_keys(signature: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """A 64-bit bucket key for each text and band."""
    keys = np.tile(np.arange(1, bands + 1, dtype=U64), (len(signature), 1))
    cut = signature.reshape(len(signature), bands, rows)
    for i in range(rows):
        keys = mix64(keys + cut[:, :, i])
    return keys.view(np.int64)


def _sketches(docs: DataFrame, words: int, rows: int, bands: int) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            offsets, values = shingle_sets(texts, words)
            sizes = np.diff(offsets)
            total = np.concatenate((np.zeros((2, 1), U64), np.cumsum([values, mix64(values)], axis=1, dtype=U64)), axis=1)
            low, high = (mix64(x[offsets[1:]] - x[offsets[:-1]]).view(np.int64) for x in total)
            keys = band_keys(signatures(offsets, values, rows * bands), rows, bands)
            some = np.where(sizes > 0, bands, 0)
            flat = keys[sizes > 0].reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(low), pa.array(high), list_array(np.concatenate(([0], np.cumsum(some))), flat)],
                names=["doc_id", "n_shingles", "set_lo", "set_hi", "keys"],
            )

    return docs.mapInArrow(sketch, "doc_id long, n_shingles long, set_lo long, set_hi long, keys array<long>")


def parity_bitmaps(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each set ``BITS`` bits as 64-bit numbers: whether an odd number of its shingles has that bit."""
    sets = len(offsets) - 1
    bit = (mix64(values) % U64(BITS)).astype(np.int64) + np.repeat(np.arange(sets), np.diff(offsets)) * BITS
    odd = np.bincount(bit, minlength=sets * BITS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(sets, BITS), axis=1).view(np.int64)


def _differ(x: str, y: str):
    """Bits in which two bitmaps differ."""
    return sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(BITS // 64)), F.lit(0))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            offsets, values = shingle_sets(texts, words)
            bits = parity_bitmaps(offsets, values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), list_array(offsets, values.view(np.int64)), list_array(np.arange(len(texts) + 1) * bits.shape[1], bits.reshape(-1))], names=["rep", "shingles", "bits"]
            )

    return docs.mapInArrow(sets, "rep long, shingles array<long>, bits array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets satisfy 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("b_set")), "b").join(
        sets.select(F.col("rep").alias("a"), F.col("shingles").alias("a_set")), "a"
    )
    meet = F.size(F.array_intersect("a_set", "b_set"))
    return both.where(100 * meet >= percent * (F.size("a_set") + F.size("b_set") - meet)).select("a", "b")


def bucket_pairs(open_: DataFrame, percent: int) -> DataFrame:
    """Pairs of bucket mates in different components whose sizes and bitmaps allow the threshold."""
    x, y = (open_.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("rep", "n_shingles", "component", "bits"))) for s in "xy")
    return (
        x.join(y, "key")
        .where("component_x < component_y")
        .where(100 * F.least("n_shingles_x", "n_shingles_y") >= percent * F.greatest("n_shingles_x", "n_shingles_y"))
        .where((100 + percent) * _differ("bits_x", "bits_y") <= (100 - percent) * (F.col("n_shingles_x") + F.col("n_shingles_y")))
        .select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b"))
    )


def slot_holders(sets: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """Holders counted over hash slots of the shingles, first inside each task: ``slots`` numbers, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders = np.zeros(slots, np.int64)
        for batch in batches:
            values = batch.column(0).flatten().to_numpy()
            for start in range(0, len(values), CHUNK_SHINGLES):
                holders += np.bincount(values[start : start + CHUNK_SHINGLES] & (slots - 1), minlength=slots)
        held = np.flatnonzero(holders)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(holders[held])], names=["slot", "n"])

    got = sets.select("shingles").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    holders = np.zeros(slots, np.int64)
    holders[got["slot"].to_numpy()] = got["n"].to_numpy()
    return holders


def prefixes(sets: DataFrame, holders: np.ndarray, percent: int) -> DataFrame:
    """``rep, component, size, place, shingle, bits``: the first places of each set in the order of (holders of the slot, shingle).

    The order is one for all sets, which is all that the prefix bound asks; how well slots tell rare shingles from frequent
    ones decides the number of candidates alone.
    """
    table = sets.sparkSession.sparkContext.broadcast(holders)

    def early(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = table.value
        for batch in batches:
            ends = np.cumsum(batch.column(3).value_lengths().to_numpy(zero_copy_only=False))
            start = 0
            while start < len(ends):
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + CHUNK_SHINGLES, "right")))
                part = batch.slice(start, stop - start)
                values, sizes = part.column(3).flatten().to_numpy(), np.diff(ends[start:stop], prepend=before)
                row = np.repeat(np.arange(len(sizes)), sizes)
                values = values[np.lexsort((values, counts[values & (len(counts) - 1)], row))]
                place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
                kept = np.flatnonzero(100 * (sizes[row] - place + 1) >= percent * sizes[row])
                owner = pa.array(row[kept])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i).take(owner) for i in range(3)), *(pa.array(x) for x in (sizes[row[kept]], place[kept], values[kept]))],
                    names=["rep", "component", "bits", "size", "place", "shingle"],
                )
                start = stop

    return sets.select("rep", "component", "bits", "shingles").mapInArrow(early, "rep long, component long, bits array<long>, size long, place long, shingle long")


def _fits(x: str, y: str, percent: int):
    """Whether two prefix rows of one shingle can be a pair at the threshold, by their places, sizes and bitmaps."""
    sizes = F.col(f"size_{x}") + F.col(f"size_{y}")
    behind = F.least(F.col(f"size_{x}") - F.col(f"place_{x}"), F.col(f"size_{y}") - F.col(f"place_{y}")) + 1
    return ((100 + percent) * behind >= percent * sizes) & ((100 + percent) * _differ(f"bits_{x}", f"bits_{y}") <= (100 - percent) * sizes)


def _named(prefix: DataFrame, side: str, *more: str) -> DataFrame:
    return prefix.select("shingle", *more, *(F.col(c).alias(f"{c}_{side}") for c in ("rep", "component", "size", "place", "bits")))


def _mixed(prefix: DataFrame) -> DataFrame:
    """``shingle, main`` of the shingles that several components hold; ``main`` holds it most often."""
    kinds = prefix.groupBy("shingle", "component").agg(F.count("*").alias("n")).groupBy("shingle")
    found = kinds.agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("kinds"))
    return found.where("kinds > 1").select("shingle", "main")


def band_stars(crowded: DataFrame, percent: int, bands: int, turn: int) -> DataFrame:
    """Pairs of each class with the centres of buckets that two bands make together: ``DOUBLE_BANDS`` at most for each class.

    Such buckets hold fewer and more alike classes than those of one band; each turn joins the bands at another distance.
    """
    two = F.transform(F.sequence(F.lit(0), F.lit(min(bands, DOUBLE_BANDS) - 1)), lambda i: F.xxhash64(i, F.col("keys")[i], F.col("keys")[(i + turn + 1) % bands]))
    met = crowded.select("rep", "component", "size", "bits", F.explode(F.array_distinct(two)).alias("key"))
    least = F.min(F.struct(F.xxhash64(F.lit(turn), "rep").alias("at"), "rep", "component", "size", "bits")).alias("c")
    centres = met.groupBy("key").agg(least, F.count("*").alias("n")).where("n > 1").select("key", *(F.col(f"c.{c}").alias(f"{c}_y") for c in ("rep", "component", "size", "bits")))
    both = met.join(centres, "key").where("component <> component_y")
    both = both.where((100 + percent) * _differ("bits", "bits_y") <= (100 - percent) * (F.col("size") + F.col("size_y")))
    return both.select(F.least("rep", "rep_y").alias("a"), F.greatest("rep", "rep_y").alias("b")).distinct()


def prefix_pairs(prefix: DataFrame, percent: int) -> DataFrame:
    """All pairs of prefix rows in different components that can reach the threshold, by prefix and position in a rare-first order
    and by their bitmaps.

    Of the classes that share a shingle those of its most frequent component meet the others only.
    """
    met = prefix.join(_mixed(prefix), "shingle")
    x, y = _named(met, "x", "main"), _named(met, "y")
    return (
        x.where("component_x <> main")
        .join(y, "shingle")
        .where("component_x < component_y or (component_y = main and component_x <> component_y)")
        .where(_fits("x", "y", percent))
        .select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b"))
    )


def relabelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of classes with the components they have by now."""
    return rows.drop("component").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def close_pairs(pairs: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The components ``found`` joined by the pairs that are confirmed. A pair whose classes are in one component already is left out."""
    rest = materialize(pairs, "minhash-candidates")
    turn = Window.partitionBy("a").orderBy(F.xxhash64("a", "b"), "b")
    for most in (*TURNS, None):
        chosen = rest
        if most:
            chosen = materialize(rest.withColumn("n", F.row_number().over(turn)).where(F.col("n") <= most).drop("n"), "minhash-turn")
        found = connected_components(materialize(confirm(chosen, sets, percent), "minhash-links"), "a", "b", found)
        if not most:
            return found
        at = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
        left = rest.join(chosen, ["a", "b"], "left_anti").join(at("a"), "a", "left").join(at("b"), "b", "left")
        apart = F.coalesce("of_a", "a") != F.coalesce("of_b", "b")
        rest = materialize(left.where(apart).select("a", "b"), "minhash-candidates")
        if rest.isEmpty():
            return found


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, rows: int = 5, bands: int = 50, slots: int = SLOTS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row per document."""
    docs = documents_of(docs, "doc_id", "text")
    every = materialize(_sketches(docs, words, rows, bands), "minhash-sketches")
    sketches = every.where("doc_id is not null")
    classes = sketches.where("n_shingles > 0").groupBy("set_lo", "set_hi").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "minhash-classes")

    chosen = sketches.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id")
    members = chosen.select(F.col("doc_id").alias("rep"), "n_shingles", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most")
    shared = materialize(members.join(buckets.select("key", "least"), "key").dropDuplicates(["key", "rep"]), "minhash-buckets")

    wanted = shared.select("rep").distinct()
    texts = docs.join(wanted, docs["doc_id"] == wanted["rep"], "left_semi").dropDuplicates(["doc_id"])
    sets = materialize(_sets(texts, words), "minhash-sets")

    star = shared.groupBy("rep").agg(F.min("least").alias("a")).where("a < rep").select("a", F.col("rep").alias("b"))
    links = materialize(confirm(star, sets, percent), "minhash-links")
    found = connected_components(links, "a", "b")

    labelled = shared.join(found, shared["rep"] == found["node"], "left").select(
        "key", "rep", "n_shingles", F.coalesce("component", "rep").alias("component")
    )
    labelled = materialize(labelled, "minhash-labelled")
    mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    marked = labelled.join(mixed.select("key", "n"), "key").join(sets.select("rep", "bits"), "rep")
    open_ = materialize(marked, "minhash-open")
    crowded = open_.where(F.col("n") > SMALL).select("rep", "component").distinct()
    keyed = crowded.join(chosen.select(F.col("doc_id").alias("rep"), "keys", F.col("n_shingles").alias("size")).dropDuplicates(["rep"]), "rep")
    keyed = materialize(keyed.join(sets.select("rep", "bits"), "rep"), "minhash-crowded")
    for turn in range(STAR_TURNS):
        new = materialize(confirm(band_stars(relabelled(keyed, found), percent, bands, turn), sets, percent), "minhash-links")
        if new.isEmpty():
            break
        found = connected_components(new, "a", "b", found)
    own = sets.join(relabelled(crowded, found), "rep")
    prefix = materialize(prefixes(own, slot_holders(own, slots), percent), "minhash-prefixes")
    near = relabelled(open_.where(F.col("n") <= SMALL), found)
    rest = bucket_pairs(near, percent).unionByName(prefix_pairs(prefix, percent)).distinct()
    found = close_pairs(rest, found, sets, percent)

    labels = classes.join(found, classes["rep"] == found["node"], "left").select(
        "set_lo", "set_hi", F.coalesce("component", "rep").alias("component")
    )
    named = sketches.join(labels, ["set_lo", "set_hi"], "left").select(
        "doc_id", "n_shingles", F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), "doc_id").alias("component_id")
    )
    nameless = every.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return named.unionByName(nameless).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
