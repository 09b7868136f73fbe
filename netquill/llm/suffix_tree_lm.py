"""Language-model scores from a probabilistic suffix tree over words.

States are contexts of up to ``depth`` words. A pair of a context and a next word is in the tree where it occurs ``min_count``
times, whatever the size of the corpus; a context is retained where its next-word distribution diverges from that of the
context without its first word. Distributions are smoothed towards that shorter context down to the add-one unigram of all
training tokens, and a token is scored in the longest retained suffix of what precedes it.

The tree has no bound, so it is a partitioned table of grams. A token's log probability is a sum over the grams that end at
it (what its word gains over the shorter context) and those that end before it (the escape to the shorter context), so that a
text is scored by a join of its distinct grams. The ``FREQUENT`` commonest grams of each length are looked up inside tasks;
bitmaps of fixed size spare the shuffle grams that can't be in the table, and lose none. Grams are counted and looked up in
packed blocks: each task sorts what it holds by bucket and words, so that a gram takes a few bytes on its way to the task that
adds up its bucket, or that has the bucket's part of the tree. That task holds one bucket of the tree and one block at a time.
What it finds for a block of texts goes back as one block, to the task that adds up these texts: a text meets many buckets, and a
row for each of them would be many times the texts. Blocks of texts times buckets of the tree is the number of blocks, each of
about ``FLUSH / buckets`` grams; the grams in them are at most ``depth + 1`` for each token.

Cases: null and empty texts are the end token alone; training rows are those whose crc32(doc_id) modulo ``folds`` isn't
``held_out``, null ids among them; without training rows all counts are 0 and every token's probability is 1; rows are
returned one for one, with repeated and null ids; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquill.llm.common import U64, clean_shuffles, discard, documents_of, hashed_words, materialize, mix64, mod_of_id, small_batches, text_chunks

FREQUENT = 500_000
FLUSH = 1_000_000  # distinct keys counted in a task before they are passed on
BUCKET_TOKENS = 1_000_000  # tokens for each bucket of grams; a task adds up one bucket at a time
TREE_ROWS = 500_000  # rows of the tree for each bucket that texts are looked up in; a task holds one bucket at a time
LEAST_BUCKETS = 32  # of the tree, so that all cores have some
BLOCK_TEXTS = 1 << 16  # texts in a block at most
BLOCKS = "bucket long, kind long, held long, span long, packed binary"
SLOTS = 1 << 26  # bits of a bitmap of keys
TURNS = (0, 11, 29, 47)  # by how many bits a context's key is turned at each length, so that no word cancels out
END = np.array([-1], np.int64)  # hash of the end token


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with the end token after each text, and the text's number for each token."""
    hashes, firsts, *_ = hashed_words(texts)
    counts = np.diff(firsts) + 1
    doc = np.repeat(np.arange(len(texts)), counts)
    out = np.empty(len(doc), np.int64)
    ends = np.cumsum(counts) - 1
    inner = np.ones(len(doc), bool)
    inner[ends] = False
    out[inner] = hashes.view(np.int64)
    out[ends] = END[0]
    return out, doc


def _counted(docs: DataFrame, keys_of) -> DataFrame:
    """``key, n``: how often each of the keys that ``keys_of(tokens, doc)`` gives occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def added() -> list[np.ndarray]:
            return _added([np.concatenate(c) for c in zip(*parts)])

        for _, texts in text_chunks(batches):
            parts.append(list(np.unique(keys_of(*tokens(texts)), return_counts=True)))
            held += len(parts[-1][0])
            if held >= 2 * FLUSH:
                parts = [added()]
                held = len(parts[0][0])
                if held >= FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], names=["key", "n"])
                    parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in added()], names=["key", "n"])

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions of keys in an ascending table, -1 where absent."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


class Index:
    """An ascending table of hashes with the places where ranges of them begin: a key is compared with the few of its range."""

    def __init__(self, table: np.ndarray):
        self.table, self.shift = table, 64 - max(1, len(table).bit_length())
        ranges = np.arange(1 << (64 - self.shift), dtype=np.int64) - (1 << (63 - self.shift))
        self.starts = np.append(np.searchsorted(table, ranges << self.shift), len(table)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions of keys, -1 where absent."""
        own = (keys >> self.shift) + (1 << (63 - self.shift))
        at, end = self.starts[own], self.starts[own + 1]
        out = np.full(len(keys), -1)
        rows = np.flatnonzero(at < end)
        at, end, keys = at[rows], end[rows], keys[rows]
        while len(rows):
            hit = self.table[at] == keys
            out[rows[hit]] = at[hit]
            more = np.flatnonzero(~hit & (at + 1 < end))
            rows, at, end, keys = rows[more], at[more] + 1, end[more], keys[more]
        return out


def _turned(keys: np.ndarray, level: int) -> np.ndarray:
    bits, r = keys.view(U64), U64(TURNS[level])
    return ((bits << r) | (bits >> (U64(64) - r))).view(np.int64)


def longer(keys: np.ndarray, doc: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the grams of ``level + 1`` words from those of ``level`` words (by their last token), and which exist."""
    out, there = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    out[1:] = _turned(keys[:-1], level) ^ keys[1:]
    there[1:] = doc[1:] == doc[:-1]
    return out, there


def _longer(context: str, shorter: str, level: int):
    r = TURNS[level]
    return F.shiftleft(context, r).bitwiseOR(F.shiftrightunsigned(context, 64 - r)).bitwiseXOR(F.col(shorter))


def grams(found: np.ndarray, doc: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length the key of the gram that ends at each token, and whether the text has that many words there."""
    out = [(found, np.ones(len(found), bool))]
    for level in range(1, depth + 1):
        keys, there = longer(out[-1][0], doc, level)
        there[1:] &= out[-1][1][:-1]
        out.append((keys, there))
    return out


def bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of all keys' slots, as 64-bit numbers."""
    slot = F.col("key").bitwiseAND(F.lit(SLOTS - 1))
    bit = F.expr("shiftleft(1L, cast(key & 63 as int))")
    with clean_shuffles(keys.sparkSession):
        found = keys.select(F.shiftright(slot, 6).alias("i"), bit.alias("b")).groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()  # SLOTS / 64 rows at most
    out = np.zeros(SLOTS // 64, np.int64)
    out[found["i"].to_numpy()] = found["b"].to_numpy()
    return out.view(U64)


def _in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys.view(U64) & U64(SLOTS - 1)
    return (bits[slot >> U64(6)] >> (slot & U64(63))) & U64(1) == 1


class Codes:
    """Small numbers for the commonest words, the commonest first; other words keep their hash."""

    def __init__(self, counts: DataFrame):
        top = _frequent(counts)[0].select("key", "n").toArrow()
        self.words = top["key"].to_numpy()[np.lexsort((top["key"].to_numpy(), -top["n"].to_numpy()))]
        self.order = np.argsort(self.words)
        self.index = Index(self.words[self.order])

    def of(self, found: np.ndarray) -> np.ndarray:
        at = self.index.find(found)
        return np.where(at >= 0, self.order[at] if len(self.order) else 0, found)

    def words_of(self, codes: np.ndarray) -> np.ndarray:
        own = (codes >= 0) & (codes < len(self.words))
        out = codes.copy()
        out[own] = self.words[codes[own]]
        return out


def _pack(columns: list[np.ndarray]) -> bytes:
    """Sorted rows as bytes: the first column by its steps, high bytes apart from low ones and as many as are used, compressed."""
    steps = [np.diff(columns[0], prepend=np.int64(0)), *columns[1:]]
    widths = [(int(c.view(U64).max(initial=0)).bit_length() + 7) // 8 for c in steps]
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes() for c, w in zip(steps, widths)]
    return bytes(widths) + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpack(packed: bytes, rows: int, columns: int) -> list[np.ndarray]:
    widths, out, at = packed[:columns], [], 0
    planes = np.frombuffer(pa.decompress(packed[columns:], rows * sum(widths), codec="zstd", asbytes=True), np.uint8).reshape(-1, rows)
    for w in widths:
        column = np.zeros((rows, 8), np.uint8)
        column[:, :w] = planes[at : at + w].T
        out.append(column.view(np.int64).reshape(-1))
        at += w
    return [np.cumsum(out[0]), *out[1:]]


def _summed(columns: list[np.ndarray], order: np.ndarray) -> list[np.ndarray]:
    """Rows of words and counts in an order that has equal words together, with equal words once and their counts added up."""
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns[:-1]], axis=0)
    first = np.flatnonzero(new)
    return [*(c[first] for c in columns[:-1]), np.add.reduceat(columns[-1], first, dtype=np.int64) if len(first) else columns[-1]]


def _joined(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Words whose numbers fit side by side into 63 bits as one number, and which rows have such words only."""
    bits = 63 // len(words)
    fits, key = np.ones(len(words[0]), bool), np.zeros(len(words[0]), np.int64)
    for w in words:
        fits &= (w >> bits) == 0  # numbers below 2 ** bits; hashes are almost never
        key <<= bits
        key |= w
    return key[fits], fits


def _parted(key: np.ndarray, width: int) -> list[np.ndarray]:
    bits = 63 // width
    return [(key >> (bits * back)) & ((1 << bits) - 1) for back in range(width - 1, -1, -1)]


def _added(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of words and counts, the last column, with equal words once and their counts added up; sorted by words.

    Words that can be joined are sorted as one number; rows with others come after them."""
    *words, n = columns
    if len(words) == 1:
        if not (n == 1).all():
            return _summed(columns, np.argsort(words[0]))
        key = np.sort(words[0])
        first = np.flatnonzero(np.append(np.ones(len(key[:1]), bool), key[1:] != key[:-1]))
        return [key[first], np.diff(first, append=len(key))]
    key, fits = _joined(words)
    key, counts = _added([key, n[fits]])
    narrow = [*_parted(key, len(words)), counts]
    if fits.all():
        return narrow
    rest = [c[~fits] for c in columns]
    return [np.concatenate(c) for c in zip(narrow, _summed(rest, np.lexsort(rest[-2::-1])))]


def _dealt(columns: list[np.ndarray], mixed: np.ndarray, buckets: int, kind: int = 0, span: int = 0) -> pa.RecordBatch:
    """``BLOCKS`` of sorted rows: the rows of each bucket packed by themselves, in the same order."""
    bucket = (mixed % U64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)  # small numbers are sorted by digits
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order].astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    found = np.split(order, cuts[1:]) if len(order) else []
    packed = [_pack([c[own] for c in columns]) for own in found]
    return _blocks(bucket[cuts], kind, [len(own) for own in found], span, packed)


def _blocks(bucket: np.ndarray, kind: int, held: list[int], span: int, packed: list[bytes]) -> pa.RecordBatch:
    n = len(packed)
    arrays = [pa.array(bucket), pa.array(np.full(n, kind, np.int64)), pa.array(held, pa.int64()), pa.array(np.full(n, span, np.int64)), pa.array(packed, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in BLOCKS.split(", ")])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int, bytes]]:
    """``BLOCKS`` one by one."""
    for batch in batches:
        for block in zip(*batch.columns):
            yield tuple(x.as_py() for x in block)


def _counted_grams(docs: DataFrame, level: int, shared: Broadcast, buckets: int, min_count: int) -> DataFrame:
    """``c, low, n`` of the grams of ``level + 1`` words that occur ``min_count`` times: keys without the last and the first word.

    ``shared`` has a bitmap of the shorter grams that occur as often, and the words' numbers.
    """
    width = level + 2

    def blocks(key: np.ndarray, n: np.ndarray, *others: list[np.ndarray]) -> pa.RecordBatch:
        *words, n = (np.concatenate(c) for c in zip([*_parted(key, level + 1), n], *others))
        mixed = np.zeros(len(n), U64)
        for w in words:
            mixed = mix64(mixed + w.view(U64))
        return _dealt([*words, n], mixed, buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bits, codes), parts, others, held = shared.value, [], [], 0  # grams of numbered words as one number, and those of others

        def added() -> None:
            for kind in (parts, others):
                kind[:] = [_added([np.concatenate(c) for c in zip(*kind)])] if kind else []

        for _, texts in text_chunks(batches):
            found, doc = tokens(texts)
            keys, there = grams(found, doc, level - 1)[-1]
            often = there & _in(bits, keys)
            use = np.flatnonzero((doc[1:] == doc[:-1]) & often[1:] & often[:-1]) + 1
            coded = codes.of(found)
            words = [coded[use - back] for back in range(level, -1, -1)]
            key, fits = _joined(words)
            parts.append([key, np.ones(len(key), np.int32)])
            if not fits.all():
                others.append([*(w[~fits] for w in words), np.ones(len(use) - len(key), np.int64)])
            held += len(use)
            if held >= 2 * FLUSH:
                added()
                held = sum(len(kind[0][0]) for kind in (parts, others) if kind)
                if held >= FLUSH:
                    yield blocks(*parts[0], *others)
                    parts, others, held = [], [], 0
        if parts:
            added()
            yield blocks(*parts[0], *others)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, last, parts = shared.value[1], None, []

        def total() -> pa.RecordBatch:
            *words, n = _added([np.concatenate(c) for c in zip(*parts)])
            often = n >= min_count
            keys = [codes.words_of(w[often]) for w in words]
            for at in range(1, level):
                keys = [_turned(a, at) ^ b for a, b in zip(keys[:-1], keys[1:])]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (*keys, n[often])], names=["c", "low", "n"])

        for bucket, _, held, _, packed in _held(batches):
            if bucket != last and parts:
                yield total()
                parts = []
            last = bucket
            parts.append(_unpack(packed, held, width))
        if parts:
            yield total()

    made = docs.select("text").mapInArrow(count, BLOCKS)
    return made.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add_up, "c long, low long, n long")


def _frequent(table: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(commonest, others): the rows of largest ``n``, ``limit`` (``FREQUENT``) of them at most, whatever the counts, and all others.

    Counts are compared by bins (each count below 10,000, then a hundredth of its logarithm). Of the bin that doesn't fit as a
    whole a share is taken by a hash of the key, so much less than fits that more don't come."""
    limit = FREQUENT if limit is None else limit
    bin_ = F.when(F.col("n") < 10_000, F.col("n")).otherwise(10_000 + F.floor(F.ln("n") * 100)).cast("long")
    cut, room, size = 0, limit, 0
    for r in table.groupBy(bin_.alias("bin")).count().orderBy(F.desc("bin")).collect():  # under 15,000 rows
        if r["count"] > room:
            cut, size = r["bin"], r["count"]
            break
        room -= r["count"]
    share = max(0.0, room - 6 * room**0.5) / size if size else 0.0
    drawn = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    common = (bin_ > cut) | ((bin_ == cut) & drawn)
    return table.where(common), table.where(~common)


class SuffixTree:
    """The commonest part of the tree, which tasks hold. ``words``: hashes of frequent words, ascending, with counts.

    ``levels[l]``: frequent grams of l + 2 words by ascending ``keys``; ``kept``: whether their context is retained. ``gains`` is
    what log10 of the last word's probability has over the shorter context's, ``escapes`` what the gram as a context adds to
    every word after it. ``held``: bitmap of all grams of two words and more that have a part.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        self.words, self.counts, self.total, self.distinct = words, counts, total, distinct
        self.root = np.log10((counts + 1) / (total + distinct + 1))
        self.escapes = np.zeros(len(words))
        self.levels: list[dict] = []
        self.held = np.zeros(SLOTS // 64, U64)
        self.rows = 0  # of the whole tree
        self.indexes: list[Index] = []  # made in the tasks

    def parts(self, found: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """What each token has at the root, gains and escapes by frequent grams, and for each length the others' places and keys."""
        base, gains, escapes, others = np.zeros(len(found)), np.zeros(len(found)), np.zeros(len(found)), []
        if not self.indexes:
            self.indexes = [Index(keys) for keys in (self.words, *(x["keys"] for x in self.levels))]
        tables = [(self.root, self.escapes), *((x["gains"], x["escapes"]) for x in self.levels)]
        for level, ((keys, there), index, (gain, escape)) in enumerate(zip(grams(found, doc, len(self.levels)), self.indexes, tables)):
            place = np.flatnonzero(there & _in(self.held, keys)) if level else np.arange(len(keys))
            at = index.find(keys[place])
            used, other = place[at >= 0], place[at < 0]
            at = at[at >= 0]
            gains[used] += gain[at]
            escapes[used] += escape[at]
            others.append((other, keys[other]))
            if not level:
                base[used] = gain[at]
        return base, gains, escapes, others

    def log_probabilities(self, numbers: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """log10 of each frequent word's probability after the words before it, by frequent grams."""
        _, out, escapes, _ = self.parts(self.words[numbers], doc)
        out[1:] += np.where(doc[1:] == doc[:-1], escapes[:-1], 0.0)
        return out


def _level(found: DataFrame, shorter: DataFrame, level: int, min_divergence: float, min_gain: float) -> DataFrame:
    """``key, c, n, totals, lp, gain, escape, kept`` of counted grams; ``shorter``: ``key, n, lp`` of those one word shorter."""
    rows = found.join(shorter.select(F.col("key").alias("low"), F.col("lp").alias("below")), "low")
    rows = rows.join(shorter.select(F.col("key").alias("c"), F.col("n").alias("totals")), "c")
    of = Window.partitionBy("c")
    rows = rows.withColumns({"seen": F.sum("n").over(of), "kinds": F.count("*").over(of), "before": F.pow(F.lit(10.0), F.col("below"))})
    rows = rows.withColumn("escaped", (F.col("totals") - F.col("seen") + F.col("kinds")) / (F.col("totals") + F.col("kinds")))
    rows = rows.withColumn("own", F.col("n") / (F.col("totals") + F.col("kinds")) + F.col("escaped") * F.col("before"))
    gained = F.sum(F.col("n") * F.ln(F.col("own") / F.col("before"))).over(of) + (F.col("totals") - F.col("seen")) * F.ln("escaped")
    rows = rows.withColumn("gained", gained)
    kept = (F.col("gained") >= min_gain) & (F.col("gained") >= min_divergence * F.col("totals"))
    rows = rows.withColumns({"kept": kept, "escape": F.log10("escaped"), "lp": F.when(kept, F.log10("own")).otherwise(F.col("below"))})
    return rows.select(_longer("c", "low", level).alias("key"), "c", "n", "totals", "lp", (F.col("lp") - F.col("below") - F.col("escape")).alias("gain"), "escape", "kept")


def train(docs: DataFrame, depth: int = 2, min_count: int = 2, min_divergence: float = 0.02, min_gain: float = 12.0) -> tuple[SuffixTree, DataFrame]:
    """The tree's commonest part, and the rest: ``key, n, gain, escape`` of all other words and of the other grams that have a part."""
    counts = materialize(_counted(docs, lambda found, doc: found), "lm-counts")
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    zero = F.lit(0.0)
    table = counts.withColumn("lp", F.log10((F.col("n") + 1) / F.lit(float(total + distinct + 1))))
    gains = table.select("key", "n", F.col("lp").alias("gain"))
    levels, scratch = [], [counts]
    codes, buckets = Codes(counts), int(total) // BUCKET_TOKENS + 1
    for level in range(1, depth + 1):
        often = table.where(F.col("n") >= min_count)  # a shorter gram occurs as often as those it is part of
        shared = docs.sparkSession.sparkContext.broadcast((bitmap(often), codes))
        table = materialize(_level(_counted_grams(docs, level, shared, buckets, min_count), often, level, min_divergence, min_gain), f"lm-grams-{level}")
        shared.destroy()
        scratch.append(table)
        kept = table.where("kept")
        escapes = kept.groupBy("c").agg(F.first("totals").alias("totals"), F.first("escape").alias("escape"))
        joined = gains.join(escapes, F.col("key") == F.col("c"), "left" if level == 1 else "full")
        levels.append(joined.select(F.coalesce("key", "c").alias("key"), F.coalesce("n", "totals").alias("n"), F.coalesce("gain", zero).alias("gain"), F.coalesce("escape", zero).alias("escape")))
        gains = kept.select("key", "n", "gain")
    levels.append(gains.withColumn("escape", zero))
    levels = [materialize(x, "lm-tree") for x in levels]
    discard(*scratch)
    rest = None
    for level, whole in enumerate(levels):
        top, other = _frequent(whole)
        top = top.toArrow()
        order = np.argsort(top["key"].to_numpy())
        keys, n, gains, escapes = (top[c].to_numpy()[order] for c in ("key", "n", "gain", "escape"))
        if level == 0:
            tree = SuffixTree(keys, n, total, distinct)
            tree.escapes = escapes
        else:
            tree.levels.append({"keys": keys, "gains": gains, "escapes": escapes, "kept": gains != 0})
            tree.held |= bitmap(whole)
        tree.rows += whole.count()
        rest = other if rest is None else rest.union(other)
    return tree, rest


def score(docs: DataFrame, tree: SuffixTree, rest: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` for each row of ``docs``.

    The rest of the tree, the texts' other grams and their sums over frequent grams are dealt to buckets as blocks of three kinds.
    A block of texts has a number, ``span``, by which what the buckets find for it comes together.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tree)
    buckets = max(LEAST_BUCKETS, tree.rows // TREE_ROWS + 1)
    tree_part, text_sums, text_grams = 0, 1, 2
    size = float(tree.total + tree.distinct + 1)

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def blocks() -> pa.RecordBatch:
            keys, n, v = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(keys)
            return _dealt([x[order] for x in (keys, n, v.view(np.int64))], mix64(keys[order].view(U64)), buckets, tree_part)

        for batch in batches:
            parts.append([batch.column(i).to_numpy() for i in range(3)])
            held += batch.num_rows
            if held >= FLUSH:
                yield blocks()
                parts, held = [], 0
        if held:
            yield blocks()

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, span = shared.value, TaskContext.get().partitionId() << 32
        parts, sums, held, texts_held = [], [], 0, 0

        def blocks() -> Iterator[pa.RecordBatch]:
            own = [np.concatenate(c) for c in zip(*sums)]
            yield _dealt(own, np.full(len(own[0]), span, U64), buckets, text_sums, span)
            keys, of = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(keys)
            yield _dealt([keys[order], of[order]], mix64(keys[order].view(U64)), buckets, text_grams, span)

        for batch, texts in text_chunks(batches):
            found, doc = tokens(texts)
            base, gains, escapes, others = t.parts(found, doc)
            known = np.ones(len(found), bool)
            known[others[0][0]] = False
            n, ids = len(texts), batch.column(0)
            own = [ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), np.bincount(doc, minlength=n), np.bincount(doc, known, n).astype(np.int64)]
            sums.append([*own, *(np.bincount(doc, w, n).view(np.int64) for w in (base, gains + escapes))])
            for level, (place, keys) in enumerate(others):
                parts.append([keys, 2 * (texts_held + doc[place]) + (level == 0)])
                held += len(keys)
            texts_held += n
            if held >= FLUSH or texts_held >= BLOCK_TEXTS:
                yield from blocks()
                parts, sums, held, texts_held, span = [], [], 0, 0, span + 1
        if sums:
            yield from blocks()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts, columns = None, [], []
        unseen = np.log10(1.0 / size)
        for bucket, kind, rows, span, packed in _held(batches):
            if bucket != last:
                last, parts, columns = bucket, [], [np.zeros(0, np.int64)] * 3
            if kind == tree_part:
                parts.append(_unpack(packed, rows, 3))
                continue
            if kind == text_sums:
                yield _blocks(np.full(1, bucket), kind, [rows], span, [packed])
                continue
            if parts:
                columns, parts = [np.concatenate(c) for c in zip(*parts)], []
                order = np.argsort(columns[0])
                columns = [c[order] for c in columns]
            keys, of = _unpack(packed, rows, 2)
            at = _find(columns[0], keys)
            inside, word, doc = at >= 0, of & 1 == 1, of >> 1
            count, v = np.zeros(rows, np.int64), np.where(word, unseen, 0.0)
            count[inside], v[inside] = columns[1][at[inside]], columns[2].view(np.float64)[at[inside]]
            here = np.flatnonzero(np.bincount(doc))
            n_known = np.bincount(doc, word & (count > 0))[here].astype(np.int64)
            base = np.bincount(doc, np.where(word, np.log10((count + 1) / size), 0.0))[here]
            made = _pack([here, n_known, base.view(np.int64), np.bincount(doc, v)[here].view(np.int64)])
            yield _blocks(np.full(1, bucket), kind, [len(here)], span, [made])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = []

        def texts() -> pa.RecordBatch:
            ids, valid, n_tokens, *sums = own
            return pa.RecordBatch.from_arrays([pa.array(ids, mask=valid == 0), *(pa.array(x) for x in (n_tokens, *sums))], names=names)

        for _, kind, rows, _, packed in _held(batches):  # the texts' own sums come first
            if kind == text_sums:
                if own:
                    yield texts()
                *own, base, total = _unpack(packed, rows, 6)
                own += [base.view(np.float64), total.view(np.float64)]
            else:
                here, n_known, base, total = _unpack(packed, rows, 4)
                for into, x in zip(own[3:], (n_known, base.view(np.float64), total.view(np.float64))):
                    into[here] += x
        if own:
            yield texts()

    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double"
    names = [c.split()[0] for c in schema.split(", ")]
    tree_blocks = rest.select("key", "n", (F.col("gain") + F.col("escape")).alias("v")).mapInArrow(table, BLOCKS)
    blocks = tree_blocks.union(docs.mapInArrow(texts_of, BLOCKS))
    found = blocks.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(look_up, BLOCKS)
    found = materialize(found, "lm-found")
    shared.destroy()
    return found.repartition("span").sortWithinPartitions("span", "kind", "bucket").mapInArrow(add_up, schema)


def score_documents(
    docs: DataFrame, folds: int = 7, held_out: int = 2, depth: int = 2, min_count: int = 2, min_divergence: float = 0.02, min_gain: float = 12.0
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document; ``depth`` from 1 to 3.

    A context stays if its divergence (nats a token) and the log-likelihood it gains (nats) reach ``min_divergence`` and ``min_gain``.
    """
    if not 1 <= depth < len(TURNS):
        raise ValueError(f"depth must be from 1 to {len(TURNS) - 1}")
    docs = documents_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    out = F.coalesce(mod_of_id(F.col("doc_id"), folds) == held_out, F.lit(False))
    with small_batches(docs.sparkSession):
        tree, rest = train(docs.where(~out), depth, min_count, min_divergence, min_gain)
        scored = score(docs, tree, rest)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(tree.total).cast("long").alias("train_tokens"), "base_score", "score")
