"""Prefix trie of conversations rebuilt from a shared head and an own rest, by fingerprints of a monoid.

A sequence of turns has the fingerprint (n, S): n its length, S the sum of its turns' symbols times the powers of a base modulo
2^31 - 1, for three bases. Fingerprints compose, (n, S)(m, T) = (n + m, S + B^n T), and a prefix can be divided out of a longer
one, so those of all prefixes of a rebuilt conversation follow from the stored prefix sums of its base and its own turns. No
rebuilt text is ever made: a rebuilt turn is its conversation, its depth, two fingerprints (its own prefix and that without
the last turn) and the 128-bit key of the stored turn it refers to.

1. Prefix sums of the stored turns (``scans``): a conversation of any length is spread over tasks.
2. Members: one row per conversation and depth, of the head (at most ``HEADS - 1`` turns) and of the own rest.
3. Nodes: members grouped by depth and fingerprint. Equality is verified, not assumed: turns with one key must have one role
   and text, and all members of a node must refer to the same key and to the same parent; by induction from the root their
   prefixes are then equal turn by turn. Where a hash collides, all is done anew with other hashes, so results are exact.
4. A node's smallest member owns it, and owns all deeper nodes on its own path; these chains carry the sums over subtrees: a
   node's sum is that of its chain below it and of the whole chains of the members that leave it. No loop over depths.
5. The ids that end at a node are joined into texts of at most 4,096 ids, sorted, and hashed one after the other.

Cases: a null role or text is empty; turns are ordered by ``turn`` (nulls first), then role, then text; repeated rows are turns
of their own; rows with a null ``conv_id`` are left out; an empty table has no nodes, not even a root; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.llm.common import discard, materialize
from netquill.llm.scans import crossing, sorted_runs

P = (1 << 31) - 1
#: Head lengths are remainders by this, so a head has fewer turns.
HEADS = 9
#: A conversation takes its head from that with its id less the remainder by this.
FAMILY = 5
ID_BITS = 12
NODE = ["depth", "f1", "f2"]


def _powers(base: int, at: np.ndarray) -> np.ndarray:
    """base ** at modulo P."""
    out, square, left = np.ones(len(at), np.int64), base, at.copy()
    while left.any():
        out = np.where(left & 1, out * square % P, out)
        square = square * square % P
        left >>= 1
    return out


def stored_turns(conversations: DataFrame, seed: int) -> DataFrame:
    """The turns with a 128-bit key of role and text; ``conv_id`` is never null."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    keys = F.xxhash64(F.lit(2 * seed), "role", "text").alias("k1"), F.xxhash64(F.lit(2 * seed + 1), "text", "role").alias("k2")
    return named.select("*", *keys, F.octet_length("text").cast("long").alias("n_bytes"))


def _prefix_sums(turns: DataFrame, bases: tuple[int, ...]) -> DataFrame:
    """``conv_id, pos`` (from 1) with the key, size, and for each base the term ``t<i>`` and prefix sum ``s<i>``."""

    def terms(at: np.ndarray, batch: pa.RecordBatch) -> list[np.ndarray]:
        k1, k2 = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("k1", "k2"))
        symbols = (k1 % P, k2 % P, ((k1 >> 7) ^ (k2 >> 31)) % P)
        return [symbol * _powers(base, at) % P for symbol, base in zip(symbols, bases)]

    tied = turns.groupBy("conv_id", "turn").count().where("count > 1").limit(1).count() > 0
    order = ["turn", "role", "text"] if tied else ["turn"]  # texts are shuffled only where some turns have one number
    slim = turns.select("conv_id", *order, "k1", "k2", "n_bytes")
    runs = sorted_runs(slim, "conv_id", order, ["conv_id", "k1", "k2", "n_bytes"], terms, len(bases), P, "trie-turns")
    offsets, before = [], (None, 0, (0,) * len(bases))
    for key, block, rows, sums in crossing(runs, "conv_id", len(bases)):
        if key == before[0]:
            powers = [pow(b, before[1], P) for b in bases]
            offsets.append((key, block, before[1], *powers, *before[2]))
            before = (key, before[1] + rows, tuple((s + w * x) % P for s, w, x in zip(before[2], powers, sums)))
        else:
            before = (key, rows, sums)
    names = [f"{kind}{i}" for kind in "wo" for i in range(len(bases))]
    if not offsets:
        return runs.withColumn("pos", F.col("at"))
    carried = runs.sparkSession.createDataFrame(offsets, "conv_id long, block int, rows long, " + ", ".join(f"{n} long" for n in names))
    joined = runs.join(F.broadcast(carried), ["conv_id", "block"], "left")  # one row for each partition at most
    moved = {f"s{i}": (F.coalesce(f"o{i}", F.lit(0)) + F.coalesce(f"w{i}", F.lit(1)) * F.col(f"s{i}")) % P for i in range(len(bases))}
    moved |= {f"t{i}": F.coalesce(f"w{i}", F.lit(1)) * F.col(f"t{i}") % P for i in range(len(bases))}
    return joined.withColumns(moved | {"pos": F.col("at") + F.coalesce("rows", F.lit(0))}).drop("rows", *names)


def _key(sums: list[Column], names: tuple[str, str]) -> list[Column]:
    return [(sums[0] * (1 << 31) + sums[1]).alias(names[0]), sums[2].alias(names[1])]


def members(turns: DataFrame, bases: tuple[int, ...]) -> DataFrame:
    """One row per rebuilt conversation and depth (from 0): fingerprints ``f1, f2`` of the prefix and ``p1, p2`` of its parent,
    the key and size of its last turn, and ``ends`` where the conversation ends there."""
    three = range(len(bases))
    stored = ["pos", "k1", "k2", "n_bytes", *(f"s{i}" for i in three), *(f"t{i}" for i in three)]
    first = F.when(F.col("pos") < HEADS, F.struct(*stored))
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n"), F.sort_array(F.collect_list(first)).alias("own"))
    based = convs.select("*", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h"))
    bases_ = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"), F.col("own").alias("head"))
    plan = based.join(bases_, "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0)))).withColumn("head", F.expr("slice(head, 1, int(k))"))
    length = F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    at_head = lambda array, at, i: F.when(F.col(at) > 0, F.get(array, (F.col(at) - 1).cast("int"))[f"s{i}"]).otherwise(0)
    whole = [F.coalesce(at_head("head", "k", i), F.lit(0)).alias(f"a{i}") for i in three]
    cut = [F.coalesce(at_head("own", "h", i), F.lit(0)).alias(f"c{i}") for i in three]
    plan = plan.select("conv_id", "h", "k", "head", length.alias("len"), *whole, *cut)

    root = plan.select("conv_id", F.lit(0).cast("long").alias("depth"), *(F.lit(0).cast("long").alias(c) for c in ("f1", "f2", "p1", "p2", "k1", "k2", "n_bytes")), (F.col("len") == 0).alias("ends"))
    heads = plan.select("conv_id", "len", F.explode("head").alias("x")).select("conv_id", "len", "x.*")
    before = [F.pmod(F.col(f"s{i}") - F.col(f"t{i}"), F.lit(P)) for i in three]
    heads = heads.select("conv_id", F.col("pos").alias("depth"), *_key([F.col(f"s{i}") for i in three], ("f1", "f2")), *_key(before, ("p1", "p2")), "k1", "k2", "n_bytes", (F.col("pos") == F.col("len")).alias("ends"))

    rest = turns.join(plan.drop("head"), "conv_id").where("pos > h")
    back = [F.get(F.array(*(F.lit(pow(b, -d, P)).cast("long") for d in range(HEADS))), (F.col("h") - F.col("k")).cast("int")) for b in bases]
    here = [F.pmod(F.col(f"a{i}") + back[i] * F.pmod(F.col(f"s{i}") - F.col(f"c{i}"), F.lit(P)), F.lit(P)).alias(f"x{i}") for i in three]
    less = [(back[i] * F.col(f"t{i}") % P).alias(f"y{i}") for i in three]
    rest = rest.select("conv_id", "len", (F.col("k") + F.col("pos") - F.col("h")).alias("depth"), "k1", "k2", "n_bytes", *here, *less)
    parents = [F.pmod(F.col(f"x{i}") - F.col(f"y{i}"), F.lit(P)) for i in three]
    rest = rest.select("conv_id", "depth", *_key([F.col(f"x{i}") for i in three], ("f1", "f2")), *_key(parents, ("p1", "p2")), "k1", "k2", "n_bytes", (F.col("depth") == F.col("len")).alias("ends"))
    return root.unionByName(heads).unionByName(rest)


def _nodes(rows: DataFrame) -> DataFrame:
    """The nodes with their smallest member, and ``odd`` where members differ in their parent or their last turn."""
    same = ("p1", "p2", "k1", "k2")
    spread = [f(c).alias(f"{f.__name__}_{c}") for c in same for f in (F.min, F.max)]
    made = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("ends").alias("n_ends"), F.max("n_bytes").alias("n_bytes"), *spread)
    odd = F.expr(" or ".join(f"min_{c} <> max_{c}" for c in same))
    return made.select(*NODE, F.col("min_p1").alias("p1"), F.col("min_p2").alias("p2"), "conv_id", "n_convs", "n_ends", "n_bytes", odd.alias("odd"))


def _end_hashes(rows: DataFrame) -> DataFrame:
    """SHA-256 of the sorted ids that end at a node, from texts of ids that differ in their last ``ID_BITS`` bits alone."""
    ids = F.sort_array(F.collect_list("conv_id")).cast("array<string>")
    parts = rows.where("ends").groupBy(*NODE, F.shiftright("conv_id", ID_BITS).alias("part")).agg(F.concat_ws(",", ids).alias("ids"))

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if key != node:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _hashed(done)
        if node:
            yield _hashed([(*node, state.hexdigest())])

    dealt = parts.repartition(*NODE).sortWithinPartitions(*NODE, "part").select(*NODE, "ids")
    return dealt.mapInArrow(chained, "depth long, f1 long, f2 long, ends_sha256 string")


def _hashed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[*NODE, "ends_sha256"])


def _chains(nodes: DataFrame) -> DataFrame:
    """The nodes with ``below`` (leaves and saved bytes of their chain from them down) and ``deepest`` for a chain's last node."""

    def terms(at: np.ndarray, batch: pa.RecordBatch) -> list[np.ndarray]:
        convs, ends, size = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("n_convs", "n_ends", "n_bytes"))
        return [(convs == ends).astype(np.int64), (convs - 1) * size]

    keep = ["conv_id", *NODE, "p1", "p2", "n_convs", "n_ends", "n_bytes"]
    runs = sorted_runs(nodes.select(*keep), "conv_id", [F.desc("depth")], keep, terms, 2, 0, "trie-chains")
    offsets, before = [], (None, 0, (0, 0))
    for key, block, rows, sums in crossing(runs, "conv_id", 2):
        if key == before[0]:
            offsets.append((key, block, *before[1:][1]))
            before = (key, 0, (before[2][0] + sums[0], before[2][1] + sums[1]))
        else:
            before = (key, 0, sums)
    if not offsets:
        return runs.withColumn("deepest", F.col("at") == 1)
    carried = runs.sparkSession.createDataFrame(offsets, "conv_id long, block int, o0 long, o1 long")
    joined = runs.join(F.broadcast(carried), ["conv_id", "block"], "left")  # one row for each partition at most
    return joined.withColumns({"deepest": (F.col("at") == 1) & F.col("o0").isNull(), "s0": F.col("s0") + F.coalesce("o0", F.lit(0)), "s1": F.col("s1") + F.coalesce("o1", F.lit(0))}).drop("o0", "o1")


def trie(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes with links, counts and sums over their subtrees, from written members and nodes."""
    chains = _chains(nodes)
    leaf, saved = (F.col("n_convs") == F.col("n_ends")).cast("long"), (F.col("n_convs") - 1) * F.col("n_bytes")
    owned = nodes.groupBy(F.col("conv_id").alias("owner")).agg(F.min("depth").alias("top"), F.sum(leaf).alias("leaves"), F.sum(saved).alias("saved"))
    leaving = rows.select("conv_id", *NODE).join(owned, F.col("conv_id") == F.col("owner")).where("depth < top")
    attached = leaving.groupBy(*NODE).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count_if(F.col("depth") == F.col("top") - 1).alias("n_tops"))
    tops = nodes.select("conv_id", *NODE, "p1", "p2").join(owned.select("owner", "top"), (F.col("conv_id") == F.col("owner")) & (F.col("depth") == F.col("top"))).where("depth > 0")
    above = nodes.select((F.col("depth") + 1).alias("d"), F.col("f1").alias("q1"), F.col("f2").alias("q2"), F.col("conv_id").alias("parent"))
    # the tops below the root are most of all where few conversations share a start, so that they aren't joined
    least = F.broadcast(nodes.where("depth = 0").select(F.col("conv_id").alias("parent")))  # one row
    linked = tops.where("depth > 1").join(above, (F.col("depth") == F.col("d")) & (F.col("p1") == F.col("q1")) & (F.col("p2") == F.col("q2"))).select(*NODE, "parent")
    linked = linked.unionByName(tops.where("depth = 1").join(least).select(*NODE, "parent"))

    found = chains.join(attached, NODE, "left").join(linked, NODE, "left").join(_end_hashes(rows), NODE, "left")
    zero = F.lit(0).cast("long")
    return found.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"), "n_convs",
        (F.coalesce("n_tops", zero) + F.when(F.col("deepest"), 0).otherwise(1)).alias("n_children"),
        (F.col("s0") + F.coalesce("leaves", zero)).alias("n_leaves"), (F.col("s1") + F.coalesce("saved", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, seed: int = 0) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations; see the module's text."""
    for attempt in range(seed, seed + 8):
        drawn = np.random.default_rng(attempt)
        bases = tuple(int(b) for b in drawn.integers(1 << 20, P - 1, 3))
        stored = stored_turns(conversations, attempt)
        turns = _prefix_sums(stored, bases)
        rows = materialize(members(turns, bases), "trie-members")
        nodes = materialize(_nodes(rows), "trie-nodes")
        content = F.struct("role", "text")
        clashing = stored.groupBy("k1", "k2").agg(F.min(content).alias("a"), F.max(content).alias("b")).where("a <> b")
        if nodes.where("odd").limit(1).count() + clashing.limit(1).count() == 0:
            return trie(rows, nodes)
        discard(rows, nodes)
    raise RuntimeError("hashes collided under eight seeds")
