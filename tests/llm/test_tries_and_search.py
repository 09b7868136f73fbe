"""Prefix trie, substring dedup and ranked search against brute force, on ties, nulls, repeats, long rows and empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from netquill.llm import prefix_trie, ranked_search, scans, substring_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- op11 ------------------------------------------------------------------------------------------------------------------
TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_by_hand(rows):
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(convs.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:])
    nodes = collections.defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes[built[c][:d]].append(c)
    kids = collections.Counter(p[:-1] for p in nodes if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    ends = {p: ",".join(str(c) for c in m if built[c] == p) for p, m in nodes.items()}
    return sorted(((m[0], len(p), nodes[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in nodes.items()), key=lambda r: r[:2])


@pytest.fixture
def spread(spark):
    """Ranges of small tables stay apart, so that keys cross partitions."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield spark
    spark.conf.unset(name)


def conversations(spark, rows):
    made = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, k1 string")
    return made.repartition(3) if rows else made


def trie_of(spark, rows):
    return sorted((tuple(r[c] for c in TRIE) for r in prefix_trie.prefix_trie(conversations(spark, rows)).collect()), key=lambda r: r[:2])


def test_trie_equals_brute_force(spread, spark):
    draw = random.Random(3)
    rows = [(c, draw.choice([t, t, None]), draw.choice(["u", "a", None]), draw.choice(["", "x", None, "é"])) for c in [*range(60), -7, -5, 1_000_001, 5000, 5001] for t in range(draw.choice([0, 1, 3, 5, 9, 20]))]
    rows += [(c, t, "u", "z" * (t % 3)) for c in (77, 78, 80) for t in range(90)]  # long ones that share all
    rows += [(None, 1, "u", "q"), (3, 1, "u", "x"), (3, 1, "u", "x")]
    assert trie_of(spark, rows) == trie_by_hand(rows)
    assert trie_of(spark, []) == [] and trie_of(spark, [(None, 1, "u", "q")]) == []


def test_trie_of_one_long_conversation_and_many_copies(spread, spark):
    long = [(1, t, "u", str(t)) for t in range(150)]  # cut by ranges of turn: most of all rows
    copies = [(10 * i, t, "u", f"copy {t}") for i in range(1, 60) for t in range(2)]
    assert trie_of(spark, long + copies) == trie_by_hand(long + copies)


def test_a_key_over_several_partitions_is_carried(spread, spark):
    rows = conversations(spark, [(1, t, "u", "") for t in range(900)] + [(2, 0, "u", "")])
    runs = scans.sorted_runs(rows.select("conv_id", "turn"), "conv_id", ["turn"], ["conv_id", "turn"], lambda at, batch: [at], 1, 0, "test-scan")
    parts = [p for p in scans.crossing(runs, "conv_id", 1) if p[0] == 1]
    assert len(parts) > 1 and sum(p[2] for p in parts) == 900


def test_colliding_turns_are_found_and_hashed_anew(spark, monkeypatch):
    whole, seeds = prefix_trie.stored_turns, []

    def poor(conversations, seed):
        seeds.append(seed)
        return whole(conversations, seed).withColumns({"k1": F.lit(1).cast("long"), "k2": F.lit(1).cast("long")} if seed == 0 else {})

    monkeypatch.setattr(prefix_trie, "stored_turns", poor)
    rows = [(c, t, "u", f"{c % 3} {t}") for c in range(20) for t in range(4)]
    assert trie_of(spark, rows) == trie_by_hand(rows) and seeds == [0, 1]


# ---- op12 ------------------------------------------------------------------------------------------------------------------
def cut_by_hand(docs, span):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    least = {}
    for d, w in words:
        for i in range(len(w) - span + 1) if d is not None else ():
            key = tuple(w[i : i + span])
            least[key] = min(least.get(key, d), d)
    out = []
    for d, w in words:
        stay = [True] * len(w)
        for i in range(len(w) - span + 1) if d is not None else ():
            if least[tuple(w[i : i + span])] < d:
                stay[i : i + span] = [False] * span
        out.append((-1 if d is None else d, " ".join(x for x, s in zip(w, stay) if s), len(w), len(w) - sum(stay)))
    return sorted(out)


def cut_of(spark, docs, **named):
    made = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, part int, gram string")
    rows = substring_dedup.dedup_substrings(made.repartition(3) if docs else made, **named).collect()
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["kept_text"], r["n_words"], r["n_removed"]) for r in rows)


def passages():
    draw = random.Random(5)
    some = lambda n: [f"w{draw.randrange(200)}" for _ in range(n)]
    shared, docs = [some(n) for n in (50, 51, 60, 90, 120, 700)], []
    for i in range(200):
        text = some(draw.choice([0, 5, 49, 50, 100, 300]))
        for _ in range(draw.randrange(4)):
            p = draw.choice(shared)
            a, at = draw.randrange(len(p) - 40), draw.randrange(len(text) + 1)
            text[at:at] = p[a : a + draw.choice([45, 50, 55, 100, 1000])]
        docs.append((i, " ".join(text)))
    docs += [(400 + i, docs[5][1].replace("w1 ", "x ", i)) for i in range(5)]  # copies, near copies
    docs += [(500 + i, "a " * n) for i, n in enumerate((49, 50, 51, 90, 130, 200))] + [(520 + i, "a b " * n + "c") for i, n in enumerate((24, 25, 26, 90))]  # ties among grams
    docs += [(3, " ".join(shared[4]))] * 2 + [(None, " ".join(shared[4])), (601, None), (602, ""), (603, " \t\n"), (604, "É x \x1f y")]
    draw.shuffle(docs)
    return docs


@pytest.mark.parametrize("named", [{}, {"span": 20, "k": 5}, {"k": 50}])
def test_substrings_equal_brute_force(spark, named):
    docs = passages()
    assert cut_of(spark, docs, **named) == cut_by_hand(docs, named.get("span", 50))


def test_long_copies_compact_to_one_unitig(spark):
    draw = random.Random(7)
    text = " ".join(f"w{draw.randrange(10**6)}" for _ in range(20_000))
    docs = [(1, "head " * 3 + text), (2, text), (3, text + " tail"), (4, "")]
    assert cut_of(spark, docs) == cut_by_hand(docs, 50)
    assert cut_of(spark, []) == []
    given = spark.createDataFrame(docs, "doc_id long, text string").withColumn("part", F.hash("text")).select("doc_id", "part", "text")
    found = substring_dedup._repeats(given, 50, 10, 0).where("mask is null").collect()
    assert {r["doc_id"] for r in found} == {2, 3} and all(r["n"] > 19_800 for r in found)


def test_span_bounds(spark):
    with pytest.raises(ValueError):
        cut_of(spark, [(1, "a")], span=100, k=10)


# ---- op13 ------------------------------------------------------------------------------------------------------------------
def ranked_by_hand(docs, items, k=50):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    held = [(d, collections.Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    out = []
    for i, some in asked.items():
        scores = []
        for d, c in held:
            if d is not None and c:
                m = 50 + 50 * sum(c.values()) * n_docs // n_terms
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in some if c[t])
                scores += [(-score, d)] * (score > 0)
        out += [(i, rank, d, -s) for rank, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def ranked_of(spark, docs, items, **named):
    made = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int")
    rows = ranked_search.rank_documents(made.repartition(3) if docs else made, spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int"), **named).collect()
    return sorted(map(tuple, rows))


@pytest.mark.parametrize("shard", [1 << 20, 2000])
def test_ranks_equal_brute_force(spark, shard):
    draw = random.Random(1)
    words = [f"w{i}" for i in range(300)] + ["É", "ab"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(draw.choices(words, weights, k=draw.choice([0, 1, 3, 20, 60, 500])))) for i in range(1500)]
    docs += [(5000 + i, docs[7][1] + " w1 w2") for i in range(150)] + [(None, "w1 w2 É"), (1, None), (1, "W1, w2;É"), (9000, "w1 " * 50_000)]  # ties, repeats, a long text
    items = [(i, " ".join(draw.choices(words, k=draw.choice([0, 1, 5, 30])))) for i in range(25)] + [(3, "w1 w2 W1"), (None, "w1"), (77, None), (78, "w1 w2 w3 w4")]
    assert ranked_of(spark, docs, items, shard=shard) == ranked_by_hand(docs, items)
    assert ranked_of(spark, docs[:300], items, k=3, shard=shard) == ranked_by_hand(docs[:300], items, 3)


def test_ranks_of_empty_tables(spark):
    assert ranked_of(spark, [], [(1, "a b")]) == ranked_of(spark, [(1, None), (2, "--")], [(1, "a b")]) == ranked_of(spark, [(1, "a")], [(1, None)]) == ranked_of(spark, [(1, "a")], []) == []


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "ITEM_TERMS", 8)
    docs, items = [(i, f"a{i % 7} b{i % 3} c") for i in range(60)], [(i, f"a{i} b{i % 3}") for i in range(8)]
    assert ranked_of(spark, docs, items) == ranked_by_hand(docs, items)


def test_reading_stops_before_the_lists_end():
    np = ranked_search.np
    n, terms, tf = np.full(20_000, 10), np.zeros(20_000, np.int32), np.ones(20_000, np.int32)
    tf[:50] = 9
    shard = ranked_search.Shard(n, np.ones(20_000, np.int64), terms, tf, 20_000, 200_000)
    found, scores = shard.best(np.array([0]), np.array([1000]), 50, 1)
    assert sorted(found) == list(range(50)) and len(set(scores)) == 1
