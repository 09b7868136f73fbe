"""Each training-data operator against a brute-force version, and on nulls, empty texts, ties, repeats and clashing columns."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from netquill.llm import components, language_id, line_dedup, minhash_dedup, mtree_search, piece_sampling, projected_search, source_mixing, suffix_tree_lm, toxicity, url_filter
from netquill.llm.common import mix64, range_hashes
from netquill.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra int, key string, component string, score double"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    """(doc_id, text[, lang[, source]]) with further columns whose names clash with the operators' own."""
    full = [(*r, *["en", "s"][len(r) - 2 :], 0, 1, "k", "c", 0.5) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


LONG = "word " * 30_000
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "É ÀÉ 你好 ▁x"), (5, LONG), (None, "a b c d e f"), (7, "same same"), (8, "same same"), (7, "same same")]


# ---- op1, op5 --------------------------------------------------------------------------------------------------------------
def vectors(spark, table):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in table], "vec_id long, embedding array<float>, score int").repartition(3)


def test_mtree_is_exact(spark):
    rng = np.random.default_rng(1)
    table = [(i, v) for i, v in enumerate(rng.normal(size=(3000, 12)).astype(np.float32))]
    table += [(5000 + i, table[i][1]) for i in range(40)]  # ties
    got = collections.defaultdict(list)
    for r in mtree_search.top_k(vectors(spark, table), F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ids, ints = np.array([i for i, _ in table]), np.floor(256 * np.array([v for _, v in table], np.float64)).astype(int)
    for q in ids[ids % 50 == 0]:
        scores = ints @ ints[np.flatnonzero(ids == q)[0]]
        best = [(int(ids[i]), int(scores[i])) for i in np.lexsort((ids, -scores)) if ids[i] != q][:5]
        assert got[q] == best


@pytest.mark.parametrize("search", [lambda t: mtree_search.top_k(t, F.col("vec_id") % 50 == 0), lambda t: projected_search.nearest(t, F.col("vec_id") % 50 == 0)])
def test_searches_on_odd_vectors(spark, search):
    odd = [(0, [1, 2]), (1, None), (2, [None, 1]), (3, [math.nan, 1]), (4, [math.inf, 1]), (50, [1, 2]), (50, [1, 2]), (6, [3, 4]), (7, [1])]
    got = {(r["query_id"], r["vec_id"]) for r in search(vectors(spark, odd)).collect()}
    assert got == {(0, 50), (0, 6), (50, 0), (50, 6)}
    assert search(vectors(spark, odd[:0])).count() == 0
    assert search(vectors(spark, [(0, [1, 2])])).count() == 0


def test_projected_search_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 32))
    table = [(i, v.astype(np.float32)) for i, v in enumerate(centres[rng.integers(0, 20, 6000)] + 0.3 * rng.normal(size=(6000, 32)))]
    rows = projected_search.nearest(vectors(spark, table), F.col("vec_id") % 100 == 0).toPandas()
    x, hits = np.array([v for _, v in table], np.float64), 0
    for q in range(0, 6000, 100):
        distance = np.sqrt(((x - x[q]) ** 2).sum(1))
        distance[q] = np.inf
        own = rows[rows["query_id"] == q].sort_values("rank")
        assert len(own) == 10 and np.allclose(own["score"], distance[own["vec_id"]])
        hits += len(set(own["vec_id"]) & set(np.argsort(distance)[:10].tolist()))
    assert hits / 600 >= 0.9


# ---- op2 -------------------------------------------------------------------------------------------------------------------
def test_mixing_follows_the_poisson_quantiles(spark):
    table = [(i, f"t{i}", "en", "abc"[i % 3]) for i in range(900)] + [(None, None, "en", None)]
    got = collections.Counter(r["doc_id"] for r in source_mixing.mix_sources(docs(spark, table), {"a": 0.6, "b": 0.1}, 1.5).collect())
    budget = 1.5 * 901
    for i, _, _, s in table[:900]:
        rate = {"a": 0.6, "b": 0.1}.get(s, 0.3) * budget / {"a": 300, "b": 300}.get(s, 301)
        u = int(hashlib.md5(f"mix|{i}".encode()).hexdigest()[:13], 16) / 2**52
        n, p, total = 0, math.exp(-rate), math.exp(-rate)
        while total <= u:
            n += 1
            p *= rate / n
            total += p
        assert got[i] == n
    assert source_mixing.mix_sources(docs(spark, []), {"a": 1.0}).count() == 0
    with pytest.raises(ValueError):
        source_mixing.mix_sources(docs(spark, table), {"a": 0.9, "b": 0.2})
    with pytest.raises(ValueError):
        source_mixing.mix_sources(docs(spark, table).withColumn("Copy", F.lit(1)), {"a": 0.5})


def test_rare_sources_mix_at_high_rates(spark):
    table = [(i, "t", "en", "rare" if i < 2 else "common") for i in range(2000)]
    got = collections.Counter(r["source"] for r in source_mixing.mix_sources(docs(spark, table), {"rare": 0.9}).select("source").collect())
    assert abs(got["rare"] - 1800) < 6 * 1800**0.5 and abs(got["common"] - 200) < 6 * 200**0.5  # 900 copies of each rare row


# ---- op3 -------------------------------------------------------------------------------------------------------------------
def test_language_model_base_and_distribution(spark):
    rows = [(i, f"the cat sat on the mat number {i % 7} and the dog ran") for i in range(200)] + ODD
    got = suffix_tree_lm.score_documents(docs(spark, rows)).collect()
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(w for t in train for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    expected = collections.Counter()
    for i, t in rows:
        ws = [*words(t), None]
        expected[i, len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == expected
    assert {r["train_tokens"] for r in got} == {n}
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    tree, _ = suffix_tree_lm.train(docs(spark, rows))
    assert tree.levels[0]["kept"].any()
    for w in range(min(len(tree.words), 12)):  # over known words, each context's probabilities sum to at most 1, close to it
        k = len(tree.words)
        p = 10.0 ** np.array([tree.log_probabilities(np.array([w, x]), np.zeros(2, int))[1] for x in range(k)])
        assert 0.97 < p.sum() <= 1 + 1e-9
    assert suffix_tree_lm.score_documents(docs(spark, [])).count() == 0


def test_language_model_keeps_passages_of_a_large_corpus(spark, monkeypatch):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    filler = [(1000 + i, " ".join(f"w{(i * 7919 + j * j) % 997}" for j in range(2000))) for i in range(500)]  # a share of all tokens would be 5
    rows = [(i, passage) for i in range(4)] + filler
    gain = lambda: sorted((r["doc_id"], r["score"] - r["base_score"]) for r in suffix_tree_lm.score_documents(docs(spark, rows)).collect())
    whole = gain()
    assert all(g > 5 for i, g in whole if i < 4)
    monkeypatch.setattr(suffix_tree_lm, "FREQUENT", 20)  # nearly all grams go by the join
    assert np.allclose(gain(), whole)


def test_a_text_costs_no_row_for_each_bucket_of_the_tree(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * 7919 + j * j) % 997}" for j in range(60))) for i in range(1000)]
    whole = sorted(map(tuple, suffix_tree_lm.score_documents(docs(spark, rows)).collect()))
    monkeypatch.setattr(suffix_tree_lm, "FREQUENT", 20)
    monkeypatch.setattr(suffix_tree_lm, "BUCKET_TOKENS", 3000)  # 18 buckets of tokens
    made, write = {}, suffix_tree_lm.materialize

    def counted(df, tag):
        out = write(df, tag)
        made[tag] = out.count()
        return out

    monkeypatch.setattr(suffix_tree_lm, "materialize", counted)
    again = sorted(map(tuple, suffix_tree_lm.score_documents(docs(spark, rows)).collect()))
    assert [r[:5] for r in again] == [r[:5] for r in whole] and np.allclose([r[5:] for r in again], [r[5:] for r in whole])
    assert 0 < made["lm-found"] <= len(rows)


def test_blocks_of_texts_end_at_a_number_of_texts(spark, monkeypatch):
    rows = [(i, f"a b{i % 5} c{i % 3}") for i in range(300)] + ODD
    score = lambda: sorted((r["doc_id"] is None, r["doc_id"], round(r["score"], 6), r["n_known"]) for r in suffix_tree_lm.score_documents(docs(spark, rows)).collect())
    whole = score()
    monkeypatch.setattr(suffix_tree_lm, "FREQUENT", 3)
    monkeypatch.setattr(suffix_tree_lm, "BLOCK_TEXTS", 1)
    monkeypatch.setattr(suffix_tree_lm, "TREE_ROWS", 2)
    assert score() == whole


def test_words_are_added_up_whether_or_not_they_have_numbers():
    rng = np.random.default_rng(4)
    for width in (1, 2, 3, 4):
        words = [np.where(rng.random(5000) < 0.9, rng.integers(0, 40, 5000), rng.integers(-5, 5, 5000) * (1 << 60)) for _ in range(width)]
        n = rng.integers(1, 4, 5000)
        for counts in (n, np.ones(5000, np.int64)):
            expected = collections.Counter()
            for *row, c in zip(*words, counts):
                expected[tuple(row)] += c
            *got, total = suffix_tree_lm._added([*words, counts])
            assert dict(zip(zip(*got), total)) == expected and len(total) == len(expected)
            packed = suffix_tree_lm._pack([*got, total])
            assert all(np.array_equal(a, b) for a, b in zip(suffix_tree_lm._unpack(packed, len(total), width + 1), [*got, total]))
    zero = np.zeros(1, np.int64)
    assert all(np.array_equal(a, zero) for a in suffix_tree_lm._unpack(suffix_tree_lm._pack([zero, zero]), 1, 2))


def test_hashes_are_found_among_those_of_their_range():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 7, 3000):
        table = np.unique(rng.integers(-(1 << 63), 1 << 63, n))
        crowded = np.unique(np.concatenate([table, np.arange(-3, 40)])) if n > 2 else table
        for t in (table, crowded):
            keys = np.concatenate([t, rng.integers(-(1 << 63), 1 << 63, 2000), [-1, 0, (1 << 63) - 1, -(1 << 63)]])
            assert np.array_equal(suffix_tree_lm.Index(t).find(keys), suffix_tree_lm._find(t, keys))


# ---- op4 -------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("url,rule,verdict", [
    ("http://WWW.Example.NET/en/1", "example.net/en/", "allow"), ("http://www.example.net/de", "net/", "block"), ("https://example.com/de/x?q", "example.com/de/", "block"),
    ("http://notexample.com/de/", None, "allow"), ("http://a.org/fr/xxx", "org/fr/", "allow"), ("http://a.org/xxx", None, "block"), ("http://a.org/xxxl", None, "allow"),
    ("http://free.bets.org/", None, "block"), ("http://free.free.org/", None, "allow"), ("casino", None, "block"), (None, None, "allow"), ("", None, "allow"), ("net://", None, "allow"),
])
def test_url_verdicts(spark, url, rule, verdict):
    row = url_filter.judge_urls(spark.createDataFrame([(1, url, "h")], "page_id long, url string, host string")).first()
    assert (row["rule"], row["verdict"]) == (rule, verdict)


# ---- op6 -------------------------------------------------------------------------------------------------------------------
def segmentations(vocabulary, text):
    if not text:
        return [((), 1.0)]
    out = []
    for n in range(1, len(text) + 1):
        if text[:n] in vocabulary.pieces:
            i, w = vocabulary.pieces[text[:n]]
            out += [((i, *rest), w * p) for rest, p in segmentations(vocabulary, text[n:])]
    return out


def test_samples_are_distinct_and_follow_the_distribution():
    vocabulary = piece_sampling.Vocabulary(piece_sampling.MODEL, 1.0)
    lattices, n = piece_sampling.Lattices(vocabulary), 8000
    every = dict(segmentations(vocabulary, " the cat"))
    total = sum(every.values())
    p = {k: w / total for k, w in every.items()}
    found = piece_sampling.sample_chunk(lattices, ["the cat"] * n, mix64(np.arange(n, dtype=np.uint64)), 3)
    first, second, estimate = collections.Counter(), collections.Counter(), 0.0
    assert found.doc.tolist() == np.repeat(np.arange(n), 3).tolist() and found.turn.tolist() == [1, 2, 3] * n
    for i in range(0, 3 * n, 3):
        ids = [tuple(found.ids[found.first[j] : found.first[j + 1]].tolist()) for j in range(i, i + 3)]
        perturbed = found.perturbed[i : i + 3].tolist()
        assert len(set(ids)) == 3 and perturbed == sorted(perturbed, reverse=True)
        assert all(abs(math.log(p[x]) - found.log_prob[i + j]) < 1e-4 for j, x in enumerate(ids))
        first[ids[0]] += 1
        second[ids[1]] += 1
        estimate += sum(math.exp(found.log_prob[i + j] - found.log_inclusion[i + j]) for j in range(3))
    for k in sorted(p, key=p.get, reverse=True)[:4]:
        assert abs(first[k] / n - p[k]) < 0.025
        assert abs(second[k] / n - sum(p[a] * p[k] / (1 - p[a]) for a in p if a != k)) < 0.025
    assert abs(estimate / n - 1) < 0.01  # inclusion scores make unbiased weights


def test_units_are_cut_as_by_the_pattern():
    texts = ["a b  c\n\n  d \n", None, "", "\n", "   ", "x", " y\nz  ", "é \u4f60\u597d\t q"]
    codes, starts, lengths, first = piece_sampling.cut_units(texts)
    for i, text in enumerate(texts):
        got = ["".join(map(chr, codes[s : s + n])) for s, n in zip(starts[first[i] : first[i + 1]], lengths[first[i] : first[i + 1]])]
        assert got == (re.findall(r" *[^ \n]+| +|\n", " " + text)[::-1] if text else [])


def test_full_tables_change_no_sample(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"wort{x} the cat" for x in rng.integers(0, 10**6, 300)) for _ in range(12)]
    keys = mix64(np.arange(12, dtype=np.uint64))
    vocabulary = piece_sampling.Vocabulary(piece_sampling.MODEL, 1.0)
    whole = piece_sampling.sample_chunk(piece_sampling.Lattices(vocabulary), texts, keys, 2)
    monkeypatch.setattr(piece_sampling, "CACHED_BYTES", 300_000)
    monkeypatch.setattr(piece_sampling, "BLOCK_CHARS", 500)
    small = piece_sampling.Lattices(vocabulary)
    for i in range(12):
        got = piece_sampling.sample_chunk(small, texts[i : i + 1], keys[i : i + 1], 2)
        own = np.flatnonzero(whole.doc == i)
        assert got.ids.tolist() == whole.ids[whole.first[own[0]] : whole.first[own[-1] + 1]].tolist()
        assert np.allclose(got.log_prob, whole.log_prob[own]) and np.allclose(got.log_inclusion, whole.log_inclusion[own])


def test_units_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(piece_sampling, "range_hashes", lambda codes, starts, lengths, seed=0: lengths.astype(np.uint64) if not seed else range_hashes(codes, starts, lengths, seed))
    lattices = piece_sampling.Lattices(piece_sampling.Vocabulary(piece_sampling.MODEL, 1.0))
    found = piece_sampling.sample_chunk(lattices, ["cat dog", "dog cat"], mix64(np.arange(2, dtype=np.uint64)), 1)
    assert piece_sampling.Speller(lattices.v.spelled)(*piece_sampling.spelled(found, np.array(lattices.v.byte_ids, np.int32))) == [b"cat dog", b"dog cat"]


def test_encoding_round_trip(spark):
    table = docs(spark, ODD + [(20, "a\nb\r\n  c \u0000 \U0001f600 é")])
    encoded = piece_sampling.encode(table, samples=3, keep=("doc_id", "text"), verify=True)
    rows = piece_sampling.decode(encoded.select("doc_id", "text", "sample", "ids", "exact")).collect()
    assert all(r["decoded"] == r["text"] for r in rows)
    assert {r["doc_id"] for r in rows} == {i for i, _ in ODD} | {20} and max(r["sample"] for r in rows) == 3
    again = piece_sampling.encode(table.repartition(1), samples=3).select("doc_id", "sample", "ids").collect()
    key = lambda r: (r["doc_id"] or -1, r["sample"], tuple(r["ids"] or ()))
    assert sorted(map(key, again)) == sorted(map(key, encoded.select("doc_id", "sample", "ids").collect()))
    assert piece_sampling.encode(docs(spark, [])).count() == 0


# ---- op7 -------------------------------------------------------------------------------------------------------------------
def test_toxicity_learns_new_words(spark):
    rows = [(i, "plain words about the weather " + ("grelkator you zumfitz" if i % 4 == 0 else "and a garden") + f" {i}") for i in range(600)] + ODD
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(docs(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] > 8]
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.97
    assert {r["score"] for r in toxicity.score_documents(docs(spark, ODD), labels.limit(0)).collect()} == {0.0}


# ---- op8 -------------------------------------------------------------------------------------------------------------------
def dedup_by_hand(rows):
    held = collections.defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20 and i is not None:
                held[key(line)].add(i)
    out = collections.Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(held[key(x)]) < 3 or i is None or i == max(held[key(x)])]
        out[i, len(lines), len(lines) - len(stay), "\n".join(stay)] += 1
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (7, 3)])
def test_line_dedup(spark, batches, fanout):
    common = ["this line is shared by many documents", "ÉÉ exactly twenty c.", "SHORT", "Another long shared line, with CAPS"]
    rows = [(i, "\n".join([f"own line number {i} of its document", f"  {common[i % 4].upper() if i % 2 else common[i % 4]}\t", common[0], common[0]][: 1 + i % 4])) for i in range(40)]
    rows += [(None, common[0]), (100, None), (101, ""), (102, common[0] + "\n" + LONG), (7, rows[7][1])]
    rows += [(7, "another text of the same id\n" + common[0]), (10**12, common[2])]
    got = line_dedup.dedup_lines(docs(spark, rows), batches=batches, fanout=fanout, keep=("doc_id", "text", "extra")).collect()
    assert collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got) == dedup_by_hand(rows)
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter(rows)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_frequent_lines_go_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HEAVY", 20)
    test_line_dedup(spark, 3, 2)


def test_line_runs_stay_for_later_batches(spark, tmp_path):
    line, at = "this line is shared by many documents", str(tmp_path / "runs")
    old = [(i, f"{line}\nand another one of document {i}") for i in range(50, 53)]
    new = [(i, f"{line}\nand a third kind in document {i}") for i in range(100, 102)]
    first = line_dedup.dedup_lines(docs(spark, old), directory=at).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in first} == {50: 1, 51: 1, 52: 0}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("run_")]  # nothing but the folder is left to find them
    (tmp_path / "runs" / "run_0_left").mkdir()  # of a call that was lost half-way
    later = line_dedup.dedup_lines(docs(spark, new), directory=at).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in later} == {100: 1, 101: 1}  # the keeper is of the first batch, though its id is smaller
    runs = line_dedup.LineRuns(spark, at)
    assert runs.runs()[0].agg(F.max("n_docs")).first()[0] == 5 and len(list((tmp_path / "runs" / "manifest").iterdir())) == 1
    runs.close()


def test_a_lost_call_leaves_the_runs_as_they_were(spark, tmp_path):
    at = str(tmp_path / "runs")
    text = "\n".join(f"a long line of text, number {i}" for i in range(30))
    line_dedup.dedup_lines(docs(spark, [(i, text) for i in range(4)]), directory=at).collect()
    lost = line_dedup.LineRuns(spark, at)
    lost.add(line_dedup.line_keys(docs(spark, [(i, text) for i in range(10, 14)])))
    lost.compacted()  # merged, but never committed
    lost.close()
    later = line_dedup.dedup_lines(docs(spark, [(i, text) for i in range(20, 22)]), directory=at).collect()
    assert {r["n_dropped"] for r in later} == {30}
    runs = line_dedup.LineRuns(spark, at)
    assert {r["n_docs"] for r in runs.runs()[0].collect()} == {6}
    runs.close()


def test_a_small_later_batch_broadcasts_its_own_heavy_keys_alone(spark, tmp_path, monkeypatch):
    at, sides = str(tmp_path / "runs"), []
    line_dedup.dedup_lines(docs(spark, [(i, "\n".join(f"a long line of text, number {j}" for j in range(600))) for i in range(3)]), directory=at).collect()
    given = F.broadcast
    monkeypatch.setattr(line_dedup.F, "broadcast", lambda df: (sides.append(df.count()), given(df))[1])
    got = line_dedup.dedup_lines(docs(spark, [(9, "a long line of text, number 7\na line that no other has, whatever")]), directory=at).collect()
    assert got[0]["n_dropped"] == 1 and max(sides) <= 2


def test_runs_are_merged_without_exchange_or_sort(spark, tmp_path):
    keys = line_dedup.line_keys(docs(spark, [(i, f"a long line of document number {i}\nand a line that is shared") for i in range(300)])).persist()
    runs = line_dedup.LineRuns(spark, str(tmp_path / "runs"), 3)
    runs.add(keys.where("doc_id >= 200"))
    runs.add(keys.where("doc_id between 100 and 199"))
    with line_dedup._ordered_buckets(spark):
        plan = runs.joined(keys.where("doc_id < 100"))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and plan.count("Bucketed: true") == 2
        assert plan.count(" Sort ") == 1 and plan.count("Exchange hashpartitioning") == 2  # of the batch alone
        held = {r["keeper"]: r["n_docs"] for r in runs.joined(keys.where("doc_id < 100")).where("keeper is null or keeper = 99").collect()}
    assert held == {None: 100, 99: 1}
    runs.drop()


def test_the_commonest_rows_are_bounded(spark):
    same = spark.range(5000).select(F.col("id").alias("key"), F.lit(7).cast("long").alias("n"))
    for table in (same, same.withColumn("n", F.col("key") * 10), same.withColumn("n", F.lit(10**7).cast("long"))):
        common, other = suffix_tree_lm._frequent(table, 1000)
        assert 500 < common.count() <= 1000 and common.count() + other.count() == 5000
        assert common.agg(F.min("n")).first()[0] >= 0.98 * other.agg(F.max("n")).first()[0]
    assert suffix_tree_lm._frequent(same, 5000)[0].count() == 5000


def test_depth_is_checked(spark):
    with pytest.raises(ValueError):
        suffix_tree_lm.score_documents(docs(spark, [(1, "a")]), depth=4)


# ---- op9 -------------------------------------------------------------------------------------------------------------------
def groups_by_hand(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {(i, len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(spark):
    rng = np.random.default_rng(5)
    base = [[f"w{x}" for x in rng.integers(0, 5000, n)] for n in (40, 60, 200, 12)]
    rows = []
    for i in range(160):  # near copies on both sides of the threshold, exact copies, short texts
        w = list(base[i % 4])
        for j in rng.integers(0, len(w), rng.integers(0, 4)):
            w[j] = f"x{i}{j}"
        rows.append((i, " ".join(w).upper() if i % 5 == 0 else "  ".join(w)))
    rows += [(200 + i, t) for i, t in enumerate(["a b c", "A b  c", "a b", None, "", " \n", LONG, LONG + " word", "e f g h i", "e f g h i j"])]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(docs(spark, [*rows, (None, "a b c")])).collect()}
    assert got == groups_by_hand(rows) | {(None, 1, None)}
    assert minhash_dedup.near_duplicates(docs(spark, [])).count() == 0
    assert minhash_dedup.near_duplicates(docs(spark, [(1, "q w e r t y"), (1, "q w e r t y")])).count() == 2


def test_large_groups_meet_by_prefix(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "SMALL", 2)
    test_near_duplicates(spark)


def test_candidates_are_closed_in_turns(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "TURNS", (1, 1))
    test_large_groups_meet_by_prefix(spark, monkeypatch)


def test_bitmaps_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 400, n).astype(np.uint64)) for n in rng.integers(0, 300, 60)]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    bits = minhash_dedup.parity_bitmaps(offsets, np.concatenate(sets))
    for i, j in itertools.combinations(range(60), 2):
        apart = sum(int(x).bit_count() for x in (bits[i] ^ bits[j]).view(np.uint64))
        assert apart <= len(np.setxor1d(sets[i], sets[j]))


def test_components(spark):
    links = [(1, 2), (3, 2), (4, 5), (9, 8), (8, 7), (7, 4), (6, 6), (None, 1)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 4, 8: 4, 9: 4}


# ---- op10 ------------------------------------------------------------------------------------------------------------------
def test_language_profiles(spark):
    say = {"en": "the quick brown fox jumps over the lazy dog and runs away", "de": "der schnelle braune fuchs springt über den faulen hund und läuft", "el": "η γρήγορη καφέ αλεπού πηδάει"}
    rows = [(i, f"{say[lang]} {i}", lang) for i, lang in zip(range(10, 130), itertools.cycle(say))] + [(*r, None) for r in ODD] + [(300, "123 !? 456", "en")]
    got = language_id.identify(docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: lang for i, _, lang in rows}
    assert all(r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"] and 10 <= (r["doc_id"] or 0) < 130)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 300)} == {"und"}
    assert {r["lang_pred"] for r in language_id.identify(docs(spark, [(1, "text", None)])).collect()} == {"und"}
    assert language_id.identify(docs(spark, [])).count() == 0


def test_components_go_on_from_found_ones_and_stop_at_stars(spark, monkeypatch):
    rounds = []
    write = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, tag: rounds.append(tag) or write(df, tag))
    linked = lambda links, *found: components.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b", *found)
    found = linked([(1, 2), (3, 1), (9, 8), (4, 4), (None, 5)])
    assert len(rounds) == 1  # the edges are stars as they are
    assert {tuple(r) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}
    assert {tuple(r) for r in linked([(9, 3), (20, 21)], found).collect()} == {(1, 1), (2, 1), (3, 1), (8, 1), (9, 1), (20, 20), (21, 20)}
    assert {tuple(r) for r in linked([], found).collect()} == {tuple(r) for r in found.collect()}
    chain = [(i, i + 1) for i in range(50)]
    assert {tuple(r) for r in linked(chain[::2], linked(chain[1::2])).collect()} == {(i, 0) for i in range(51)}
