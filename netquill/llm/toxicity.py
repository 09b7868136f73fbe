"""Toxicity scores from gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of a fixed lexicon and of words and word stems learned from the labels, their nearness to the
second person, capitals, punctuation and obfuscated spellings. Labels are learned from at most about ``max_rows`` labelled
rows, chosen by a hash of their id, and at most ``max_lexicon`` words and stems, the strongest, are learned from those. Another hash deals them into tenths: 0-3 teach the lexicon, 4-7 the trees, 8-9 the
calibration, so that no row is judged by words it brought itself.

Cases: null and empty texts have all densities 0 and get a score like others; labels with null ``toxic`` or ``doc_id`` are
left out, of repeated ones the greatest counts; without labels every score is 0, with one class only every score is that
class; documents are returned one for one, with repeated and null ids (a null id is not held out); an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquill.llm.common import documents_of, materialize, mod_of_id, text_chunks

STEMS = (4, 5, 6)  # letters of the word beginnings that are learned besides whole words
#: Common insults of four languages.
INSULTS = frozenset(
    "idiot idiots moron morons stupid loser losers pathetic worthless disgusting trash scum clown dumb fool jerk ugly hate kill shut filthy vermin"
    " dumm idioten blöd blödmann arschloch trottel dreck abschaum hässlich wertlos verlierer"
    " imbécile crétin abruti connard connasse salaud ordure minable nul débile raclure"
    " idiota estúpido estúpida imbécil tonto tonta basura asco inútil perdedor escoria patético".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
NEAR = 5
FEATURES = (
    "log_words", "insult_rate", "insults", "word_rate", "words", "stem_rate", "stems", "weight_rate", "top_weight", "near_you", "you_rate",
    "capital_rate", "shout_rate", "exclaim_rate", "punct_rate", "masked_rate", "masked_insults",
)
_WORD = re.compile(r"\w+")
_MASKED = re.compile(r"(?<!\S)[^\W\d_]+(?:[0-9@$!*#]+[^\W\d_]+)+")
_UNMASK = str.maketrans("013457@$!", "oieastasi")
_PUNCT = re.compile(r"[^\w\s]")


def _tokens(text: str) -> set[str]:
    """Words of a text and their beginnings, the latter marked by a star."""
    words = set(_WORD.findall(text.lower()))
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}


def learn_lexicon(sample: DataFrame, min_docs: int = 5, min_odds: float = 3.0, max_lexicon: int = 2_000) -> dict[str, float]:
    """Words and beginnings that mark toxic texts, with their log odds: the ``max_lexicon`` strongest of all that pass."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            seen = (Counter(), Counter())
            for text, toxic in zip(texts, batch.column(1).to_pylist()):
                seen[toxic].update(_tokens(text.decode()))
            tokens = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens, pa.string()), *(pa.array([s[t] for t in tokens], pa.int64()) for s in seen)], names=["token", "clean", "toxic"]
            )

    classes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    counts = sample.select("text", "toxic").mapInArrow(count, "token string, clean long, toxic long")
    counts = counts.groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("toxic") >= min_docs)
    share = lambda c, n: F.log((F.col(c) + 0.5) / (n + 1.0))
    odds = (share("toxic", classes.get(1, 0)) - share("clean", classes.get(0, 0))).alias("odds")
    top = counts.select("token", odds, "toxic").where(F.col("odds") >= min_odds).orderBy(F.desc(F.col("odds") * F.log1p("toxic")), "token").limit(max_lexicon)
    return {r["token"]: r["odds"] for r in top.collect()}


def features(docs: DataFrame, lexicon: dict[str, float], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``FEATURES`` of each text."""
    whole = {t: w for t, w in lexicon.items() if t[-1] != "*"}
    stems = {t[:-1]: w for t, w in lexicon.items() if t[-1] == "*"}
    lengths = sorted({len(t) for t in stems})

    def of(text: str) -> list[float]:
        words = _WORD.findall(text.lower())
        n = max(len(words), 1)
        marks = {}  # position: weight
        insults = hits = stemmed = 0
        for i, w in enumerate(words):
            weight = whole.get(w)
            if w in INSULTS:
                insults += 1
                marks[i] = weight or 1.0
            if weight is not None:
                hits += 1
                marks[i] = weight
            for m in lengths:
                if (weight := stems.get(w[:m])) is not None and len(w) > m:
                    stemmed += 1
                    marks[i] = max(weight, marks.get(i, 0.0))
                    break
        you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        at = list(marks)  # ascending
        near = sum((j := bisect_left(at, i - NEAR)) < len(at) and at[j] <= i + NEAR for i in you)
        masked = _MASKED.findall(text)
        unmasked = sum((x := m.lower().translate(_UNMASK)) in INSULTS or x in whole for m in masked)
        chars = max(len(text), 1)
        capitals = sum(map(str.isupper, text))
        shouted = sum(len(w) > 2 and w.isupper() for w in text.split()) if capitals > 2 else 0
        total = sum(marks.values())
        return [
            math.log1p(len(words)), insults / n, insults, hits / n, hits, stemmed / n, stemmed, total / n, max(marks.values(), default=0.0), near / n, len(you) / n,
            capitals / chars, shouted / n, text.count("!") / n, len(_PUNCT.findall(text)) / chars, len(masked) / n, unmasked,
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            rows = [of(t.decode()) for t in texts]
            columns = [pa.array([float(r[i]) for r in rows]) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *columns], names=[*keep, *FEATURES])

    given = docs.select(*dict.fromkeys((*keep, "text")))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return given.mapInArrow(run, ", ".join([*kinds, *(f"{c} double" for c in FEATURES)]))


def labelled_sample(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, max_rows: int = 20_000) -> DataFrame:
    """``text, toxic, part`` of about ``max_rows`` labelled rows outside the held-out fold; ``part`` from 0 to 9."""
    rows = labels.where("doc_id is not null and toxic in (0, 1)").where(mod_of_id(labels["doc_id"], folds) != held_out)
    rows = rows.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    share = max_rows / max(rows.count(), 1)
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "label_id"), F.lit(1 << 30)) < share * (1 << 30))
    part = F.pmod(F.xxhash64(F.lit("part"), "label_id"), F.lit(10)).alias("part")
    # the sample is bounded by max_rows, a few hundred kilobytes of ids
    return docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["label_id"]).select("text", "toxic", part)


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, max_rows: int = 20_000, max_lexicon: int = 2_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; about ``max_rows`` labels and ``max_lexicon`` words are learned from."""
    docs = documents_of(docs, "doc_id", "text")
    sample = materialize(labelled_sample(docs, documents_of(labels, "doc_id", "toxic"), folds, held_out, max_rows), "toxicity-sample")
    classes = [r["toxic"] for r in sample.select("toxic").distinct().collect()]
    out = F.coalesce(mod_of_id(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out")
    if len(classes) < 2:
        constant = float(classes[0]) if classes else 0.0
        return docs.select("doc_id", out, F.lit(constant).alias("score"), F.lit(int(constant >= 0.5)).alias("predicted"))
    lexicon = learn_lexicon(sample.where("part < 4"), max_lexicon=max_lexicon)
    made = materialize(features(sample.where("part >= 4"), lexicon, ("toxic", "part")), "toxicity-features")
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    vectors = assembler.transform(made).select("features", F.col("toxic").cast("double").alias("label"), "part")
    fit, check = vectors.where("part < 8"), vectors.where("part >= 8")
    several = lambda df: df.select("label").distinct().count() == 2
    if not several(fit):
        fit = check = vectors
    if not several(fit):
        mean = float(sample.agg(F.avg("toxic")).first()[0])
        return docs.select("doc_id", out, F.lit(mean).alias("score"), F.lit(int(mean >= 0.5)).alias("predicted"))
    trees = GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.2, seed=3, subsamplingRate=0.9).fit(fit)
    raw = lambda df: trees.transform(df).withColumn("raw", vector_to_array("probability")[1])
    scored = raw(assembler.transform(features(docs, lexicon)))
    if several(check):
        levels = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(raw(check))
        scored = levels.transform(scored.drop("prediction"))
    else:
        scored = scored.withColumn("score", F.col("raw"))
    score = F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))
    return scored.select("doc_id", out, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
