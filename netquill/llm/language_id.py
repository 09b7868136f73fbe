"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 drawn from its code point. A trigram binds its letters: the first vector
rotated twice, the second once, the third as it is, multiplied element-wise; the gap between words is a letter of its own.
Adding the vectors of all trigrams bundles a document or, over all training documents of a language, its prototype. A
document gets the language whose prototype has the greatest cosine with it.

Cases: null text and text without letters is ``und`` with score 0, so is everything when no training row has a language;
letters are those of Unicode, lower-cased; cosines tie to the smaller language name; rows are returned one for one, repeated
or null ``doc_id`` included (a null id is never held out); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquill.llm.common import documents_of, mod_of_id, text_chunks

DIMENSIONS = 512
BLOCK = 128  # documents multiplied at once
_GAP = 0


class Letters:
    """Numbers and vectors of the letters met so far in this worker; number 0 is the gap."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.number = np.full(0x110000, -1, np.int32)
        self.vectors = [self._vector(0)]

    def _vector(self, code: int) -> np.ndarray:
        return np.random.default_rng([20, code]).integers(0, 2, self.dimensions, np.int8) * np.int8(2) - np.int8(1)

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        met = np.zeros(0x110000, bool)
        met[codes] = True
        for code in np.flatnonzero(met & (self.number < 0)):
            low = chr(code).lower()[:1]
            if not low.isalpha():
                self.number[code] = _GAP
            else:
                if self.number[ord(low)] < 0:
                    self.number[ord(low)] = len(self.vectors)
                    self.vectors.append(self._vector(ord(low)))
                self.number[code] = self.number[ord(low)]
        return self.number[codes]

    def trigrams(self, grams: np.ndarray, base: int) -> np.ndarray:
        table = np.stack(self.vectors)
        first, second, third = grams // (base * base), grams // base % base, grams % base
        return np.roll(table, 2, axis=1)[first] * np.roll(table, 1, axis=1)[second] * table[third]


def _distinct(grams: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams and each one's position among them."""
    if base**3 > 1 << 23:
        return np.unique(grams, return_inverse=True)
    met = np.zeros(base**3, bool)
    met[grams] = True
    found = np.flatnonzero(met)
    place = np.zeros(base**3, np.int64)
    place[found] = np.arange(len(found))
    return found, place[grams]


def profile(letters: Letters, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Document number and trigram of every occurrence, whether a document has letters, and the base of trigram numbers."""
    decoded = [t.decode() for t in texts]
    codes = np.frombuffer(("\n" + "\n".join(decoded) + "\n").encode("utf-32-le"), np.uint32)
    number = letters.numbers(codes)
    ends = np.cumsum([len(t) + 1 for t in decoded])
    doc = np.searchsorted(ends, np.arange(len(number)) - 1, side="right")
    keep = number > _GAP
    keep[1:] |= number[:-1] > _GAP  # one gap after each word
    keep[0] = True
    number, doc = number[keep].astype(np.int64), doc[keep]
    base = len(letters.vectors)
    lettered = np.zeros(len(texts), bool)
    lettered[doc[number > _GAP]] = True
    grams = (number[:-2] * base + number[1:-1]) * base + number[2:]
    inner = number[1:-1] > _GAP
    return doc[1:-1][inner], grams[inner], lettered, base


def train(docs: DataFrame, dimensions: int = DIMENSIONS, max_languages: int = 1000) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, from all rows with text and a language.

    The prototypes, one row of ``dimensions`` numbers for each language, are all that reaches the driver.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = Letters(dimensions), {}
        for batch, texts in text_chunks(batches):
            names = batch.column(1).to_pylist()
            kinds = sorted(set(names))
            of = np.array([kinds.index(x) for x in names])
            doc, grams, _, base = profile(letters, texts)
            found, place = _distinct(grams, base)
            counts = np.bincount(of[doc] * len(found) + place, minlength=len(kinds) * len(found)).reshape(len(kinds), len(found))
            made = counts.astype(np.float64) @ letters.trigrams(found, base).astype(np.float64)
            for kind, row in zip(kinds, made):
                sums[kind] = sums.get(kind, 0) + row.astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], names=["lang", "bundle"]
        )

    rows = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(bundle, "lang string, bundle array<long>")
    summed = rows.select("lang", F.posexplode("bundle").alias("at", "part")).groupBy("lang", "at").agg(F.sum("part").alias("part"))
    found = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("parts")).limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    found = sorted((r["lang"], [x["part"] for x in r["parts"]]) for r in found if any(x["part"] for x in r["parts"]))
    table = np.array([x[1] for x in found], np.float64).reshape(len(found), dimensions)
    return [x[0] for x in found], table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)


def predict(docs: DataFrame, languages: list[str], prototypes: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``lang_pred`` and ``score`` (the cosine, 0 at least)."""
    dimensions = prototypes.shape[1]
    names = np.array([*languages, "und"], object)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, aim = Letters(dimensions), prototypes.T.astype(np.float32)
        for batch, texts in text_chunks(batches):
            doc, grams, lettered, base = profile(letters, texts)
            found, place = _distinct(grams, base)
            vectors = letters.trigrams(found, base).astype(np.float32)
            best, score = np.full(len(texts), len(languages)), np.zeros(len(texts))
            cuts = np.searchsorted(doc, np.arange(0, len(texts) + BLOCK, BLOCK))
            for i, (low, high) in enumerate(zip(cuts[:-1], cuts[1:])):
                if high > low and languages:
                    n = min(BLOCK, len(texts) - i * BLOCK)
                    cell = (doc[low:high] - i * BLOCK) * len(found) + place[low:high]
                    counts = np.bincount(cell, minlength=n * len(found)).reshape(n, len(found)).astype(np.float32)
                    bundles = counts @ vectors
                    cosine = (bundles @ aim) / np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-12)
                    at, own = np.arange(i * BLOCK, i * BLOCK + n), lettered[i * BLOCK : i * BLOCK + n]
                    best[at] = np.where(own, cosine.argmax(axis=1), len(languages))
                    score[at] = np.where(own, cosine.max(axis=1), 0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1))], names=[*keep, "lang_pred", "score"]
            )

    kept = docs.select(*dict.fromkeys((*keep, "text")))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return kept.mapInArrow(label, ", ".join([*kinds, "lang_pred string", "score double"]))


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, learned from the rows whose crc32(doc_id) modulo ``folds`` isn't ``held_out``."""
    docs = documents_of(docs, "doc_id", "text", "lang")
    out = F.coalesce(mod_of_id(docs["doc_id"], folds) == held_out, F.lit(False))
    languages, prototypes = train(docs.where(~out))
    return predict(docs.select("doc_id", "text"), languages, prototypes).withColumn("held_out", F.coalesce(mod_of_id(F.col("doc_id"), folds) == held_out, F.lit(False)))
