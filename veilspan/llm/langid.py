"""Language ID by nearest centroid: normalised TF-IDF vectors of hashed character trigrams, several clustered
centroids for each language, cosine, and rejection by distance.

A text's trigrams are those of its lower-cased letters with every run of other characters as one blank, without
tokens that hold a digit or an @. The model is fitted on a bounded sample of labelled rows: at most ``SAMPLE`` distinct
texts, dealt evenly over the ``MOST_LANGUAGES`` commonest languages, those with the least hashes of their text. Prediction
reads every whole text in blocks of ``BLOCK`` characters.

Defined cases: a null text, or one without letters, is ``und`` with score 0 and rejected; ties go to the language
that sorts first; no labelled text at all gives ``und`` for every text; null and repeated doc_ids and repeated texts are
sampled like any other, a text once; very long texts are read whole; other columns pass through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hand_back, text_batches, worker_cache

DIMENSIONS = 1 << 14
CENTROIDS = 4
#: Most labelled texts that a fit reads, and most languages that it learns.
SAMPLE, MOST_LANGUAGES = 4096, 512
BLOCK = 1 << 20
#: A text is rejected if its cosine is under this share of the least cosine of its language's training texts. A text of few
#: trigrams can't come as close to a centroid, so under ``ENOUGH`` of them the bound falls with the root of their number.
REJECT_SHARE, ENOUGH = 0.5, 64
UND = "und"

_CODES = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")

_letters: np.ndarray | None = None


def _is_letter(points: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x20000)), dtype=bool, count=0x20000)
    known = points < 0x20000
    if known.all():
        return _letters[points]
    return np.where(known, _letters[np.where(known, points, 0)], np.array([chr(p).isalpha() for p in points.tolist()], dtype=bool))


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Bins that occur, ascending, and how often. Empty if there is no letter. Tokens with a digit or an @ in them (keys,
    addresses, numbers) are no language and left out, unless nothing else is there."""
    bins, counts = _trigrams(_CODES.sub(" ", text)) if text else _trigrams(text)
    return (bins, counts) if len(bins) or not text else _trigrams(text)


def _trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(DIMENSIONS, dtype=np.int64)
    carry = np.array([32], dtype=np.uint32)
    seen = False
    text = text or ""
    for at in range(0, len(text), BLOCK):
        points = np.frombuffer(text[at : at + BLOCK].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = _is_letter(points)
        if letter.any():
            seen = True
        line = np.concatenate([carry, np.where(letter, points, 32), [32] if at + BLOCK >= len(text) else []]).astype(np.uint32)
        blank = line == 32
        keep = np.ones(len(line), dtype=bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        line = line[keep]
        if len(line) >= 3:
            h = (line[:-2] * np.uint32(0x9E3779B1)) ^ (line[1:-1] * np.uint32(0x85EBCA77)) ^ (line[2:] * np.uint32(0xC2B2AE3D))
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            total += np.bincount(h >> np.uint32(18), minlength=DIMENSIONS)
        carry = line[-2:]
    if not seen:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    bins = np.flatnonzero(total)
    return bins, total[bins]


@dataclass
class Model:
    langs: list[str]
    of: np.ndarray  # language of each centroid
    centroids: np.ndarray  # centroids x dimensions, of length 1
    idf: np.ndarray
    least: np.ndarray  # by language: least cosine of its training texts

    def weigh(self, bins: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[bins]
        return w / max(float(np.sqrt(w @ w)), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        bins, counts = trigrams(text)
        if not len(bins) or not self.langs:
            return UND, 0.0, True
        cosines = self.centroids[:, bins] @ self.weigh(bins, counts)
        k = int(np.argmax(cosines))  # the first of equals: centroids stand in the order of languages
        score = float(min(1.0, max(0.0, cosines[k])))
        return self.langs[self.of[k]], score, score < REJECT_SHARE * float(self.least[self.of[k]]) * min(1.0, len(bins) / ENOUGH) ** 0.5


def fit_vectors(rows: list[tuple[str, np.ndarray, np.ndarray]], centroids: int = CENTROIDS) -> Model:
    """Spherical k-means in each language over the sampled vectors, from farthest-first seeds. Vectors stay sparse: one
    language's weights are held at a time, as one run of bins."""
    langs = sorted({lang for lang, _, _ in rows})
    df = np.zeros(DIMENSIONS)
    for _, bins, _ in rows:
        df[bins] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    model = Model(langs, np.empty(0, dtype=int), np.empty((0, DIMENSIONS)), idf, np.zeros(len(langs)))
    of, stacked = [], []
    for i, lang in enumerate(langs):
        own = [(b, c) for name, b, c in rows if name == lang]
        size = np.array([len(b) for b, _ in own])
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        bins = np.concatenate([b for b, _ in own])
        weight = np.concatenate([model.weigh(b, c).astype(np.float32) for b, c in own])
        row = np.repeat(np.arange(len(own)), size)

        def cosines(c: np.ndarray, bins=bins, weight=weight, starts=starts) -> np.ndarray:
            """Inner products of all vectors with a dense one."""
            return np.add.reduceat(weight * c.astype(np.float32)[bins], starts)

        def dense(k: int, own=own) -> np.ndarray:
            out = np.zeros(DIMENSIONS)
            out[own[k][0]] = model.weigh(*own[k])
            return out

        seeds = [int(np.argmax(cosines(np.bincount(bins, weights=weight, minlength=DIMENSIONS) / len(own))))]
        near = cosines(dense(seeds[0]))
        while len(seeds) < min(centroids, len(own)):
            k = int(np.argmin(near))
            if near[k] > 1 - 1e-6:
                break
            seeds.append(k)
            near = np.maximum(near, cosines(dense(k)))
        c = np.stack([dense(k) for k in seeds])
        for _ in range(10):
            to = np.argmax(np.stack([cosines(x) for x in c]), axis=0)
            sums = [np.bincount(bins, weights=weight * (to == k)[row], minlength=DIMENSIONS) if (to == k).any() else c[k] for k in range(len(c))]
            c = np.stack(sums)
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        model.least[i] = float(np.stack([cosines(x) for x in c]).max(axis=0).min())
        of += [i] * len(c)
        stacked.append(c)
    if stacked:
        model.of, model.centroids = np.array(of), np.concatenate(stacked)
    return model


def fit(labelled: DataFrame, lang: Column, text: Column, sample: int | None = None, centroids: int = CENTROIDS) -> Model:
    """Fit on at most ``sample`` texts of the labelled rows. Only trigram counts of the sampled texts come to the
    driver, never texts."""
    spark = labelled.sparkSession
    # the upper half of a 64-bit hash, as a number from 0 to 2^32; equal texts are one
    rows = labelled.select(lang.cast("string").alias("lang"), text.alias("text"), F.xxhash64(text, F.lit("fit")).alias("h")).filter("lang is not null and text is not null")
    rows = rows.withColumn("spot", F.shiftrightunsigned("h", 32))
    kinds = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h", 0.05).alias("texts"))
    counts = {r["lang"]: r["texts"] for r in kinds.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    if not counts:
        return fit_vectors([])
    each = max(1, (sample or SAMPLE) // len(counts))
    # a share that holds ``each`` texts for certain, up to chance, then exactly the least of them
    bounds = [(name, int(min(1.0, (2 * each + 64) / max(n, 1)) * (1 << 32))) for name, n in counts.items()]
    table = spark.createDataFrame(bounds, "lang string, most long")
    chosen = rows.join(F.broadcast(table), "lang").filter(F.col("spot") < F.col("most")).select("lang", "h", "text").dropDuplicates(["lang", "h"])
    chosen = chosen.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= each).select("lang", "text")
    text_batches(spark)

    def vectors(batches):
        for b in batches:
            out = [(name, *(x.astype(kind).tobytes() for x, kind in zip(trigrams(t), ("<u2", "<u4"), strict=True))) for name, t in zip(b["lang"], b["text"], strict=True)]
            yield pd.DataFrame([x for x in out if x[1]], columns=["lang", "bins", "counts"])

    got = chosen.mapInPandas(vectors, "lang string, bins binary, counts binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["bins"]), bytes(r["counts"])))
    model = fit_vectors([(r["lang"], np.frombuffer(r["bins"], dtype="<u2"), np.frombuffer(r["counts"], dtype="<u4")) for r in got], centroids)
    del got
    hand_back()
    return model


def predictor(model: Model):
    """A column function: text to struct(lang_pred, score, rejected)."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        worker_cache("languages")  # none of its own: the others' go
        for texts in batches:
            yield pd.DataFrame([model.predict(t if isinstance(t, str) else None) for t in texts], columns=["lang_pred", "score", "rejected"])
        hand_back()

    return predict


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from the fit: crc32 of doc_id as text, modulo 3, is 1 (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, labelled: DataFrame | None = None, out: str = "language") -> DataFrame:
    """``docs`` with one more column, a struct of lang_pred, score and rejected. Fits on ``labelled`` (columns
    doc_id, text, lang; the held-out documents are left out), by default on ``docs``."""
    rows = docs if labelled is None else labelled
    text_batches(docs.sparkSession)
    model = fit(rows.filter(~held_out(F.col("doc_id"))), F.col("lang"), F.col("text"))
    return docs.withColumn(out, predictor(model)(F.col("text")))
