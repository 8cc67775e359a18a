"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of letter n-grams (one to three letters,
hashed); each language has several centroids, found by spherical k-means on its
training texts; a text gets the language of the centroid with the largest cosine.
A text too far from all centroids is rejected: its distance is over the limit
that training texts of about the same length set.

Training takes a bounded sample of labelled rows (``FIT_ROWS``, chosen by the hash
of their text, so any input order gives the same model); the prediction covers
every row and every whole text.

Defined cases: a null text, or one without letters, gets ``und``, score 0 and is
rejected. Without any training row every text gets ``und``. Equal texts get equal
results; ties go to the language first in order. Null ids are kept.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidevec.llm.common import bounded_sample, pick

DIM = 1 << 13
FIT_ROWS = 2000  # bound on the labelled rows a model is fitted on
CENTROIDS = 4  # a language
ROUNDS = 12
#: A text is rejected if its distance is over SLACK times the largest seen in training for its length class.
SLACK = 1.25
#: Texts of fewer n-grams than this say little, so only nearly orthogonal ones are rejected.
SHORT, SHORT_LIMIT = 64, 0.97


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point -> whether it is a letter."""
    known = np.zeros(0x110000, bool)
    for start, stop in ((0, 0x323B0), (0xE0000, 0xE0200)):
        known[start:stop] = [chr(c).isalpha() for c in range(start, stop)]
    return known


def counts(text: str) -> np.ndarray | None:
    """Counts of hashed n-grams over the whole text, or None if it has no letter.

    Runs of other characters count as one boundary, so digits and signs leave no trace.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ok = _letters()[codes]
    if not ok.any():
        return None
    codes = np.where(ok, codes, 0)
    keep = ok.copy()
    keep[1:] |= ok[:-1]  # a boundary after each run of letters
    codes = codes[keep]
    codes = np.concatenate(([0], codes, [0])).astype(np.uint32)
    m = np.uint32(2654435761)
    one = codes[1:-1]
    two = codes[:-1] * np.uint32(40503) + codes[1:]
    three = two[:-1] * np.uint32(69069) + codes[2:]
    out = np.bincount(((one * m) >> 19)[one != 0], minlength=DIM)
    out += np.bincount((two * m + np.uint32(0x9E3779B9)) * m >> 19, minlength=DIM)
    out += np.bincount((three * m + np.uint32(0x85EBCA6B)) * m >> 19, minlength=DIM)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _weigh(counted: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counted).astype(np.float32, copy=False)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x


def length_class(n: np.ndarray) -> np.ndarray:
    """Classes of n-gram totals: powers of two up to 2^13."""
    return np.clip(np.log2(np.maximum(n, 1)).astype(int), 0, 13)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    limit: np.ndarray  # largest distance allowed, by length class

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
        """Language, score, distance and whether it is rejected, for each text."""
        out: list[tuple[str, float, float, bool]] = [("und", 0.0, 1.0, True)] * len(texts)
        if not self.languages:
            return out
        for i in range(0, len(texts), 64):
            found = [(j, c) for j, t in enumerate(texts[i : i + 64], i) if t is not None and (c := counts(t)) is not None]
            if not found:
                continue
            counted = np.stack([c for _, c in found])
            cosine = _weigh(counted, self.idf) @ self.centroids.T
            best = cosine.argmax(1)
            limit = self.limit[length_class(counted.sum(1))]
            for (j, _), k, c, most in zip(found, best, cosine, limit):
                cos = float(min(1.0, max(0.0, c[k])))
                out[j] = (self.languages[k], cos, 1 - cos, 1 - cos > most)
        return out


def fit(texts: list[str], labels: list[str], k: int = CENTROIDS) -> Model:
    """A model of the labelled texts; deterministic."""
    # small counts: a row of them takes 16 KB
    rows = [(np.minimum(c, 65535).astype(np.uint16), lang) for t, lang in zip(texts, labels) if t is not None and lang is not None and (c := counts(t)) is not None]
    if not rows:
        return Model([], np.zeros((0, DIM), np.float32), np.ones(DIM, np.float32), np.ones(14))
    counted = np.stack([c for c, _ in rows])
    langs = np.array([lang for _, lang in rows])
    idf = (np.log((1 + len(rows)) / (1 + (counted > 0).sum(0))) + 1).astype(np.float32)
    x = _weigh(counted, idf)
    names, centroids = [], []
    for lang in sorted(set(langs.tolist())):
        own = x[langs == lang]
        # farthest-first start from the mean, then spherical k-means
        seeds = [_unit(own.mean(0, keepdims=True))[0]]
        nearest = own @ seeds[0]
        while len(seeds) < min(k, len(own)):
            far = int(nearest.argmin())
            if nearest[far] > 1 - 1e-6:
                break
            seeds.append(own[far])
            nearest = np.maximum(nearest, own @ own[far])
        c = np.stack(seeds)
        for _ in range(ROUNDS):
            at = (own @ c.T).argmax(1)
            c = _unit(np.stack([own[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))]))
        names += [lang] * len(c)
        centroids.append(c)
    c = np.concatenate(centroids).astype(np.float32)
    away = 1 - np.stack([(x @ c.T)[:, [n == lang for n in names]].max(1) for lang in sorted(set(names))]).max(0)
    limit = np.ones(14)
    kind = length_class(counted.sum(1, dtype=np.int64))
    floor = float(np.quantile(away, 0.99))
    for j in range(14):
        seen = away[kind == j]
        # shorter texts lie farther out, so a class never has a lower limit than the longer ones have
        limit[j] = min(0.999, SLACK * max(float(seen.max(initial=0)), floor))
    limit[: int(np.log2(SHORT))] = SHORT_LIMIT
    limit = np.maximum.accumulate(limit[::-1])[::-1]
    return Model(names, c, idf, limit)


def train(df: DataFrame, keep: Column, text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on the rows that ``keep`` allows, at most fit_rows of them, in one task, so that the driver holds the model and
    no texts. ``keep`` may name any column of df."""
    rows = df.where(keep & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            sample = pa.Table.from_batches(held).sort_by([("text", "ascending"), ("lang", "ascending")])
            model = fit(sample.column("text").to_pylist(), sample.column("lang").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    sample = bounded_sample(rows, "text", fit_rows).select("text", "lang")
    found = sample.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(found[0]["model"])) if found else fit([], [])


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (the cosine), distance and rejected, for every row."""
    rows = pick(df, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = list(zip(*shared.value.predict(part.column(1).to_pylist())))
                kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, found, kinds)], [id_col, "lang_pred", "score", "distance", "rejected"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, distance double, rejected boolean")


def keep_identified(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of df that are not rejected, with all their columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield part.filter(pa.array([not x[3] for x in shared.value.predict(part.column(place).to_pylist())], pa.bool_()))

    return df.mapInArrow(run, df.schema)
