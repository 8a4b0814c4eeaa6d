"""Language identification by the nearest of several centroids for each language."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import remainder, sampled_ids

DIMS, MAX_TRAIN, CENTROIDS, ROUNDS = 4096, 2400, 3, 12
REJECT_QUANTILE, REJECT_SLACK = 0.995, 1.25
STEP = 1 << 18  # code points at a time


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def ngrams(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams (1 to 3 code points, lower case, runs of other characters as one space); None without a letter."""
    if not text:
        return None
    out = np.zeros(DIMS)
    any_letter = False
    tail = np.zeros(0, dtype=np.uint32)
    for at in range(0, len(text), STEP):
        c = np.frombuffer(text[at : at + STEP].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ok = _letters()[c]
        any_letter |= bool(ok.any())
        c = np.where(ok, c, 32).astype(np.uint32)
        c = np.concatenate([tail if at else np.array([32], np.uint32), c])
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
        h1 = c * np.uint32(0x9E3779B1)
        h2 = (c[:-1] * np.uint32(0x85EBCA6B)) ^ (c[1:] * np.uint32(0xC2B2AE35)) + np.uint32(1)
        h3 = (h2[:-1] * np.uint32(0x27D4EB2F)) ^ (c[2:] * np.uint32(0x165667B1)) + np.uint32(2)
        for h in (h1[len(tail) :], h2[max(0, len(tail) - 1) :], h3[max(0, len(tail) - 2) :]):
            out += np.bincount(h >> np.uint32(20), minlength=DIMS)
        tail = c[-2:]
    return out if any_letter else None


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-12)


class Centroids:
    def __init__(self, langs: list[str], idf: np.ndarray, centers: np.ndarray, owner: np.ndarray, radius: np.ndarray):
        self.langs, self.idf, self.centers, self.owner, self.radius = langs, idf, centers, owner, radius

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, cosine, and whether even the nearest centroid is too far."""
        v = _normal(np.log1p(counts) * self.idf)
        cos = v @ self.centers.T
        best = cos.argmax(1)  # ties: the first language by name
        c = np.clip(cos[np.arange(len(v)), best], 0, 1)
        return self.owner[best], c, 1 - c > self.radius[self.owner[best]]


def fit(counts: np.ndarray, langs: list[str]) -> Centroids:
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs], dtype=int)
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1
    v = _normal(np.log1p(counts) * idf)
    centers, owner, radius = [], [], []
    for k in range(len(names)):
        own = v[y == k]
        c = own[np.linspace(0, len(own) - 1, min(CENTROIDS, len(own))).astype(int)]
        for _ in range(ROUNDS):
            near = (own @ c.T).argmax(1)
            c = _normal(np.stack([own[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))]))
        radius.append(REJECT_SLACK * np.quantile(1 - (own @ c.T).max(1), REJECT_QUANTILE))
        centers.append(c)
        owner += [k] * len(c)
    return Centroids(names, idf, np.concatenate(centers), np.array(owner), np.array(radius))


def train(docs: DataFrame, *, mod: int = 3, held: int = 1, limit: int = MAX_TRAIN) -> Centroids | None:
    """Fit on at most limit rows with a language outside the held-out part; None if there is none. Their counts come to the driver."""
    known = docs.filter("lang is not null and text is not null and doc_id is not null").filter(remainder("doc_id", mod) != held)
    ids = sampled_ids(known.select("doc_id"), limit).distinct()

    def run(batches):
        for b in batches:
            found = [(x, lang) for t, lang in zip(b.column(0), b.column(1).to_pylist()) if (x := ngrams(t.as_py())) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([lang for _, lang in found], pa.string()), pa.array([x.astype("<u4").tobytes() for x, _ in found], pa.binary())], names=["lang", "x"])

    rows = known.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).join(F.broadcast(ids), "doc_id").select("text", "lang").mapInArrow(run, "lang string, x binary").toPandas().sort_values(["lang", "x"])
    if not len(rows):
        return None
    return fit(np.frombuffer(b"".join(rows["x"]), "<u4").reshape(-1, DIMS).astype(float), list(rows["lang"]))


def language(docs: DataFrame, model: Centroids | None, *, mod: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of docs (doc_id, text).

    `und` and score 0 if the text is null or has no letter, or if no language
    was learned. A text farther from every centroid than nearly all the
    training texts of the nearest language is marked rejected; lang_pred then
    still names that language. Of languages that are equally near the first by
    name is taken. Repeated rows come back as often as they came; texts of any
    length count whole; other columns aren't read.
    """

    def run(batches):
        for b in batches:
            n = b.num_rows
            names, score, far = ["und"] * n, np.zeros(n), np.zeros(n, bool)
            if model is not None:
                for at in range(0, n, 256):
                    rows = [(i, x) for i in range(at, min(n, at + 256)) if (x := ngrams(b.column(2)[i].as_py())) is not None]
                    if rows:
                        k, c, r = model.predict(np.stack([x for _, x in rows]))
                        for (i, _), kk, cc, rr in zip(rows, k, c, r):
                            names[i], score[i], far[i] = model.langs[kk], cc, rr
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(far)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder("doc_id", mod) == held, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
