"""Quality of documents: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import light, remainder, sampled_ids

MAX_TRAIN = 20_000
TREES, DEPTH, RATE, BINS, L2 = 60, 4, 0.15, 64, 1.0
FEATURES = ["bytes", "words", "word_length", "letters", "digits", "upper", "white", "symbols", "high", "odd_words", "odd_count", "upper_words", "repeats", "longest_run", "distinct", "pairs", "lines", "line_length", "top_word", "stops", "odd_symbols"]
ODD = b"*&%$#|!@^~<>{}[]\\=+_`"
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_ODD_WORD = re.compile(rb"[*&%$#|!@^~<>{}\[\]\\=+_`]{2,}|^\|$")


def statistics(text: str | None) -> list[float]:
    """One number for each of FEATURES, from the whole text; all zero for none."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    left = lambda chars: n - len(raw.translate(None, chars))
    words = raw.split()
    m = max(1, len(words))
    same = run = longest = 0
    for a, b in zip(words, words[1:]):
        if a == b:
            same += 1
            run += 1
        else:
            if run > longest:
                longest = run
            run = 0
    longest = max(longest, run)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    odd = sum(c for w, c in counts.items() if _ODD_WORD.search(w))
    upper = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    lines = raw.count(b"\n") + 1
    return [
        np.log1p(n), np.log1p(len(words)), n / m, left(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") / n, left(b"0123456789") / n, left(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n, left(b" \t\n\r\x0b\x0c") / n,
        left(_SYMBOLS) / n, left(bytes(range(128, 256))) / n, odd / m, np.log1p(odd), upper / m, same / m, np.log1p(longest), len(counts) / m, len(set(zip(words, words[1:]))) / m, np.log1p(lines), np.log(n / lines), max(counts.values(), default=0) / m, left(b".,;:") / m, left(ODD) / n,
    ]


class Trees:
    """Boosted trees as flat arrays: of each tree, the inner nodes level by level, then the leaves."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            total += v[at - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Trees:
    """Logistic loss, level-wise growth, gains from histograms of gradient and curvature."""
    n, k = x.shape
    inner = 2**depth - 1
    if not n or y.min() == y.max():
        p = (y.sum() + 0.5) / (n + 0.5) if n else 1.0
        base = 20.0 if not n else float(np.log(p / (1 - p + 1e-9) + 1e-9))
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(n, base)
    out_f, out_t, out_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        f, t, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            cell = (at - first)[:, None] * bins + binned
            best = np.full(count, 1e-6)
            for j in range(k):
                hg = np.bincount(cell[:, j], g, count * bins).reshape(count, bins).cumsum(1)
                hh = np.bincount(cell[:, j], h, count * bins).reshape(count, bins).cumsum(1)
                gl, hl, gt, ht = hg[:, :-1], hh[:, :-1], hg[:, -1:], hh[:, -1:]
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[(hl < 0.5) | (ht - hl < 0.5)] = -1
                gain[:, len(cuts[j]) :] = -1
                b = gain.argmax(1)
                won = gain[np.arange(count), b] > best
                best[won] = gain[np.arange(count), b][won]
                f[first : first + count][won] = j
                t[first : first + count][won] = cuts[j][b[won]]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > t[at])
        leaf = at - inner
        v = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + L2)
        margin += v[leaf]
        out_f.append(f), out_t.append(t), out_v.append(v)
    return Trees(base, np.array(out_f), np.array(out_t), np.array(out_v))


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns of keep, and x: the statistics of the text as float64 bytes."""
    kept = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"{c} {t}" for c, t in kept.dtypes[:-1]) + ", x binary"

    def run(batches):
        for b in batches:
            x = [np.array(statistics(t.as_py())).tobytes() for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(x, pa.binary())], names=[*keep, "x"])

    return kept.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, *, mod: int = 4, held: int = 2, limit: int = MAX_TRAIN) -> Trees:
    """Fit on at most limit labelled rows outside the held-out part; only their statistics come to the driver."""
    known = labels.select("doc_id", F.col("quality").alias("y")).filter("y is not null and doc_id is not null").filter(remainder("doc_id", mod) != held)
    known = sampled_ids(known, limit)
    rows = measured(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"), "doc_id", "y").select("doc_id", "y", "x").toPandas().sort_values("doc_id")
    x = np.frombuffer(b"".join(rows["x"]), dtype=np.float64).reshape(-1, len(FEATURES)) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit(x, rows["y"].to_numpy(dtype=float) if len(rows) else np.zeros(0))


def quality(docs: DataFrame, model: Trees, *, threshold: float = 0.7, mod: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text).

    Null and empty texts have statistics of zero and are scored like others.
    Without any labelled row the score is 1 (nothing is rejected).
    """

    def run(batches):
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(2)], dtype=float).reshape(-1, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype("i4"), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder("doc_id", mod) == held, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Trees, *, threshold: float = 0.7) -> DataFrame:
    """docs, with its own columns, without the rows scored below the threshold. Nothing shuffles."""
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            text = b.column(at).cast(pa.string())
            x = np.array([statistics(t.as_py()) for t in text], dtype=float).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(light(run), docs.schema)
