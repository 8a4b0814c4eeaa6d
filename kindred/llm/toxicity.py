"""Toxic spans by a linear-chain conditional random field with two tags.

Only documents are labelled, so tokens get their labels from them: a token
of a toxic training document is toxic if its word, or a prefix of it, comes
far more often in toxic training documents than in others. The field is
fitted to these tags by gradient ascent; forward-backward marginals then tag
any document. A document's score is a logistic function of its marginals.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import remainder, sampled_ids

MAX_TRAIN, LIFT, MIN_DOCS, PREFIXES = 1000, 20.0, 3, (3, 4, 5, 6, 7, 8)
EPOCHS, RATE, L2 = 50, 1.0, 1e-5
WIDTH = 64
MEMO = 200_000
WORD = re.compile(r"\S+")
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def normal(token: str) -> str:
    return token.strip(EDGE).lower()


def features(word: str) -> list[str]:
    """The word itself, prefixes and suffix of it, and its rough kind."""
    return ["=" + word, "$" + word[-3:], "#" + str(min(len(word), 12)), *(f"{k}{word[:k]}" for k in PREFIXES if len(word) > k)]


def chain(e: np.ndarray, docs: np.ndarray, t: np.ndarray, start: np.ndarray, *, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of tag 1 at each token, and with pairs the expected counts of transitions.

    e: advantage of tag 1 at each token; docs: offsets of the documents in e
    (one more than there are documents); t: 2 x 2 log transitions; start:
    log weights of the first tag. Messages are carried for all documents at
    once, with WIDTH tokens in a column of their own: first the product of
    each column's matrices, then column after column, then all columns in step.
    """
    n, lengths = len(e), np.diff(docs)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    first = docs[:-1][lengths > 0]
    cols = -(-n // WIDTH)
    x = np.exp(np.clip(e, -30, 30))
    trans, begin = np.exp(t), np.exp(start)
    m = np.zeros((2, 2, cols * WIDTH))
    m[0, 0, n:] = m[1, 1, n:] = 1
    m[0, 0, :n], m[1, 0, :n] = trans[0, 0], trans[1, 0]
    m[0, 1, :n], m[1, 1, :n] = trans[0, 1] * x, trans[1, 1] * x
    # a document's first token begins anew, whatever came before
    m[:, 0, first], m[:, 1, first] = begin[0], begin[1] * x[first]
    flat = m
    m = np.ascontiguousarray(m.reshape(2, 2, cols, WIDTH).transpose(3, 0, 1, 2))
    w = np.stack([np.stack([np.ones(cols), np.zeros(cols)]), np.stack([np.zeros(cols), np.ones(cols)])])
    for k in range(WIDTH):
        w = np.stack([w[:, 0] * m[k, 0, 0] + w[:, 1] * m[k, 1, 0], w[:, 0] * m[k, 0, 1] + w[:, 1] * m[k, 1, 1]], 1)
        w /= w.sum((0, 1))
    left, right = np.zeros((2, cols)), np.zeros((2, cols))
    whole = w.transpose(2, 0, 1).reshape(cols, 4).tolist()
    a0, a1 = 1.0, 0.0
    for c, (w00, w01, w10, w11) in enumerate(whole):
        left[0, c], left[1, c] = a0, a1
        a0, a1 = a0 * w00 + a1 * w10, a0 * w01 + a1 * w11
        a0, a1 = a0 / (a0 + a1), a1 / (a0 + a1)
    b0 = b1 = 0.5
    for c in range(cols - 1, -1, -1):
        w00, w01, w10, w11 = whole[c]
        right[0, c], right[1, c] = b0, b1
        b0, b1 = w00 * b0 + w01 * b1, w10 * b0 + w11 * b1
        b0, b1 = b0 / (b0 + b1), b1 / (b0 + b1)
    alpha, beta = np.zeros((WIDTH, 2, cols)), np.zeros((WIDTH, 2, cols))
    a = left
    for k in range(WIDTH):
        a = a[0] * m[k, 0] + a[1] * m[k, 1]
        a /= a.sum(0)
        alpha[k] = a
    b = right
    for k in range(WIDTH - 1, -1, -1):
        beta[k] = b
        b = m[k, :, 0] * b[0] + m[k, :, 1] * b[1]
        b /= b.sum(0)
    alpha, beta = (z.transpose(1, 2, 0).reshape(2, -1)[:, :n] for z in (alpha, beta))
    both = alpha * beta
    p = both[1] / both.sum(0)
    if not pairs:
        return p, np.zeros((2, 2))
    inside = np.ones(n, bool)
    inside[first] = False
    at = np.flatnonzero(inside)
    pair = alpha[:, None, at - 1] * flat[:, :, at] * beta[None, :, at]
    return p, (pair / pair.sum((0, 1))).sum(2)


class Field:
    def __init__(self, weights: dict[str, float], t: np.ndarray, start: np.ndarray, slope: float = 1.0, bias: float = 0.0):
        self.weights, self.t, self.start, self.slope, self.bias = weights, t, start, slope, bias
        self.memo: dict[str, float] = {}

    def emission(self, token: str) -> float:
        got = self.memo.get(token)
        if got is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            w = normal(token)
            base = self.weights.get("bias", 0.0)
            got = base + sum(self.weights.get(f, 0.0) for f in features(w)) if w else base
            if len(token) <= 64:
                self.memo[token] = got
        return got

    def marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all tokens (split at white space), and the offsets of the documents in them."""
        em = self.emission
        parts = [[em(w) for w in t.split()] for t in texts]
        docs = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(int)
        e = np.array([x for p in parts for x in p])
        return chain(e, docs, self.t, self.start)[0], docs

    def score(self, p: np.ndarray) -> float:
        """Of a document: logistic in its most certain token and the log of the expected number of toxic tokens."""
        if not len(p):
            return float(1 / (1 + np.exp(-self.bias)))
        x = p.max() + np.log1p(p[p > 0.5].sum())
        return float(1 / (1 + np.exp(-(self.slope * x + self.bias))))


def tag(texts: list[str], toxic: np.ndarray) -> tuple[list[list[str]], set[str]]:
    """The tokens' words, and the features that mark a toxic token."""
    words = [[normal(w) for w in t.split()] for t in texts]
    seen: dict[str, list[int]] = {}
    for ws, y in zip(words, toxic):
        for f in {f for w in set(ws) if w for f in ["=" + w, *(f"{k}{w[:k]}" for k in PREFIXES if len(w) > k)]}:
            seen.setdefault(f, [0, 0])[int(y)] += 1
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    return words, {f for f, (c0, c1) in seen.items() if c1 >= MIN_DOCS and c1 / n1 >= LIFT * (c0 + 0.1) / n0}


def fit(texts: list[str], toxic: np.ndarray) -> Field:
    """toxic: 0 or 1 for each text."""
    if not len(texts) or toxic.min() == toxic.max():
        return Field({}, np.zeros((2, 2)), np.zeros(2), 0.0, -20.0 if not len(texts) or not toxic.max() else 20.0)
    words, marks = tag(texts, toxic)
    # distinct words once, with their features as rows of indices
    index: dict[str, int] = {}
    for ws in words:
        for w in ws:
            index.setdefault(w, len(index))
    names: dict[str, int] = {"bias": 0}
    used: list[list[int]] = []
    marked = np.zeros(len(index), bool)
    for w, i in index.items():
        fs = features(w) if w else []
        used.append([0] + [names.setdefault(f, len(names)) for f in fs])
        marked[i] = any(f in marks for f in fs)
    width = max(map(len, used))
    null = len(names)
    table = np.full((len(used), width), null)
    for i, u in enumerate(used):
        table[i, : len(u)] = u
    ids = np.array([index[w] for ws in words for w in ws], dtype=int)
    docs = np.concatenate([[0], np.cumsum([len(ws) for ws in words])]).astype(int)
    y = marked[ids] & np.repeat(toxic.astype(bool), np.diff(docs))
    first = docs[:-1][np.diff(docs) > 0]
    inside = np.setdiff1d(np.arange(len(ids)), first)
    want_t = np.zeros((2, 2))
    np.add.at(want_t, (y[inside - 1].astype(int), y[inside].astype(int)), 1)
    want_start = np.bincount(y[first].astype(int), minlength=2)
    want_word = np.bincount(ids, y, len(index))
    w, t, start = np.zeros(null + 1), np.zeros((2, 2)), np.zeros(2)
    w[0] = -4.0
    gw, gt, gs = np.full(null + 1, 1e-8), np.full((2, 2), 1e-8), np.full(2, 1e-8)
    n = max(1, len(ids))
    for _ in range(EPOCHS):
        e = w[table].sum(1)
        p, pairs = chain(e[ids], docs, t, start, pairs=True)
        d_word = want_word - np.bincount(ids, p, len(index))
        d = np.bincount(table.ravel(), np.repeat(d_word, width), null + 1) / n - L2 * w
        d[null] = 0
        dt = (want_t - pairs) / n - L2 * t
        p1 = p[first].sum()
        ds = (want_start - np.array([len(first) - p1, p1])) / n
        for x, dx, g in ((w, d, gw), (t, dt, gt), (start, ds, gs)):
            g += dx * dx
            x += RATE * dx / np.sqrt(g)
    field = Field({f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-6}, t, start)
    p = chain(w[table].sum(1)[ids], docs, t, start)[0]
    x = np.array([q.max() + np.log1p(q[q > 0.5].sum()) if len(q) else 0.0 for q in (p[a:b] for a, b in zip(docs, docs[1:]))])
    slope, bias = 4.0, -2.0
    for _ in range(2000):
        s = 1 / (1 + np.exp(-(slope * x + bias)))
        slope += 0.5 * float(((toxic - s) * x).mean()) - 1e-4 * slope
        bias += 0.5 * float((toxic - s).mean())
    field.slope, field.bias = slope, bias
    return field


def train(docs: DataFrame, labels: DataFrame, *, mod: int = 3, held: int = 1, limit: int = MAX_TRAIN) -> Field:
    """Fit on at most limit toxic and limit other labelled rows outside the held-out part; their texts come to the driver."""
    known = labels.select("doc_id", F.col("toxic").alias("y")).filter("y is not null and doc_id is not null").filter(remainder("doc_id", mod) != held)
    known = sampled_ids(known.filter("y = 1"), limit).unionByName(sampled_ids(known.filter("y = 0"), limit))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").toPandas().sort_values(["doc_id", "text"])
    return fit(list(rows["text"]), rows["y"].to_numpy(dtype=float))


def toxicity(docs: DataFrame, model: Field, *, threshold: float = 0.7, mod: int = 3, held: int = 1, with_spans: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text).

    With with_spans also spans: begin and end (code points, end excluded) and
    marginal of each run of tokens whose marginal is over one half. Null and
    empty texts have no tokens: they score as the model's rate without any.
    Without labelled rows the score is near 0. Repeated rows come back as
    often as they came, with the same score; a score of just the threshold
    counts as toxic. Texts of any length are tagged whole; other columns
    aren't read; an empty table gives an empty result.
    """
    fields = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())]
    schema = "doc_id long, held_out boolean, score double, predicted int"
    if with_spans:
        fields.append(("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))))
        schema += ", spans array<struct<begin int, end int, p double>>"
    out = pa.schema(fields)

    def spans(text: str, p: np.ndarray) -> list[dict]:
        found: list[dict] = []
        if not (p > 0.5).any():
            return found
        open_run = False
        for m, q in zip(WORD.finditer(text), p):
            if q > 0.5:
                if open_run:
                    found[-1]["end"], found[-1]["p"] = m.end(), max(found[-1]["p"], float(q))
                else:
                    found.append({"begin": m.start(), "end": m.end(), "p": float(q)})
            open_run = q > 0.5
        return found

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [x or "" for x in part.column(2).to_pylist()]
                p, docs_at = model.marginals(texts)
                each = [p[i:j] for i, j in zip(docs_at, docs_at[1:])]
                s = np.array([model.score(q) for q in each])
                cols = [part.column(0), part.column(1), pa.array(s), pa.array((s >= threshold).astype("i4"))]
                if with_spans:
                    cols.append(pa.array([spans(t, q) for t, q in zip(texts, each)], out.field("spans").type))
                yield pa.RecordBatch.from_arrays(cols, schema=out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder("doc_id", mod) == held, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)
