"""Passages that earlier documents have: difference-cover anchors, then their extension.

A match of WINDOW words of two documents, at whatever places i and j, holds
a shift below PERIOD at which both places, modulo PERIOD, lie in the cover:
there the two documents share an anchor, a run of WINDOW - PERIOD + 1 words
inside the match. So only hashes of runs at cover places are compared
first (6 in 31 words); where none repeats in another document, nothing can
match. Around those that do, every window is a candidate, and the
candidates' own hashes decide.

Documents are dealt by id into groups of a few MB. A group sends each of
its hashes once, whatever number of its documents has it, packed in
one binary value for each bucket of hashes; buckets answer each group
alike. So a passage that a third of all documents share costs a bucket one
entry a group.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.common import light1, light2
from kindred.llm.words import BASES, runs, text_words

WINDOW, PERIOD, COVER = 50, 31, (1, 5, 11, 24, 25, 27)
GROUP_MB, MAX_GROUP_MB, GROUPS_A_BUCKET = 4, 16, 8
U = np.uint64


def buckets_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U(40)) * U(n) >> U(24)).astype(np.int64)


def dealt(h: np.ndarray, n: int):
    """For each bucket that has any: its number and where its entries are."""
    b = buckets_of(h, n)
    order = np.argsort(b, kind="stable")
    b = b[order]
    cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, int)
    for i, j in zip(cut, [*cut[1:], len(b)]):
        yield int(b[i]), order[i:j]


def starts(*keys: np.ndarray) -> np.ndarray:
    """True where sorted keys differ from those before."""
    out = np.ones(len(keys[0]), bool)
    if len(out) > 1:
        out[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return out


def parts(t: pa.Table) -> list[tuple[int, np.ndarray]]:
    """id and the words' numbers of each document of a group; null ids count as the greatest."""
    ids, at = text_words(t.column("text").to_pylist())
    return [(d, ids[i:j]) for d, i, j in zip(t.column("doc").to_pylist(), at, at[1:])]


def anchors(ids: np.ndarray, window: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a document's anchors."""
    h = runs(ids, window - period + 1, BASES[0])
    at = np.arange(len(h))
    at = at[np.isin(at % period, cover)]
    return at, h[at]


def windows(ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return runs(ids, window, BASES[1]), (runs(ids, window, BASES[2]) >> U(32)).astype(np.uint32)


def least(h: np.ndarray, g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (h, g) and the least doc of each, sorted."""
    order = np.lexsort((doc, g, h))
    h, g, doc = h[order], g[order], doc[order]
    first = starts(h, g)
    return h[first], g[first], doc[first]


def repeated_words(docs: DataFrame, *, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, with_text: bool = False, with_row: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs (doc_id, text), with with_text also kept_text,
    with with_row also row: all columns of docs but the text, whatever their names, as one struct.

    A word goes if it is covered by a window (of `window` words) whose words
    also start a window in a document with a smaller doc_id. Windows are
    judged on the input. Words: runs of other bytes than space, tab, line
    feed, vertical tab, form feed and return. Null and empty texts have no
    words; texts shorter than the window lose none. Rows with the same
    doc_id are one document: they take nothing from each other. Null ids
    count as greater than all. kept_text is the kept words joined by one
    space; documents that lose nothing keep their text as it was.
    """
    anchor = window - period + 1
    assert anchor >= 1 and {(a - b) % period for a in cover for b in cover} == set(range(period)), "not a difference cover"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")] if with_row else []))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    mb = min(MAX_GROUP_MB, max(GROUP_MB, total / 1e6 / 20_000))
    groups = max(1, math.ceil(total / 1e6 / mb))
    buckets = max(1, groups // GROUPS_A_BUCKET)
    greatest = F.lit((1 << 63) - 1)
    rows = rows.withColumn("doc", F.coalesce("doc_id", greatest)).withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(groups)))
    rows = rows.select("part", "doc", "doc_id", "text", *(["row"] if with_row else []))
    own = rows.groupBy("part")

    def emit(t: pa.Table) -> pa.Table:
        found = [(d, np.unique(anchors(ids, window, period, cover)[1])) for d, ids in parts(t)]
        h = np.concatenate([x for _, x in found] or [np.zeros(0, U)])
        doc = np.repeat(np.array([d for d, _ in found], np.int64), [len(x) for _, x in found])
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        one = starts(h, doc)
        h = h[one]
        # once if one document has it, twice if more have
        rank = np.arange(len(h)) - np.maximum.accumulate(np.where(starts(h), np.arange(len(h)), 0))
        h = h[rank < 2]
        part = t.column("part")[0].as_py()
        cells = list(dealt(h, buckets))
        return pa.table({"bucket": pa.array([b for b, _ in cells], pa.int64()), "part": pa.array([part] * len(cells), pa.int64()), "h": pa.array([h[i].tobytes() for _, i in cells], pa.binary())})

    sent = own.applyInArrow(light1(emit), "bucket long, part long, h binary")

    def judge(t: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x, U) for x in t.column("h").to_pylist()]
        h = np.sort(np.concatenate(blobs))
        again = h[1:][h[1:] == h[:-1]]
        again = again[starts(again)] if len(again) else again
        out = []
        for b in blobs:
            own_h = np.unique(b)
            k = np.minimum(np.searchsorted(again, own_h), max(0, len(again) - 1))
            out.append(own_h[again[k] == own_h].tobytes() if len(again) else b"")
        keep = [i for i, x in enumerate(out) if x]
        return pa.table({"part": t.column("part").take(pa.array(keep, pa.int64())), "h": pa.array([out[i] for i in keep], pa.binary())})

    known = sent.groupBy("bucket").applyInArrow(light1(judge), "part long, h binary")

    def extend(t: pa.Table, r: pa.Table) -> pa.Table:
        again = np.sort(np.concatenate([np.frombuffer(x, U) for x in r.column("h").to_pylist()] or [np.zeros(0, U)]))
        hs, gs, ds = [np.zeros(0, U)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        if len(again) and t.num_rows:
            for d, ids in parts(t):
                if len(ids) < window:
                    continue
                at, h = anchors(ids, window, period, cover)
                k = np.minimum(np.searchsorted(again, h), len(again) - 1)
                at = at[again[k] == h]
                if not len(at):
                    continue
                near = np.zeros(len(ids) + 1, np.int32)
                np.add.at(near, np.maximum(at - period + 1, 0), 1)
                np.add.at(near, at + 1, -1)
                ok = np.flatnonzero(np.cumsum(near)[: len(ids) - window + 1] > 0)
                h, g = windows(ids, window)
                hs.append(h[ok])
                gs.append(g[ok])
                ds.append(np.full(len(ok), d, np.int64))
        h, g, d = least(np.concatenate(hs), np.concatenate(gs), np.concatenate(ds))
        cells = list(dealt(h, buckets))
        part = t.column("part")[0].as_py() if t.num_rows else 0
        return pa.table({"bucket": pa.array([b for b, _ in cells], pa.int64()), "part": pa.array([part] * len(cells), pa.int64()), **{n: pa.array([x[i].tobytes() for _, i in cells], pa.binary()) for n, x in (("h", h), ("g", g), ("d", d))}})

    candidates = own.cogroup(known.groupBy("part")).applyInArrow(light2(extend), "bucket long, part long, h binary, g binary, d binary")

    def settle(t: pa.Table) -> pa.Table:
        cols = [[np.frombuffer(x, k) for x in t.column(n).to_pylist()] for n, k in (("h", U), ("g", np.uint32), ("d", np.int64))]
        h, g, d = (np.concatenate(c) for c in cols)
        src = np.repeat(np.arange(t.num_rows), [len(x) for x in cols[0]])
        order = np.lexsort((d, g, h))
        h, g, d, src = h[order], g[order], d[order], src[order]
        first = starts(h, g)
        best = d[np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))]
        tell = best < d  # only groups that don't know yet
        h, g, best, src = h[tell], g[tell], best[tell], src[tell]
        order = np.argsort(src, kind="stable")
        h, g, best, src = h[order], g[order], best[order], src[order]
        cut = np.flatnonzero(starts(src)) if len(src) else np.zeros(0, int)
        spans = list(zip(cut, [*cut[1:], len(src)]))
        return pa.table({"part": t.column("part").take(pa.array(src[cut], pa.int64())), **{n: pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for n, x in (("h", h), ("g", g), ("d", best))}})

    answers = candidates.groupBy("bucket").applyInArrow(light1(settle), "part long, h binary, g binary, d binary")
    schema = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()))])
    if with_text:
        schema.add("kept_text", T.StringType())
    if with_row:
        schema.add("row", rows.schema["row"].dataType)

    def remove(t: pa.Table, r: pa.Table) -> pa.Table:
        docs_here = parts(t) if t.num_rows else []
        each = [windows(ids, window) for _, ids in docs_here]
        sizes = [len(h) for h, _ in each]
        z = lambda n, k: [np.frombuffer(x, k) for x in r.column(n).to_pylist()]
        h = np.concatenate([*(h for h, _ in each), *z("h", U), np.zeros(0, U)])
        g = np.concatenate([*(g for _, g in each), *z("g", np.uint32), np.zeros(0, np.uint32)])
        d = np.concatenate([np.repeat(np.array([x[0] for x in docs_here], np.int64), sizes), *z("d", np.int64), np.zeros(0, np.int64)])
        order = np.lexsort((d, g, h))
        first = starts(h[order], g[order]) if len(h) else np.zeros(0, bool)
        best = np.zeros(len(h), np.int64)
        best[order] = d[order][np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))] if len(h) else 0
        gone = best < d
        out: list[list] = [[], [], [], []] + ([[]] if with_text else [])
        at = 0
        for n, doc_id, raw in zip(sizes, t.column("doc_id").to_pylist(), t.column("text").to_pylist()):
            words = (raw or b"").split()
            hit = np.flatnonzero(gone[at : at + n])
            at += n
            kept, lost = words, 0
            if len(hit):
                cover_ = np.zeros(len(words) + 1, np.int32)
                cover_[hit] += 1
                np.add.at(cover_, hit + window, -1)
                left = np.cumsum(cover_)[: len(words)] == 0
                kept, lost = [w for w, k in zip(words, left.tolist()) if k], int((~left).sum())
            joined = b" ".join(kept)
            row = [doc_id, len(words), lost, hashlib.sha256(joined).hexdigest()]
            if with_text:
                row.append(None if raw is None else (joined if lost else raw).decode("utf-8", "replace"))
            for c, v in zip(out, row):
                c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, out, kinds)} | ({"row": t.column("row")} if with_row else {}))

    return own.cogroup(answers.groupBy("part")).applyInArrow(light2(remove), schema)
