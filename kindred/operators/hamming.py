"""Similarity joins of 64-bit hashes, kept as four 16-bit numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.columns import hamming, hamming_similarity
from kindred.operators.blocks import blocks, long64, meet, tables

MAX_BANDS = 12
BLOCK_ROWS, HASH_BLOCK_ROWS = 512, 8192
CELLS = 1 << 20  # distances at once


def radius(threshold: float, bits: int = 64) -> int:
    """The greatest distance whose similarity reaches threshold, by trying each; -1 if none."""
    return max((d for d in range(bits + 1) if max(0.0, 1 - 2 * d / bits) >= threshold), default=-1)


def in_blocks(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs of rows of a and b, by an equi-join on (block of a, block of b): even work for each task, nothing broadcast whole."""
    n, m = (max(1, -(-x.count() // BLOCK_ROWS)) for x in (a, b))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<long>"))
    x = a.withColumn("block_a", F.pmod(F.xxhash64("a"), F.lit(n))).withColumn("block_b", every(m))
    y = b.withColumn("block_b", F.pmod(F.xxhash64("b"), F.lit(m))).withColumn("block_a", every(n))
    return x.join(y, ["block_a", "block_b"]).drop("block_a", "block_b")


def _blocks(rows: DataFrame, id: str, h: str) -> DataFrame:
    return blocks(rows.select(F.col(id).alias("id"), long64(F.col(h)).alias("h")), "id", HASH_BLOCK_ROWS, pa.Table.drop_null)


def _distances(s: pa.Table, t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """First row of s, distances of it and some rows behind it to all rows of t."""
    hs, ht = (x.column("h").to_numpy().view(np.uint64) for x in (s, t))
    step = max(1, CELLS // max(1, len(ht)))
    for at in range(0, len(hs), step):
        yield at, np.bitwise_count(hs[at : at + step, None] ^ ht[None])


def close_in_blocks(a: DataFrame, b: DataFrame, r: int, same: bool) -> DataFrame:
    """a, b, distance of rows (a, ha) and (b, hb) up to distance r, all compared: blocks of 64-bit numbers against each other; with same, pairs come with a < b."""
    kinds = dict(a.dtypes)["a"], dict(b.dtypes)["b"]
    x = _blocks(a, "a", "ha")
    y = x if same else _blocks(b, "b", "hb")

    def run(batches):
        for p, s, q, t in tables(batches):
            ids, others = s.column("id").combine_chunks(), t.column("id").combine_chunks()
            for at, d in _distances(s, t):
                i, j = np.nonzero(d <= r)
                left, right = ids.take(pa.array(i + at)), others.take(pa.array(j))
                keep = pc.not_equal(left, right)
                if same:
                    swap = pc.greater(left, right)
                    keep = pc.and_(keep, pc.or_(pa.scalar(p != q), pc.invert(swap)))
                    left, right = pc.if_else(swap, right, left), pc.if_else(swap, left, right)
                yield pa.RecordBatch.from_arrays([left, right, pa.array(d[i, j].astype(np.int64))], names=["a", "b", "distance"]).filter(keep)

    return meet(x, y, same, run, f"a {kinds[0]}, b {kinds[1]}, distance long")


def histogram(rows: DataFrame) -> DataFrame:
    """distance, n: the pairs of rows (id, h) with a < b, counted where they are compared; no pair is a row."""
    x = _blocks(rows, "id", "h")

    def run(batches):
        n = np.zeros(65, np.int64)
        for p, s, q, t in tables(batches):
            if p == q:
                _, rank = np.unique(s.column("id").to_numpy(zero_copy_only=False), return_inverse=True)
            for at, d in _distances(s, t):
                if p == q:
                    n += np.bincount(d[rank[at : at + len(d), None] < rank[None]], minlength=65)
                    continue
                flat = d.reshape(-1)
                even = len(flat) & ~1
                two = np.bincount(flat[:even].view(np.uint16), minlength=1 << 16).reshape(256, 256)  # two distances a number
                n += two.sum(0)[:65] + two.sum(1)[:65] + np.bincount(flat[even:], minlength=65)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["distance", "n"])

    return meet(x, x, True, run, "distance long, n long").groupBy("distance").agg(F.sum("n").alias("n"))


def nearest(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """a, b, distance, rank of the k rows of right closest to each row of left (id long, h), ties to the smaller id; a row isn't its own.

    A task keeps k for each row of a block of left, whatever it compares it with.
    """
    x, y = _blocks(left, "id", "h"), _blocks(right, "id", "h")

    def first(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((b, d, a))
        a, b, d = a[order], b[order], d[order]
        begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), a[1:] != a[:-1]]))
        place = np.arange(len(a)) - np.repeat(begin, np.diff([*begin, len(a)]))
        return a[place < k], b[place < k], d[place < k]

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        block, ids, size = None, np.zeros(0, np.int64), 0

        def flush():
            a, b, d = first(*(np.concatenate(z) for z in zip(*held)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(b), pa.array(d.astype(np.int64))], names=["a", "b", "distance"])

        for p, s, _, t in tables(batches):
            if p != block:
                if held:
                    yield flush()
                block, ids, size = p, s.column("id").to_numpy(), 0
            t = t.sort_by("id").combine_chunks()
            others = t.column("id").to_numpy()
            for at, d in _distances(s, t):
                d = np.where(ids[at : at + len(d), None] == others[None], 255, d)
                key = d.astype(np.int64) * len(others) + np.arange(len(others))
                if key.shape[1] > k:
                    key = np.partition(key, k - 1, axis=1)[:, :k]
                i = np.repeat(np.arange(at, at + len(key)), key.shape[1])
                d, j = np.divmod(key.reshape(-1), max(1, len(others)))
                held.append((i[d < 255], others[j[d < 255]], d[d < 255]))
                size += len(i)
            if size > CELLS:
                held[:] = [first(*(np.concatenate(z) for z in zip(*held)))]
                size = 0
        if held:
            yield flush()

    met = meet(x, y, False, run, "a long, b long, distance long")
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("distance", "b")).cast("long")).filter(F.col("rank") <= k)


def pairs(left: DataFrame, right: DataFrame, threshold: float, *, bits: int = 64, same: bool = False) -> DataFrame:
    """a, b, distance, similarity of rows (id, h) whose similarity reaches threshold; with same, a < b.

    By pigeonhole: within distance r, one of r + 1 bands of bits is equal,
    so bands join by equality and each pair counts under the first band
    shared. Beyond MAX_BANDS bands are too short to tell rows apart, and
    all pairs are compared, block by block.
    """
    r = radius(threshold, bits)
    a, b = left.select(F.col("id").alias("a"), F.col("h").alias("ha")), right.select(F.col("id").alias("b"), F.col("h").alias("hb"))
    if r + 1 > MAX_BANDS:
        met = close_in_blocks(a, b, r, same)
    else:
        n = r + 1
        edges = [bits * k // n for k in range(n + 1)]
        text = lambda h: F.concat(*(F.lpad(F.conv(F.get(h, F.lit(k)), 10, 2), 16, "0") for k in (3, 2, 1, 0)))
        keys = lambda h: F.array(*(F.substring(text(h), edges[k] + 1, edges[k + 1] - edges[k]) for k in range(n)))
        xs = a.select("a", "ha", F.posexplode(keys(F.col("ha"))).alias("band", "key"), keys(F.col("ha")).alias("ka"))
        ys = b.select("b", "hb", F.posexplode(keys(F.col("hb"))).alias("band", "key"), keys(F.col("hb")).alias("kb"))
        met = xs.join(ys, ["band", "key"]).filter("a < b" if same else "a <> b")
        # a pair counts under its first equal band: no distinct needed
        met = met.filter(F.expr("array_position(zip_with(ka, kb, (x, y) -> x = y), true) = band + 1")).withColumn("distance", hamming(F.col("ha"), F.col("hb")))
    out = met.withColumn("similarity", hamming_similarity(F.col("distance"), bits))
    return out.filter(F.col("similarity") >= threshold).select("a", "b", "distance", "similarity")
