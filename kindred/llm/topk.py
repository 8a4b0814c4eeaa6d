"""Exact top-k by inner product: ball-tree branch and bound in each shard of the vectors.

Vectors are dealt to the nearest of at most CENTRES centres, a bounded
sample of them, and large cells further, by hash, so that shards have a
bounded size. Each shard has a ball tree of its own. Every query first
searches the shard it lies in; the k-th score found there is a bound that
goes with it. It goes only to cells whose own ball may hold a better score
(q . centre + |q| radius reaches the bound); in their trees, too, nodes
below it are never opened, and those that promise the most are opened first.
Shards and blocks of queries meet by equi-join on (shard, block), so that
no task holds more than one shard and one block of queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import cut

SHARD_ROWS, QUERY_ROWS, LEAF, K, CENTRES = 16_384, 16_384, 256, 5, 1024
EXACT = 2.0**53


def matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """floor(256 x) of each component, as float64; shorter vectors are filled up with zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    rows = len(vectors)
    lengths = np.diff(np.asarray(vectors.offsets))[:rows]
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(lengths.max()) if rows else 0
    if rows and (lengths == width).all():
        out = flat.reshape(rows, width)
    else:
        out = np.zeros((rows, width))
        out[np.arange(width)[None] < lengths[:, None]] = flat
    return np.floor(256 * out)


class BallTree:
    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.nodes: list[tuple[np.ndarray, float, int, int, np.ndarray | None]] = []  # centre, radius, children, rows of a leaf
        if len(x):
            self._build(np.arange(len(x)))

    def _build(self, rows: np.ndarray) -> int:
        own = self.x[rows]
        centre = own.mean(0)
        far = np.sqrt(((own - centre) ** 2).sum(1))
        radius = float(far.max()) * (1 + 1e-9) + 1e-6
        at = len(self.nodes)
        self.nodes.append((centre, radius, -1, -1, rows))
        if len(rows) > LEAF and far.max() > 0:
            a = own[far.argmax()]
            b = own[((own - a) ** 2).sum(1).argmax()]
            side = own @ (b - a)
            order = np.argsort(side, kind="stable")
            half = len(rows) // 2
            left = self._build(rows[np.sort(order[:half])])
            right = self._build(rows[np.sort(order[half:])])
            self.nodes[at] = (centre, radius, left, right, None)
        return at

    def search(self, q_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best rows of each query but its own, -inf where there are fewer; rows below bound may be missing."""
        n = len(q)
        score, found = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        if not self.nodes or not n:
            return score, found
        width = max(q.shape[1], self.x.shape[1])
        fill = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
        q, x = fill(q), fill(self.x)
        norm = np.sqrt((q * q).sum(1))
        exact = max(1.0, np.abs(q).max()) * max(1.0, np.abs(x).max()) * max(1, width) < EXACT
        kth = bound.copy()

        def upper(node: int, who: np.ndarray) -> np.ndarray:
            centre, radius = self.nodes[node][:2]
            u = q[who, : len(centre)] @ centre + norm[who] * radius
            return u + np.abs(u) * 1e-9 + 1e-3

        stack = [(0, np.arange(n), upper(0, np.arange(n)))]
        while stack:
            node, who, u = stack.pop()
            who = who[u >= kth[who]]  # the k-th scores may have risen since
            if not len(who):
                continue
            _, _, left, right, rows = self.nodes[node]
            if rows is None:
                a, b = upper(left, who), upper(right, who)
                both = [(left, who, a), (right, who, b)]
                stack += both if b.sum() >= a.sum() else both[::-1]  # the better one on top
                continue
            for part in np.array_split(who, -(-len(who) // 2048)):
                s = q[part] @ x[rows].T if exact else (q[part].astype(np.int64) @ x[rows].T.astype(np.int64)).astype(np.float64)
                s[q_ids[part][:, None] == self.ids[rows][None]] = -np.inf
                some = (s >= np.maximum(kth[part], score[part, -1])[:, None]).any(1)
                part, s = part[some], s[some]
                if len(part):
                    all_s = np.concatenate([score[part], s], 1)
                    all_i = np.concatenate([found[part], np.broadcast_to(self.ids[rows], s.shape)], 1)
                    order = np.lexsort((all_i, -all_s))[:, :k]
                    score[part] = np.take_along_axis(all_s, order, 1)
                    found[part] = np.take_along_axis(all_i, order, 1)
                    kth[part] = np.maximum(kth[part], score[part, -1])
        return score, found


def _tree(t: pa.Table) -> tuple[BallTree, np.ndarray, np.ndarray]:
    """The tree of a shard without repeated rows, in the order of ids."""
    ids, x = t.column("vec_id").to_numpy(), matrix(t.column("v"))
    rows = np.argsort(ids, kind="stable")
    ids, x = ids[rows], x[rows]
    again = np.zeros(len(ids), bool)
    again[1:] = (ids[1:] == ids[:-1]) & (x[1:] == x[:-1]).all(1)
    ids, x = ids[~again], x[~again]
    return BallTree(ids, x), ids, x


def top_k(vectors: DataFrame, *, k: int = K, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose vec_id is divisible by `every`.

    vectors: vec_id, embedding. Score: integer inner product of
    floor(256 x); ties go to the smaller vec_id. Vectors that are null or
    hold null or non-finite components, and null ids, take no part. Shorter
    vectors count as filled up with zeros. Repeated rows count once; other
    columns aren't read. Queries with fewer than k other rows get all of them.
    """
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    n = rows.count()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-n // (every * QUERY_ROWS)))
    # cells: nearest centre, its rows and the distance of its farthest one; at most CENTRES of each come to the driver
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(shards, CENTRES)).select("v").toArrow()
    centres = matrix(sample.column("v"))

    def away(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x and the centres, as wide as each other."""
        width = max(x.shape[1], centres.shape[1])
        return np.pad(x, ((0, 0), (0, width - x.shape[1]))), np.pad(centres, ((0, 0), (0, width - centres.shape[1])))

    def deal(batches):
        for b in batches:
            x, c = away(matrix(b.column(1)))
            cell = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1) if len(x) else np.zeros(0, np.int64)
            far = np.sqrt(((x - c[cell]) ** 2).sum(1)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int64()), pa.array(far, pa.float64())], names=["vec_id", "v", "cell", "far"])

    if n:
        rows = cut(rows.mapInArrow(deal, "vec_id long, v array<double>, cell long, far double"))
        cells = {r["cell"]: (r["n"], r["far"]) for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    else:
        rows, cells = rows.withColumns({"cell": F.lit(0).cast("long"), "far": F.lit(0.0)}), {}
    # shard = cell * most + number in the cell
    split = {c: -(-k // SHARD_ROWS) for c, (k, _) in cells.items()}
    most = max(split.values(), default=1)
    parts = F.element_at(F.array(*(F.lit(split.get(c, 1)) for c in range(max(1, len(centres))))), F.col("cell").cast("int") + 1)
    rows = rows.withColumn("shard", F.col("cell") * most + F.pmod(F.xxhash64("vec_id"), parts))

    def home(t: pa.Table) -> pa.Table:
        tree, ids, x = _tree(t)
        own = ids % every == 0
        s = tree.search(ids[own], x[own], np.full(int(own.sum()), -np.inf), k)[0][:, -1] if own.any() else np.zeros(0)
        return pa.table({"query_id": pa.array(ids[own], pa.int64()), "q": pa.array([r.tobytes() for r in x[own]], pa.binary()), "bound": pa.array(s, pa.float64())})

    bounds = rows.groupBy("shard").applyInArrow(home, "query_id long, q binary, bound double")

    def route(batches):
        """A row for each query and shard that may have a score of its bound or better."""
        radius = np.array([cells.get(c, (0, 0.0))[1] * (1 + 1e-9) + 1e-6 for c in range(len(centres))])
        filled = np.array([c in cells for c in range(len(centres))])
        for b in batches:
            each = [np.frombuffer(x.as_py(), np.float64) for x in b.column(1)]
            width = max(map(len, each), default=0)
            x, c = away(np.stack([np.pad(v, (0, width - len(v))) for v in each]) if each else np.zeros((0, 0)))
            for at in range(0, len(x), 1024):
                q = x[at : at + 1024]
                upper = q @ c.T + np.sqrt((q * q).sum(1))[:, None] * radius[None]
                upper += np.abs(upper) * 1e-9 + 1e-3
                i, cell = np.nonzero((upper >= b.column(2).to_numpy()[at : at + 1024, None]) & filled[None])
                count = np.array([split.get(int(j), 1) for j in cell], np.int64)
                i, shard = np.repeat(i, count) + at, np.repeat(cell * most, count) + np.concatenate([np.arange(z) for z in count] or [np.zeros(0, np.int64)])
                yield pa.RecordBatch.from_arrays([*(b.column(j).take(pa.array(i)) for j in range(3)), pa.array(shard, pa.int64())], names=["query_id", "q", "bound", "shard"])

    asked = bounds.mapInArrow(route, "query_id long, q binary, bound double, shard long").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    held = rows.select("vec_id", "v", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("block"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        tree = _tree(a)[0]
        q_ids = b.column("query_id").to_numpy()
        each = [np.frombuffer(x, np.float64) for x in b.column("q").to_pylist()]
        q = np.zeros((len(each), max(map(len, each), default=0)))
        for i, v in enumerate(each):
            q[i, : len(v)] = v
        s, i = tree.search(q_ids, q, b.column("bound").to_numpy(), k)
        ok = np.isfinite(s)
        return pa.table({"query_id": pa.array(np.repeat(q_ids, k).reshape(-1, k)[ok], pa.int64()), "vec_id": pa.array(i[ok], pa.int64()), "score": pa.array(s[ok].astype(np.int64), pa.int64())})

    found = held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(meet, "query_id long, vec_id long, score long")
    # at most k rows a query and shard; each task keeps k a query before they are dealt
    best = F.row_number().over(_by_query())
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_query():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
