"""Star groups: visit items by rank; one not grouped yet that has neighbours takes all of them.

The anchors are the lexicographically first maximal independent set of the
items with neighbours (Blelloch, Fineman and Shun 2012). In each round an
undecided item without undecided in-neighbour of lower rank becomes an
anchor, and its neighbours of higher rank are out. What is left after
ROUNDS rounds, or fewer than SMALL items' edges, is decided on the driver.
"""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS, SMALL = 12, 50_000


def cut(df: DataFrame) -> DataFrame:
    """Run df and keep its rows in the shared checkpoint folder; a temporary one only where none is set."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="kindred-cp-"))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle files and checkpoints that nothing refers to any more: it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def numbered(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """rows with their number, from 1, in an order without ties: ranges are numbered on their own and moved by the counts before them."""
    parts = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id_", F.monotonically_increasing_id()))
    part = F.shiftright("id_", 33)
    before, moves = 0, []
    for r in parts.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():  # a row for each partition
        moves.append((r["p"], before))
        before += r["n"]
    moves = rows.sparkSession.createDataFrame(moves, "p_ long, before_ long")
    placed = parts.withColumn("p_", part).join(F.broadcast(moves), "p_")
    return placed.withColumn(name, F.expr("id_ & 8589934591") + F.col("before_") + 1).drop("p_", "id_", "before_")


def finish(edges: list[tuple[int, int]], undecided: set[int]) -> list[int]:
    """The sequential rule over what is left: edges go from lower rank to higher."""
    out: dict[int, list[int]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    gone: set[int] = set()
    anchors = []
    for v in sorted(undecided):
        if v not in gone:
            anchors.append(v)
            gone.update(out.get(v, ()))
    return anchors


def anchors(ranked: DataFrame) -> DataFrame:
    """rank of each anchor. ranked: directed edges (ra, rb), from anchor to member, both directions where the similarity is symmetric."""
    forward = cut(ranked.filter("ra < rb").select("ra", "rb").distinct())
    undecided = cut(ranked.select(F.col("ra").alias("v")).distinct())  # only those with neighbours of their own can be anchors
    found = None
    for i in range(ROUNDS + 1):
        live = forward.join(undecided, forward.ra == undecided.v, "left_semi").join(undecided, forward.rb == undecided.v, "left_semi")
        live = cut(live)
        if i == ROUNDS or live.limit(SMALL + 1).count() <= SMALL:
            if live.limit(SMALL + 1).count() <= SMALL:
                edges = [tuple(r) for r in live.collect()]  # at most SMALL
                touched = {v for e in edges for v in e}
                rest = undecided.join(live.select(F.explode(F.array("ra", "rb")).alias("v")).distinct(), "v", "left_anti")
                last = finish(edges, touched)
                new = rest.unionByName(live.sparkSession.createDataFrame([(v,) for v in last], "v long")) if last else rest
                return new if found is None else found.unionByName(new)
        new = cut(undecided.join(live.select(F.col("rb").alias("v")), "v", "left_anti"))
        out = forward.join(new, forward.ra == new.v, "left_semi").select(F.col("rb").alias("v")).distinct()
        undecided = cut(undecided.join(new, "v", "left_anti").join(out, "v", "left_anti"))
        found = new if found is None else found.unionByName(new)
        forward = live
    while not undecided.isEmpty():  # a long chain of a very large graph: more rounds
        live = cut(forward.join(undecided, forward.ra == undecided.v, "left_semi").join(undecided, forward.rb == undecided.v, "left_semi"))
        new = cut(undecided.join(live.select(F.col("rb").alias("v")), "v", "left_anti"))
        out = live.join(new, live.ra == new.v, "left_semi").select(F.col("rb").alias("v")).distinct()
        undecided = cut(undecided.join(new, "v", "left_anti").join(out, "v", "left_anti"))
        found, forward = found.unionByName(new), live
    return found


def star_groups(items: DataFrame, edges: DataFrame) -> DataFrame:
    """anchor, uri, similarity. items: id, size; edges: (a, b, similarity), a as the anchor; each direction is a row of its own."""
    ranked = items.select("id", F.struct((-F.col("size")).alias("s"), "id").alias("o"))
    # ranks only order things: sort position by range partitioning, no single task
    ids = _ranks(ranked)
    e = edges.join(ids.select(F.col("id").alias("a"), F.col("rank").alias("ra")), "a").join(ids.select(F.col("id").alias("b"), F.col("rank").alias("rb")), "b")
    e = cut(e.select("a", "b", "similarity", "ra", "rb"))
    chosen = anchors(e).withColumnRenamed("v", "ra")
    return e.join(chosen, "ra").select(F.col("ra").alias("rank"), F.col("a").alias("anchor"), F.col("b").alias("member"), "similarity")


def _ranks(ranked: DataFrame) -> DataFrame:
    """id, rank: numbers in the order of o, dense enough to compare; range partitions are numbered on their own."""
    parts = cut(ranked.repartitionByRange("o").sortWithinPartitions("o").withColumn("rank", F.monotonically_increasing_id()))
    return parts.select("id", "rank")


def reference_groups(edges: DataFrame) -> DataFrame:
    """Every reference keeps all its neighbours: no greedy step."""
    return edges.select(F.col("a").alias("anchor"), F.col("b").alias("member"), "similarity")
