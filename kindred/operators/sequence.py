"""Sequences of 32-bit values: the same, excerpts, and contained ones, by votes for an offset.

A row has id, n (length) and items (array of longs). A quarter of the
values, chosen by the value alone, is indexed; each pair of equal indexed
values votes for the offset at which the two sequences line up; the best
offsets are compared item by item by bit errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.columns import sampled
from kindred.operators.star import cut, release

MAX_REPEATS, COMMON, MIN_VOTES, CANDIDATES = 4, 50, 2, 3


def keys(seqs: DataFrame) -> DataFrame:
    """id, i, value of the indexed items: sampled ones that come at most MAX_REPEATS times among those of their sequence."""
    hits = F.filter(F.transform("items", lambda v, i: F.struct(i.cast("long").alias("i"), v.alias("value"))), lambda x: sampled(x["value"]))
    rows = seqs.select("id", hits.alias("hits")).select("id", F.explode("hits").alias("x")).select("id", "x.i", "x.value")
    # a window within one sequence: bounded by its length
    n = F.count(F.lit(1)).over(Window.partitionBy("id", "value"))
    return rows.withColumn("n", n).filter(F.col("n") <= MAX_REPEATS).drop("n")


def common_values(index: DataFrame, limit: int = COMMON) -> DataFrame:
    """value, n_rows, n_ids of values that more than limit rows and more than limit sequences have."""
    per = index.groupBy("value", "id").agg(F.count(F.lit(1)).alias("c")).groupBy("value").agg(F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_ids"))
    return per.filter((F.col("n_rows") > limit) & (F.col("n_ids") > limit))


def offset_votes(queries: DataFrame, index: DataFrame, limit: int = COMMON, *, others: bool = False) -> DataFrame:
    """q, v, d, votes, first_i. Values common to many sequences are dropped before the join, so no value joins with more than limit sequences. others: not of a sequence with itself."""
    useful = index.join(common_values(index, limit).select("value"), "value", "left_anti")
    a = queries.select(F.col("id").alias("q"), F.col("i").alias("qi"), "value")
    b = useful.select(F.col("id").alias("v"), F.col("i").alias("vi"), "value")
    met = a.join(b, "value")
    met = met.filter("q <> v") if others else met
    return met.groupBy("q", "v", (F.col("vi") - F.col("qi")).alias("d")).agg(F.count(F.lit(1)).alias("votes"), F.min("qi").alias("first_i"))


def neighbour_votes(votes: DataFrame) -> DataFrame:
    """votes with near: those of the offset and its two neighbours."""
    w = Window.partitionBy("q", "v").orderBy("d").rangeBetween(-1, 1)
    return votes.withColumn("near", F.sum("votes").over(w))


def best_offsets(votes: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """The k offsets with most votes of each pair (ties: seen first, then the smaller) that have MIN_VOTES with their neighbours."""
    w = Window.partitionBy("q", "v").orderBy(F.desc("votes"), "first_i", "d")
    return neighbour_votes(votes).withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= k) & (F.col("near") >= MIN_VOTES))


def score(x: Column, y: Column, shift: Column) -> Column:
    """Of x and y (arrays) with item i of x on i + shift of y: mean agreement over the shorter."""
    skip_x, skip_y = F.greatest(-shift, F.lit(0)).cast("int"), F.greatest(shift, F.lit(0)).cast("int")
    n = F.greatest(F.least(F.size(x) - skip_x, F.size(y) - skip_y), F.lit(0))
    errors = F.aggregate(F.zip_with(F.slice(x, skip_x + 1, n), F.slice(y, skip_y + 1, n), lambda a, b: F.bit_count(a.bitwiseXOR(b)).cast("long")), F.lit(0).cast("long"), lambda s, e: s + e)
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), n - errors / F.lit(16.0)) / F.least(F.size(x), F.size(y)))


def similarities(queries: DataFrame, seqs: DataFrame, *, limit: int = COMMON, threshold: float = 0.0, others: bool = False) -> DataFrame:
    """q, v, similarity for pairs with a candidate offset; queries and seqs have id, items. others: without pairs of a sequence with itself, which then cost nothing.

    Sequences travel once for each pair, and only those that have one.
    """
    same = queries is seqs
    seqs = cut(seqs.select("id", "items"))  # made once: indexed, counted and compared
    queries = seqs if same else cut(queries.select("id", "items"))
    index = cut(keys(seqs))
    votes = offset_votes(index if same else keys(queries), index, limit, others=others)
    shifts = best_offsets(votes).select("q", "v", F.explode(F.array(F.col("d") - 1, F.col("d"), F.col("d") + 1)).alias("d")).distinct()
    shifts = cut(shifts.groupBy("q", "v").agg(F.collect_set("d").alias("ds")))  # at most 9
    del index, votes
    release(seqs.sparkSession)
    met = shifts.join(queries.select(F.col("id").alias("q"), F.col("items").alias("x")), "q").join(seqs.select(F.col("id").alias("v"), F.col("items").alias("y")), "v")
    best = F.array_max(F.transform("ds", lambda d: score(F.col("x"), F.col("y"), d)))
    return met.select("q", "v", best.alias("similarity")).filter(F.col("similarity") >= threshold)


def shingle_sequence(text: Column, words: int = 3) -> Column:
    """A text as a sequence: 32-bit hashes of its runs of words, in order."""
    ws = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.greatest(F.size(ws) - words + 1, F.lit(0))
    # runs by zipping shifted copies: inside a lambda the split would be made anew for each run
    zipped = F.arrays_zip(*(F.slice(ws, k + 1, n).alias(f"w{k}") for k in range(words)))
    return F.transform(zipped, lambda r: F.conv(F.substring(F.md5(F.concat_ws(" ", *(r[f"w{k}"] for k in range(words)))), 1, 8), 16, 10).cast("long"))
