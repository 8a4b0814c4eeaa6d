"""Groups of equal contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.columns import algorithm, content_hash


def first_of_each(items: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row for each value of keys. Aggregated on the map side before it shuffles, so hot keys cost one row a task."""
    rest = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.struct(*items.columns).alias("row"))
    return items.groupBy(*keys).agg(F.min(rest).alias("m")).select("m.row.*")


def size_buckets(items: DataFrame) -> DataFrame:
    """size, n, reclaimable of the sizes that more than one item has."""
    return items.groupBy("size").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("reclaimable", F.col("size") * (F.col("n") - 1))


def keyed(items: DataFrame) -> DataFrame:
    """uri, size, mtime_ns, key: the key by which items of one size are compared.

    If every item of a size came with a digest and all are of one algorithm,
    that is the key and no content is read; else it is the content's
    SHA-256 (a provided one is adopted as it is).
    """
    if "provided_hash" not in items.columns:
        return items.select("uri", "size", "mtime_ns", content_hash(F.col("content")).alias("key"))
    alg = algorithm(F.col("provided_hash"))
    per_size = items.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.count("provided_hash").alias("given"), F.min(alg).alias("a"), F.max(alg).alias("b"))
    per_size = per_size.select("size", F.expr("given = n AND a = b").alias("as_given"))
    read = F.when(alg == "sha256", F.col("provided_hash")).otherwise(content_hash(F.col("content")))
    slim = items.select("uri", "size", "mtime_ns", "provided_hash", read.alias("read"))
    return slim.join(per_size, "size").select("uri", "size", "mtime_ns", F.when(F.col("as_given"), F.col("provided_hash")).otherwise(F.col("read")).alias("key"))


def once(rows: DataFrame) -> DataFrame:
    """One row for each uri of uri, size, mtime_ns, key."""
    least = F.min(F.struct("mtime_ns", "size", "key")).alias("r")
    return rows.groupBy("uri").agg(least).select("uri", "r.size", "r.mtime_ns", "r.key")


def not_references(items: DataFrame, refs: DataFrame) -> DataFrame:
    """items that are no reference themselves: neither by uri nor, where both tables have dev and ino, as another name of the same file."""
    rest = items.join(refs.select("uri"), "uri", "left_anti")
    if {"dev", "ino"} <= set(items.columns) and {"dev", "ino"} <= set(refs.columns):
        rest = rest.join(refs.filter("ino <> 0").select("dev", "ino").distinct(), ["dev", "ino"], "left_anti")
    return rest


def exact_groups(items: DataFrame, *, min_size: int = 1) -> DataFrame:
    """rank, anchor, uri, role, similarity, size: the groups of equal items, the ones that free most first.

    The anchor is the oldest, then the first by name. Items listed more than
    once, by uri, count once. Items are compared by size and key; only slim
    rows shuffle, never contents, and the join back is to one row a group, so
    a hot group can be split.
    """
    return groups_of(once(keyed(items.filter(F.col("size") >= min_size))))


def groups_of(rows: DataFrame) -> DataFrame:
    """exact_groups of rows uri, size, mtime_ns, key; a null key equals nothing but counts in its size."""
    groups = rows.filter("key IS NOT NULL").groupBy("size", "key").agg(F.min(F.struct("mtime_ns", "uri")).alias("a"), F.count(F.lit(1)).alias("n_items")).filter("n_items > 1")
    per_size = rows.groupBy("size").agg(F.count(F.lit(1)).alias("in_size"))
    groups = groups.join(per_size, "size").select("size", "key", F.col("a.uri").alias("anchor"), "n_items", (F.col("size") * (F.col("in_size") - 1)).alias("reclaimable"))
    return rows.join(groups, ["size", "key"]).select(
        "anchor", "uri", F.when(F.col("uri") == F.col("anchor"), "anchor").otherwise("member").alias("role"), F.lit(1.0).alias("similarity"), "size", "n_items", "reclaimable"
    )


def exact_references(items: DataFrame, references: DataFrame, *, min_size: int = 1) -> DataFrame:
    """anchor (a reference), uri, similarity, size: the items equal to each reference, themselves not references.

    Only sizes that occur among references are hashed. Items and references
    are taken once by uri; two equal references have a group each. Items that
    are references, or other names of their files, are in no group.
    """
    refs = references.filter(F.col("size") >= min_size).dropDuplicates(["uri"])
    sizes = refs.select("size").distinct()
    others = not_references(items.filter(F.col("size") >= min_size), refs).join(sizes, "size", "left_semi")
    # both sides together decide by which digest a size is compared
    both = once(keyed(refs.unionByName(others, allowMissingColumns=True)))
    marked = both.join(refs.select("uri", F.lit(True).alias("is_ref")), "uri", "left")
    a = marked.filter("is_ref").select(F.col("uri").alias("anchor"), "size", "key")
    return marked.filter("is_ref IS NULL").join(a, ["size", "key"]).select("anchor", "uri", F.lit(1.0).alias("similarity"), "size")


def sample_plan(items: DataFrame, sample: Column) -> DataFrame:
    """uri, size, sample, to_hash: whether an item must be read whole, since others of its size share its sample or have none."""
    return sampled_plan(items.select("uri", "size", sample.alias("sample")))


def sampled_plan(rows: DataFrame) -> DataFrame:
    by_size = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.count("sample").alias("known"))
    by_sample = rows.groupBy("size", "sample").agg(F.count(F.lit(1)).alias("same"))
    joined = rows.join(by_size, "size").join(by_sample.withColumnRenamed("sample", "s2").withColumnRenamed("size", "z2"), F.expr("size = z2 AND sample <=> s2"))
    return joined.select("uri", "size", "sample", F.expr("n > 1 AND (same > 1 OR known < n)").alias("to_hash"))
