"""Feature and hash caches as Parquet tables."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = 2
OVERHEAD = 128
DAY = 86_400
FILES = "uri string, size long, mtime_ns long, validator string, content_hash string, last_seen long"
FEATURES = "uri string, size long, mtime_ns long, validator string, extractor string, extractor_version int, params_digest string, data binary, last_seen long"
KEY = ["uri", "extractor", "extractor_version", "params_digest"]


def lookup(items: DataFrame, features: DataFrame) -> DataFrame:
    """items with data and state: hit, unreadable (a hit without data) or miss. A row is a hit if size, mtime and validator are as they were."""
    f = features.select(F.col("uri").alias("c_uri"), F.col("size").alias("c_size"), F.col("mtime_ns").alias("c_mtime"), F.col("validator").alias("c_validator"), "data", F.lit(True).alias("found"))
    on = F.expr("uri = c_uri AND size = c_size AND mtime_ns = c_mtime AND validator <=> c_validator")
    state = F.when(F.col("found").isNull(), "miss").when(F.col("data").isNull(), "unreadable").otherwise("hit")
    return items.join(f, on, "left").withColumn("state", state).drop("c_uri", "c_size", "c_mtime", "c_validator", "found")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new, and those of old with other keys."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def touched(old: DataFrame, seen: DataFrame, key: list[str], now: int) -> DataFrame:
    """old with last_seen set to now where the key is in seen."""
    return old.join(seen.select(*key).distinct().withColumn("_seen", F.lit(True)), key, "left").withColumn("last_seen", F.when(F.col("_seen"), F.lit(now)).otherwise(F.col("last_seen"))).select(*old.columns)


def young(rows: DataFrame, cutoff: int) -> DataFrame:
    return rows.filter(F.col("last_seen") >= cutoff)


def within_bytes(features: DataFrame, most: int) -> DataFrame:
    """The newest features: the oldest go while what is left exceeds most bytes (OVERHEAD a row added).

    Sums come first by whole days, then by the seconds
    of the day that the limit falls into; only rows of one second are put in
    an order in one place.
    """
    cost = (F.coalesce(F.octet_length("data"), F.lit(0)) + OVERHEAD).cast("long")
    rows = features.withColumn("_cost", cost)
    total = rows.agg(F.sum("_cost")).first()[0] or 0
    excess = total - most
    if excess <= 0:
        return features
    lo, span, used = None, DAY, 0
    for span in (DAY, 1):
        inside = rows if lo is None else rows.filter((F.col("last_seen") >= lo) & (F.col("last_seen") < lo + DAY))
        at = F.floor(F.col("last_seen") / span) * span
        for r in inside.groupBy(at.alias("at")).agg(F.sum("_cost").alias("c")).orderBy("at").toLocalIterator():  # days, then seconds of a day
            lo = r["at"]
            if used + r["c"] >= excess:
                break
            used += r["c"]
    inside = Window.partitionBy("last_seen").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, -1)
    at_edge = rows.filter(F.col("last_seen") == lo).withColumn("_before", F.coalesce(F.sum("_cost").over(inside), F.lit(0)) + used).filter(F.col("_before") >= excess).drop("_before")
    return rows.filter(F.col("last_seen") > lo).unionByName(at_edge).drop("_cost")


def rollup(features: DataFrame) -> DataFrame:
    return features.groupBy("extractor", "extractor_version", "params_digest").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("data").isNull().cast("long")).alias("unreadable"), F.sum(F.coalesce(F.octet_length("data"), F.lit(0)).cast("long")).alias("bytes")
    )


class Cache:
    """Two Parquet tables and their version in a folder that Spark can write. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        meta = self._read_meta()
        if meta is None and self._exists(self.path) and len(self._fs.listStatus(self._p(self.path))):
            raise ValueError(f"{path} is not a cache")
        if meta and meta["version"] > VERSION:
            raise ValueError(f"{path} was written by a newer version")
        if meta is None or meta["version"] < VERSION:
            self._write_meta({"version": VERSION, "files": 0, "features": 0})

    def _p(self, s: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(s)

    def _exists(self, s: str) -> bool:
        return self._fs.exists(self._p(s))

    def _read_meta(self) -> dict | None:
        p = f"{self.path}/meta.json"
        return json.loads("".join(r[0] for r in self.spark.read.text(p).collect())) if self._exists(p) else None

    def _write_meta(self, meta: dict) -> None:
        tmp = f"{self.path}/meta.json.tmp"
        self._fs.mkdirs(self._p(self.path))
        out = self._fs.create(self._p(tmp), True)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        self._fs.delete(self._p(f"{self.path}/meta.json"), False)
        self._fs.rename(self._p(tmp), self._p(f"{self.path}/meta.json"))

    def table(self, name: str) -> DataFrame:
        n = self._read_meta()[name]
        schema = FILES if name == "files" else FEATURES
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}-{n}") if n else self.spark.createDataFrame([], schema)

    def replace(self, name: str, rows: DataFrame) -> None:
        """Write a new generation of a table, then point to it: readers see the old or the new one."""
        meta = self._read_meta()
        n = meta[name] + 1
        rows.select(*self.table(name).columns).write.mode("overwrite").parquet(f"{self.path}/{name}-{n}")
        self._write_meta(meta | {name: n})
        if n > 1:
            self._fs.delete(self._p(f"{self.path}/{name}-{n - 1}"), True)

    def put(self, name: str, rows: DataFrame, seen: DataFrame | None = None) -> None:
        """Put rows in; those of `seen`, which have the table's key, were hits: they count as seen now, so that gc keeps them."""
        key = ["uri"] if name == "files" else KEY
        old = self.table(name)
        if seen is not None:
            old = touched(old, seen, key, int(time.time()))
        self.replace(name, upsert(old, rows, key))

    def gc(self, *, max_age_days: float | None = None, max_bytes: int | None = None) -> tuple[int, int]:
        """Rows removed from files and features."""
        removed = [0, 0]
        for k, name in enumerate(("files", "features")):
            old = self.table(name)
            new = old if max_age_days is None else young(old, int(time.time() - max_age_days * 86_400))
            if name == "features" and max_bytes is not None:
                new = within_bytes(new, max_bytes)
            if new is not old:
                before = old.count()
                self.replace(name, new)
                removed[k] = before - self.table(name).count()
        return removed[0], removed[1]

    def stats(self) -> dict:
        size = self._fs.getContentSummary(self._p(self.path)).getLength()
        return {"path": self.path, "files": self.table("files").count(), "features": self.table("features").count(), "bytes": size}
