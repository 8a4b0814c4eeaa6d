"""What the operators share: reading tables, cutting lineage, splits by crc32."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Run df once and keep its rows in the shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``; only where that is
    unset and the driver is the only machine, as in tests, a temporary one is
    made.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="kindred-cp-"))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps that nothing refers to any more: it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of its own that a Python worker may hold when a task or a large group of rows ends; what is free beyond goes back to the system.
HELD_BYTES = 128 << 20


def give_back() -> None:
    """Give the memory that is free in this process back to the system: workers live on, idle or in another stage, beside the JVM."""
    chunks = sys.modules.get("kindred.llm.chunks")
    if chunks is not None:  # the memo of an earlier stage that made tokens
        chunks.tokenizer.cache_clear()
    try:
        with open("/proc/self/statm") as f:
            _, resident, shared = map(int, f.read().split()[:3])
        if (resident - shared) * 4096 > HELD_BYTES:
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not on Linux
        pass


def light(run: Callable) -> Callable:
    """run, a function for mapInArrow, giving back memory when its task ends."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def light1(run: Callable) -> Callable:
    """The same for a function of a group's rows, after each group."""

    def group(t):
        try:
            return run(t)
        finally:
            give_back()

    return group


def light2(run: Callable) -> Callable:
    """The same for a function of the rows of two sides."""

    def groups(t, other):
        try:
            return run(t, other)
        finally:
            give_back()

    return groups


def join_few(rows: DataFrame, one: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined with one, which has a row for each key with the count of its rows.

    Keys that hold a hundredth of all rows or more, at most 100 of them, are
    joined by broadcast, so that no task gets one whole; the others shuffle.
    """
    total = one.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) >= max(1, total // 100)
    few = one.filter(hot).drop(count)
    marked = rows.join(F.broadcast(few.select(key, F.lit(True).alias("hot_"))), key, "left")
    cold = marked.filter("hot_ IS NULL").drop("hot_").join(one.filter(~hot).drop(count), key)
    return rows.join(F.broadcast(few), key).unionByName(cold)


def remainder(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo mod."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(mod))


def sampled_ids(labelled: DataFrame, limit: int) -> DataFrame:
    """At most limit rows, the same ones in every run: those with the least hash of doc_id."""
    return labelled.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(limit)
