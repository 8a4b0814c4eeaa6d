"""The scan path: what is read, what is kept, what is told."""

import os

import pytest
from pyspark.sql import functions as F

from kindred.operators.cache import Cache
from kindred.operators.star import cut
from kindred.plans import registry, scan
from kindred.sources import items as sources


def listed(spark, folder):
    return cut(sources.walk(spark, [str(folder)])[0])


def groups(result):
    out = {}
    for r in result.groups.filter("role = 'member'").collect():
        out.setdefault(os.path.basename(r["anchor"]), set()).add(os.path.basename(r["uri"]))
    return out


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "d"
    d.mkdir()
    big = lambda first, mid, last: first + b"m" * 70_000 + mid + b"n" * 70_000 + last
    contents = {"a": b"same", "b": b"same", "c": b"else", "lone": b"longer", "x": big(b"1", b"5", b"9"), "y": big(b"1", b"5", b"9"), "z": big(b"1", b"6", b"9"), "w": big(b"2", b"5", b"9"), "e1": b"", "e2": b""}
    for k, (name, c) in enumerate(contents.items()):
        (d / name).write_bytes(c)
        os.utime(d / name, ns=(10**9 * (k + 1),) * 2)
    return d


def test_only_what_may_be_equal_is_read(spark, folder):
    items = listed(spark, folder)
    assert groups(scan.find_identical(items)) == {"a": {"b"}, "x": {"y"}}
    assert groups(scan.find_identical(items, min_size=0)) == {"a": {"b"}, "x": {"y"}, "e1": {"e2"}}
    keys, broken = scan.file_keys(items.withColumn("ref", F.lit(False)), scan.Watch(), None)
    got = {os.path.basename(r["uri"]): r["key"] for r in keys.collect()}
    assert "lone" not in got and got["w"] is None and got["x"] == got["y"] != got["z"] and got["x"].startswith("sha256:") and broken.count() == 0


def test_second_scan_reads_nothing(spark, folder, tmp_path):
    cache = Cache(spark, str(tmp_path / "cache"))
    items = listed(spark, folder)
    first = groups(scan.find_identical(items, cache=cache))
    before = {r["uri"]: r["last_seen"] for r in cache.table("files").collect()}
    assert {os.path.basename(u) for u in before} == {"a", "b", "c", "x", "y", "z"}  # w is told apart by its beginning
    cache.replace("files", cut(cache.table("files").withColumn("last_seen", F.lit(5).cast("long"))))
    for p in folder.iterdir():
        p.unlink()
    again = scan.find_identical(items.filter(~F.col("uri").endswith("/w")), cache=cache)
    assert groups(again) == first and again.unreadable.count() == 0
    assert all(r["last_seen"] > 5 for r in cache.table("files").collect())  # hits count as seen
    assert groups(scan.find_identical(items.filter(~F.col("uri").endswith("/w")), references=items.filter(F.col("uri").endswith("/b")), cache=cache)) == {"b": {"a"}}
    gone = scan.find_identical(items)
    assert gone.groups.count() == 0 and gone.unreadable.count() == 7


def test_items_and_references_count_once(spark, folder):
    items = listed(spark, folder)
    assert groups(scan.find_identical(items.unionByName(items))) == {"a": {"b"}, "x": {"y"}}
    os.link(folder / "a", folder / "other")
    both = listed(spark, folder)
    assert both.count() == items.count()  # two names of a file come once
    ref = both.filter(F.col("uri").endswith("/b"))
    again = both.unionByName(ref.withColumn("uri", F.lit("/elsewhere/b")))
    assert groups(scan.find_identical(again, references=ref)) == {"b": {"a"}}


def test_references_keep_their_order(spark):
    d = spark.createDataFrame([(u, 1, 0, b"k") for u in ("z", "m", "a", "i")], "uri string, size long, mtime_ns long, content binary")
    refs = spark.createDataFrame([(u, 1, 0, b"k") for u in ("z", "a", "m")], d.schema).coalesce(1)
    rows = scan.find_identical(d, references=refs).groups.filter("role = 'anchor'").orderBy(F.desc("rank")).collect()
    assert [r["anchor"] for r in rows] == ["z", "a", "m"]


def test_a_scan_tells_and_can_be_stopped(spark, folder):
    told, phases = [], []
    items = listed(spark, folder)
    watch = scan.Watch(progress=lambda p, d, t: phases.append(p), on_group=lambda a, m: told.append((os.path.basename(a), [os.path.basename(u) for u, _ in m])))
    scan.find_identical(items, watch=watch)
    assert told == [("x", ["y"]), ("a", ["b"])] and phases == ["list", "sample", "hash", "group"]
    stopped = scan.find_identical(items, watch=scan.Watch(progress=lambda p, d, t: phases.append(p), cancelled=lambda: phases.count("hash") > 1))
    assert stopped.cancelled and stopped.groups.count() == 0


@registry.register
class Length(registry.Extractor):
    """Similarity of lengths. Its index sees equal ones only."""

    name, version, default_threshold = "length", 1, 0.5

    def extract(self, data):
        if data == b"later":
            raise registry.ExtractionFailed("busy", transient=True)
        return str(len(data)).encode()

    def prepare(self, features):
        return [int(x) for x in features]

    def similarities(self, query, prepared):
        return [1.0 if int(query) == x else 0.0 for x in prepared]


@registry.register
class Indexed(Length):
    name = "indexed"

    def edges(self, features, queries, threshold):
        a, b = queries.select(F.col("uri").alias("a"), "data"), features.select(F.col("uri").alias("b"), "data")
        return a.join(b, "data").filter("a <> b").select("a", "b", F.lit(1.0).alias("similarity"))


def rows(spark, contents):
    return spark.createDataFrame([(u, len(c), 1, None, c) for u, c in contents.items()], "uri string, size long, mtime_ns long, validator string, content binary")


def test_what_an_index_leaves_out_has_similarity_zero(spark):
    d = rows(spark, {"a": b"xx", "b": b"yy", "c": b"zzz"})
    for name in ("length", "indexed"):
        got = scan.find_similar(d, name, threshold=0.0).groups.filter("role = 'member'").collect()
        assert {(r["anchor"], r["uri"], r["similarity"]) for r in got} == {("c", "a", 0.0), ("c", "b", 0.0)}
        assert groups(scan.find_similar(d, name)) == {"a": {"b"}}


def test_failures_that_pass_are_tried_again(spark, tmp_path):
    cache = Cache(spark, str(tmp_path / "cache"))
    d = rows(spark, {"a": b"xx", "b": b"yy", "c": b"later"})
    first = scan.find_similar(d, "length", cache=cache)
    assert [(r["uri"], r["message"]) for r in first.errors.collect()] == [("c", "busy")] and first.unreadable.count() == 0
    assert cache.table("features").count() == 2


def test_snapshots_and_cancelled_work_stay(spark, tmp_path):
    cache = Cache(spark, str(tmp_path / "cache"))
    d = rows(spark, {f"u{i}": b"x" * (1 + i % 3) for i in range(12)})
    seen = []
    r = scan.find_similar(d, "length", cache=cache, watch=scan.Watch(on_snapshot=lambda g, done, total: seen.append((g.filter("role = 'member'").count(), done, total))))
    assert [x[1:] for x in seen] == [(1, 4), (2, 4), (3, 4)] and seen[0][0] <= seen[-1][0] <= 9 and r.groups.filter("role = 'member'").count() == 9
    other, steps = Cache(spark, str(tmp_path / "other")), []
    watch = scan.Watch(progress=lambda p, d, t: steps.append(p), cancelled=lambda: len(steps) >= 2)
    stopped = scan.find_similar(d, "length", cache=other, watch=watch)
    assert stopped.cancelled and 0 < other.table("features").count() < 12
