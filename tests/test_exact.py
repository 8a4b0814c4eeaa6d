from pyspark.sql import functions as F

from kindred.functions import columns as C
from kindred.operators import exact


def items(spark, rows):
    df = spark.createDataFrame(rows, "uri string, content binary, mtime_ns long")
    return df.withColumn("size", F.octet_length("content").cast("long"))


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["anchor"], set()).add(r["uri"])
    return out


def test_same_size_isnt_same_content(spark):
    d = items(spark, [("a", b"xxxx", 1), ("b", b"xxxx", 2), ("c", b"xxxx", 3), ("d", b"xxxy", 0), ("e", b"z", 0)])
    assert groups(exact.exact_groups(d)) == {"a": {"a", "b", "c"}}


def test_empty_items_need_min_size_zero(spark):
    d = items(spark, [("a", b"", 1), ("b", b"", 2)])
    assert groups(exact.exact_groups(d)) == {}
    assert groups(exact.exact_groups(d, min_size=0)) == {"a": {"a", "b"}}


def test_middle_difference(spark):
    head, tail = b"h" * 100_000, b"t" * 100_000
    d = items(spark, [("a", head + b"1" + tail, 1), ("b", head + b"2" + tail, 1), ("c", head + b"1" + tail, 1)])
    assert groups(exact.exact_groups(d)) == {"a": {"a", "c"}}
    plan = {r["uri"]: r["to_hash"] for r in exact.sample_plan(d, C.sample_hash(F.col("content"), F.col("size"))).collect()}
    assert plan == {"a": True, "b": True, "c": True}


def test_oldest_is_anchor_and_ranking(spark):
    d = items(spark, [("b", b"1" * 100, 1), ("a", b"1" * 100, 2), ("x", b"2" * 10_000, 1), ("y", b"2" * 10_000, 1)])
    g = exact.exact_groups(d)
    assert groups(g) == {"b": {"a", "b"}, "x": {"x", "y"}}
    assert [r["anchor"] for r in g.filter("role = 'anchor'").orderBy(F.desc("reclaimable")).collect()] == ["x", "b"]


def test_provided_hashes_aren_t_read(spark):
    d = items(spark, [("a", b"1111", 1), ("b", b"2222", 1), ("c", b"3333", 1)]).withColumn("provided_hash", F.expr("if(uri = 'c', 'MD5:y', 'md5:x')"))
    assert groups(exact.exact_groups(d.withColumn("provided_hash", F.expr("if(uri = 'c', 'md5:y', 'md5:x')")))) == {"a": {"a", "b"}}
    mixed = d.withColumn("provided_hash", F.expr("if(uri = 'c', 'sha1:x', 'md5:x')"))
    assert groups(exact.exact_groups(mixed)) == {}


def test_references(spark):
    d = items(spark, [("r", b"abc", 1), ("a", b"abc", 1), ("b", b"abc", 1), ("c", b"abd", 1)])
    g = exact.exact_references(d, d.filter("uri = 'r'"))
    assert {(r["anchor"], r["uri"]) for r in g.collect()} == {("r", "a"), ("r", "b")}
    two = exact.exact_references(d, d.filter("uri IN ('r', 'a')"))
    assert {(r["anchor"], r["uri"]) for r in two.collect()} == {("r", "b"), ("a", "b")}


def test_extension_and_roots(spark):
    d = spark.createDataFrame([("/x/A.JPG", ".jpg"), (".bashrc", ""), ("..a.b", ".b"), ("/x.y/z", ""), ("a.", "."), ("a.tar.gz", ".gz")], "u string, e string")
    assert all(r[0] == r[1] for r in d.select(C.extension(F.col("u")), "e").collect())
    p = spark.createDataFrame([("/m/n",), ("/mm/n",), ("/m",)], "p string")
    assert [r[0] for r in p.select(C.below_any(F.col("p"), ["/m/"])).collect()] == [True, False, False]
