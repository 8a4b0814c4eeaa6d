import json
import os

import pytest
from pyspark.sql import functions as F

from kindred import cli
from kindred.operators.cache import Cache, within_bytes
from kindred.plans import scan
from kindred.sources import items as sources
from kindred.sources import sinks
from kindred.streaming.snapshots import Snapshots, watch


@pytest.fixture
def tree(tmp_path):
    d = tmp_path / "t"
    (d / "sub").mkdir(parents=True)
    for name, text in (("a.txt", "same"), ("b.txt", "same"), ("sub/c.txt", "same"), ("sub/d.txt", "else")):
        (d / name).write_text(text)
    os.link(d / "a.txt", d / "hard.txt")
    os.symlink(d / "b.txt", d / "link.txt")
    os.symlink(d, d / "sub" / "loop")
    return d


def test_walk(spark, tree):
    items, counts = sources.walk(spark, [str(tree), str(tree / "sub")])
    assert sorted(os.path.relpath(r["uri"], tree) for r in items.collect()) == ["a.txt", "b.txt", "sub/c.txt", "sub/d.txt"]
    assert counts.first()["symlinks_skipped"] == 3
    items, counts = sources.walk(spark, [str(tree)], follow_symlinks=True, remote_roots=(str(tree / "sub"),))
    assert counts.first()["links_revisited"] >= 1
    assert {os.path.relpath(r["uri"], tree) for r in items.filter("is_remote").collect()} == {"sub/c.txt", "sub/d.txt"}
    assert sources.walk(spark, [str(tree / "none")])[1].first()["errors"] == 1


def test_scan_writes_and_reads_back(spark, tree, tmp_path):
    out = str(tmp_path / "out")
    args = ["scan", str(tree), "--out", out, "--tree", str(tmp_path / "t.json"), "--no-cache", "--status", str(tmp_path / "s.json")]
    assert cli.main(args, spark) == cli.OK
    (path,) = sinks.our_playlists(out)
    assert path.name == "a.txt (2).m3u8"
    head, entries = sinks.read_playlist(path)
    assert head["members"] == 2 and [e[1]["role"] for e in entries] == ["anchor", "member", "member"]
    assert sources.read_playlists(spark, out).count() == 3
    doc = sinks.read_tree(tmp_path / "t.json")
    assert doc["final"] and len(doc["nodes"]) == 1 and doc["generation"] == 1
    assert sinks.read_status(tmp_path / "s.json")["state"] == "done"
    assert cli.main(args, spark) == cli.BAD_OPTIONS
    assert cli.main([*args, "--replace"], spark) == cli.OK
    assert cli.main(["scan", str(tree), "--out", out, "--threshold", "0.5", "--replace"], spark) == cli.BAD_OPTIONS
    assert cli.main(["extractors"], spark) == cli.OK


def test_names(spark, tmp_path):
    d = spark.createDataFrame([("a/b:c. ",), ("con.txt",), ("...",), ("é" * 300,), ("x" * 198 + "日",), ("Con",), ("a\x01b",)], "n string")
    got = [r[0] for r in d.select(sinks.safe_stem(F.col("n"))).collect()]
    assert got == ["a_b_c", "_con.txt", "group", "é" * 100, "x" * 198, "_Con", "a_b"]
    rows = [("/p/a.txt", 3), ("/q/A.TXT", 5), ("/r/a.txt", 4), ("/r/z (1) [2]", 1), ("/r/b.txt", 9)]
    g = spark.createDataFrame([(r, u, 1) for u, r in rows], "rank long, anchor string, members long")
    got = {r["anchor"]: r["file"] for r in sinks.numbered(g, ["B.txt (1).m3u8"], ".m3u8").collect()}
    assert got == {"/q/A.TXT": "A.TXT (1).m3u8", "/r/a.txt": "a.txt (1) [2].m3u8", "/p/a.txt": "a.txt (1) [3].m3u8", "/r/z (1) [2]": "z (1) [2] (1).m3u8", "/r/b.txt": "b.txt (1) [2].m3u8"}
    p = tmp_path / "x.m3u8"
    p.write_text('#EXTM3U\n#KINDRED-GROUP:{"members":2}\n#other\n#KINDRED-ITEM:{"role":"anchor"}\n/a\n/b\n#EXTINF:1\n#KINDRED-ITEM:{"role":"member"}\n# x\n/c\n')
    assert sinks.read_playlist(p) == ({"members": 2}, [("/a", {"role": "anchor"}), ("/b", None), ("/c", {"role": "member"})]) and sinks.our_playlists(tmp_path) == [p]
    n = sinks.Names(["A.m3u8"])
    assert [n.new("a", ".m3u8"), n.new("a", ".m3u8")] == ["a [2].m3u8", "a [3].m3u8"]


def test_cache(spark, tree, tmp_path):
    c = Cache(spark, str(tmp_path / "cache"))
    items = sources.with_content(sources.walk(spark, [str(tree)])[0])
    first = scan.find_identical(items, cache=c).groups.collect()
    assert c.stats()["files"] == 4
    # contents changed, stat pretended unchanged: digests come from the cache
    again = scan.find_identical(items.withColumn("content", F.lit(b"none")), cache=c).groups.collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))
    assert c.gc(max_age_days=1) == (0, 0)
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x").write_text("x")
    with pytest.raises(ValueError):
        Cache(spark, str(tmp_path / "other"))
    (tmp_path / "cache" / "meta.json").write_text(json.dumps({"version": 99}))
    (tmp_path / "cache" / ".meta.json.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        Cache(spark, str(tmp_path / "cache"))


def test_cache_path(tmp_path, monkeypatch):
    monkeypatch.setenv("KINDRED_CACHE", str(tmp_path / "env"))
    assert cli.cache_path(None) == str(tmp_path / "env") and cli.cache_path(str(tmp_path / "own")) == str(tmp_path / "own")
    (tmp_path / "full").mkdir()
    (tmp_path / "full" / "other").write_text("x")
    assert cli.cache_path(str(tmp_path / "full")) == str(tmp_path / "full" / "kindred")
    monkeypatch.delenv("KINDRED_CACHE")
    monkeypatch.setenv("XDG_CACHE_HOME", str(tmp_path))
    monkeypatch.setattr("sys.platform", "linux")
    assert cli.cache_path(None) == str(tmp_path / "kindred")


def test_gc_by_bytes(spark):
    rows = [(f"u{i}", "e", 1, "p", b"x" * 1000, i // 3) for i in range(10)]
    d = spark.createDataFrame(rows, "uri string, extractor string, extractor_version int, params_digest string, data binary, last_seen long")
    assert sorted(r["uri"] for r in within_bytes(d, 5000).collect()) == ["u6", "u7", "u8", "u9"]


def test_snapshots_are_retracted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("kindred.streaming.snapshots.TIMES_GROUPING", 0)
    src, seen = tmp_path / "in", []
    d = spark.createDataFrame([("a", 4, 2, b"same"), ("b", 4, 3, b"same")], "uri string, size long, mtime_ns long, content binary")
    d.coalesce(1).write.parquet(str(src))
    w = Snapshots(str(tmp_path / "kept"), lambda i: scan.find_identical(i).groups, lambda g, n: seen.append(({r["anchor"] for r in g.collect()}, n)), interval=0)
    stream = lambda: spark.readStream.schema(d.schema).parquet(str(src))
    watch(stream(), w, str(tmp_path / "cp")).awaitTermination(120)
    spark.createDataFrame([("c", 4, 1, b"same")], d.schema).coalesce(1).write.mode("append").parquet(str(src))
    watch(stream(), w, str(tmp_path / "cp")).awaitTermination(120)
    assert seen[0] == ({"a"}, 2) and seen[-1] == ({"c"}, 3)


def test_image_source(spark, tmp_path):
    import struct
    import zlib

    import numpy as np

    def png(path, px):
        raw = b"".join(b"\0" + r.tobytes() for r in px.astype(np.uint8))
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", px.shape[1], px.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))

    y, x = np.mgrid[0:96, 0:128]
    scene = 127 + 60 * np.sin(x / 9.0) + 60 * np.cos(y / 13.0 + x / 40.0)
    png(tmp_path / "a.png", scene)
    png(tmp_path / "b.png", scene[::2, ::2])
    png(tmp_path / "c.png", 127 + 120 * np.sin(x * y / 300.0))
    (tmp_path / "d.png").write_bytes(b"no picture")
    h = scan.decoded_images(spark.read.format("image").load(str(tmp_path)), "ahash")
    got = {r["uri"].rsplit("/", 1)[1]: r["data"] for r in h.collect()}
    assert got["d.png"] is None
    edges = scan.binary_edges(h.filter("data IS NOT NULL"), h.filter("data IS NOT NULL"), 0.8)
    assert {(r["a"].rsplit("/", 1)[1], r["b"].rsplit("/", 1)[1]) for r in edges.collect()} == {("a.png", "b.png"), ("b.png", "a.png")}
