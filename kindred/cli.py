"""python -m kindred: scan folders for identical or similar files."""

from __future__ import annotations

import argparse
import os
import signal
import sys
import threading
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kindred.operators.cache import VERSION, Cache
from kindred.plans import external, registry, scan  # noqa: F401  external registers its extractors
from kindred.sources import items as sources
from kindred.sources import sinks

OK, SOME_UNREADABLE, BAD_OPTIONS, CANCELLED = 0, 1, 2, 130


def cache_path(given: str | None) -> str:
    """The argument, else KINDRED_CACHE, else the platform's folder for caches. A folder that holds other things gets one of its own in it."""
    own = given or os.environ.get("KINDRED_CACHE")
    if own is None:
        homes = {"win32": os.environ.get("LOCALAPPDATA"), "darwin": Path.home() / "Library" / "Caches"}
        own = Path(homes.get(sys.platform) or os.environ.get("XDG_CACHE_HOME") or Path.home() / ".cache") / "kindred"
    own = Path(own)
    if own.is_dir() and any(own.iterdir()) and not (own / "meta.json").exists():
        own /= "kindred"
    return str(own)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kindred")
    p.add_argument("--version", action="version", version=f"kindred, cache format {VERSION}")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan", help="find groups and write them")
    s.add_argument("roots", nargs="+")
    s.add_argument("--method", default="identical")
    s.add_argument("--out", help="folder for playlists")
    s.add_argument("--tree", help="file for a JSON tree")
    s.add_argument("--replace", action="store_true", help="replace what an earlier scan wrote")
    s.add_argument("--reference", action="append", default=[], help="find only what matches these files")
    s.add_argument("--param", action="append", default=[], metavar="NAME=VALUE")
    s.add_argument("--threshold", type=float)
    s.add_argument("--min-size", type=int, default=1)
    s.add_argument("--follow-symlinks", action="store_true")
    s.add_argument("--remote-root", action="append", default=[])
    s.add_argument("--include-remote", action="store_true")
    s.add_argument("--cache")
    s.add_argument("--no-cache", action="store_true")
    s.add_argument("--status", help="file that says how the scan is doing")
    s.add_argument("--stop-file", help="the scan is cancelled once this file exists")
    sub.add_parser("extractors", help="list methods")
    c = sub.add_parser("cache", help="look after the cache")
    c.add_argument("action", choices=["info", "gc"], nargs="?", default="info")
    c.add_argument("--cache")
    c.add_argument("--max-age-days", type=float)
    c.add_argument("--max-bytes", type=int)
    c.add_argument("--max-size-mb", type=float)
    return p


def _conflict(a: argparse.Namespace) -> str | None:
    if not a.out and not a.tree:
        return "--out or --tree is needed"
    if a.method == "identical" and (a.param or a.threshold is not None):
        return "--param and --threshold need another method than identical"
    if a.method != "identical" and a.method not in registry.extractors():
        return f"no method {a.method}"
    if a.threshold is not None and not 0 <= a.threshold <= 1:
        return "--threshold is between 0 and 1"
    if not a.replace and (a.out and sinks.our_playlists(a.out) or a.tree and Path(a.tree).exists()):
        return "an earlier result is there: --replace it"
    return next((f"{x} has no value" for x in a.param if "=" not in x), None)


def _scan(a: argparse.Namespace, spark: SparkSession) -> int:
    if problem := _conflict(a):
        print(problem, file=sys.stderr)
        return BAD_OPTIONS
    sc, ended = spark.sparkContext, threading.Event()
    stopped = threading.Event()

    def cancel(*_):
        stopped.set()
        sc.cancelAllJobs()

    def poll():
        while not ended.wait(0.5):
            if a.stop_file and os.path.exists(a.stop_file):
                cancel()

    if threading.current_thread() is threading.main_thread():
        signal.signal(signal.SIGINT, lambda *x: (cancel(), signal.signal(signal.SIGINT, signal.default_int_handler)))
    threading.Thread(target=poll, daemon=True).start()
    status = sinks.Status(a.status) if a.status else None
    try:
        if status:
            status.progress("list", 0, 0)
        files, counts = sources.walk(spark, a.roots, follow_symlinks=a.follow_symlinks, remote_roots=tuple(a.remote_root))
        refs = sources.walk(spark, a.reference)[0] if a.reference else None
        watch = scan.Watch(progress=status.progress if status else None, cancelled=stopped.is_set)
        cache = None if a.no_cache else Cache(spark, cache_path(a.cache))
        meta = {"method": a.method, "version": 0, "params": {}, "threshold": 1.0}
        if a.method == "identical":
            result = scan.find_identical(files, references=refs, min_size=a.min_size, cache=cache, watch=watch)
        else:
            ex = registry.get_extractor(a.method, **dict(x.split("=", 1) for x in a.param))
            meta |= {"version": ex.version, "params": ex.params, "threshold": ex.default_threshold if a.threshold is None else a.threshold}
            result = scan.find_similar(files, a.method, watch=watch, threshold=a.threshold, references=refs, params=ex.params, cache=cache, include_remote=a.include_remote, min_size=a.min_size)
        groups = sinks.positions(result.groups)
        if a.out:
            written = sinks.write_playlists(groups, a.out, replace=a.replace, **meta)
            print(f"{len(written)} groups in {a.out}")
        if a.tree:
            nodes = sinks.TreeWriter(a.tree, " ".join(a.roots)).write(groups, final=True, **meta)
            print(f"{nodes} groups in {a.tree}")
        bad = (result.unreadable.count() if result.unreadable is not None else 0) + (result.errors.count() if result.errors is not None else 0) + (counts.first()["errors"] or 0)
        code = CANCELLED if result.cancelled else SOME_UNREADABLE if bad else OK
        found = groups.agg(F.count(F.lit(1)).alias("g"), F.sum("members").alias("m")).first()
        print(f"{found['g']} groups with {found['m'] or 0} members, {result.skipped_remote} remote items skipped")
        if status:
            status.finish("cancelled" if result.cancelled else "done", exit_code=code, groups=found["g"], members=found["m"] or 0, unreadable=bad)
        if bad:
            print(f"{bad} items couldn't be read", file=sys.stderr)
        return code
    except (registry.ExtractorUnavailable, ValueError) as e:
        print(e, file=sys.stderr)
        return BAD_OPTIONS
    except Exception:
        if stopped.is_set():
            if status:
                status.finish("cancelled", exit_code=CANCELLED)
            return CANCELLED
        raise
    finally:
        ended.set()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return BAD_OPTIONS if e.code else OK
    if a.command == "extractors":
        for name, cls in registry.extractors().items():
            print(f"{name} {cls.version}: {cls.problem() or 'available'}")
        return OK
    spark = spark or SparkSession.builder.appName("kindred").getOrCreate()
    if a.command == "scan":
        return _scan(a, spark)
    cache = Cache(spark, cache_path(a.cache))
    if a.action == "info":
        print(cache.stats())
    else:
        print("removed: %d files, %d features" % cache.gc(max_age_days=a.max_age_days, max_bytes=a.max_bytes if a.max_size_mb is None else int(a.max_size_mb * 1_000_000)))
    return OK
