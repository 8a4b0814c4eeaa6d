"""Where items come from: file trees, tables, Spark's file sources, playlists."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kindred.functions.columns import below_any
from kindred.operators.exact import first_of_each

LISTING = "root int, pos long, path string, norm_path string, size long, mtime_ns long, dev long, ino long, nlink long, kind string, error string"


@dataclass
class _Seen:
    links: set = field(default_factory=set)


class Root(InputPartition):
    def __init__(self, number: int, path: str):
        super().__init__(number)
        self.number, self.path = number, path


class ListingReader(DataSourceReader):
    """Lists each root in a task of its own: the files of a folder by name, then its folders."""

    def __init__(self, options: dict):
        self.roots = [r for r in options.get("roots", "").split("\n") if r]
        self.follow = options.get("follow_symlinks", "false").lower() == "true"

    def partitions(self):
        return [Root(i, r) for i, r in enumerate(self.roots)]

    def read(self, partition: Root):
        seen, n = _Seen(), 0
        for row in self._walk(os.path.abspath(partition.path), seen, top=True):
            yield (partition.number, n, *row)
            n += 1

    @staticmethod
    def _row(path: str, kind: str, st=None, error: str | None = None):
        norm = os.path.normcase(os.path.normpath(path))
        if st is None:
            return path, norm, None, None, 0, 0, 0, kind, error
        return path, norm, st.st_size, st.st_mtime_ns, st.st_dev, st.st_ino, st.st_nlink, kind, error

    def _walk(self, path: str, seen: _Seen, top: bool = False):
        try:
            if top and not os.path.isdir(path):
                yield self._row(path, "file", os.stat(path))
                return
            st = os.stat(path)
            if (st.st_dev, st.st_ino) in seen.links:
                yield self._row(path, "revisited")
                return
            if self.follow:
                seen.links.add((st.st_dev, st.st_ino))
            with os.scandir(path) as it:
                entries = sorted(it, key=lambda e: e.name)
        except OSError as e:
            yield self._row(path, "error", error=str(e))
            return
        folders = []
        for e in entries:
            try:
                link = e.is_symlink()
                if link and not self.follow:
                    yield self._row(e.path, "symlink")
                elif e.is_dir(follow_symlinks=self.follow):
                    folders.append(e.path)
                elif e.is_file(follow_symlinks=self.follow):
                    st = os.stat(e.path)
                    if link:
                        if (st.st_dev, st.st_ino) in seen.links:
                            yield self._row(e.path, "revisited")
                            continue
                        seen.links.add((st.st_dev, st.st_ino))
                    yield self._row(e.path, "file", st)
            except OSError as err:
                yield self._row(e.path, "error", error=str(err))
        for f in folders:
            yield from self._walk(f, seen)


class FileListing(DataSource):
    """spark.read.format("filelisting").option("roots", "a\\nb"): names, sizes, times and inodes; contents aren't read."""

    @classmethod
    def name(cls) -> str:
        return "filelisting"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema):
        return ListingReader(self.options)


def walk(spark: SparkSession, roots: list[str], *, follow_symlinks: bool = False, remote_roots: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Items below roots, and one row of counts.

    Paths under several roots come once, as do files with several hard
    links (the first name in walking order); unreadable entries are counted
    and the rest is listed.
    """
    spark.dataSource.register(FileListing)
    found = spark.read.format("filelisting").option("roots", "\n".join(roots)).option("follow_symlinks", str(follow_symlinks)).load()
    order = [F.col("root"), F.col("pos")]
    files = first_of_each(found.filter("kind = 'file'"), ["norm_path"], order)
    linked = files.filter("ino <> 0 AND nlink > 1")
    once = first_of_each(linked, ["dev", "ino"], order).unionByName(files.filter("NOT (ino <> 0 AND nlink > 1)"))
    items = once.select(
        F.col("path").alias("uri"), "size", "mtime_ns", F.lit(None).cast("string").alias("validator"), below_any(F.col("path"), list(remote_roots)).alias("is_remote"), F.lit(None).cast("string").alias("provided_hash"),
        F.col("path").alias("local_path"), "dev", "ino", "root", "pos",
    )
    counts = found.agg(
        F.countDistinct(F.expr("if(kind = 'file', norm_path, null)")).alias("paths"), F.sum(F.expr("if(kind = 'symlink', 1, 0)")).alias("symlinks_skipped"), F.sum(F.expr("if(kind = 'revisited', 1, 0)")).alias("links_revisited"),
        F.sum(F.expr("if(kind = 'error', 1, 0)")).alias("errors"), F.collect_list(F.expr("if(kind = 'error', path, null)")).alias("error_paths"),
    )
    return items, counts


def with_content(items: DataFrame) -> DataFrame:
    """items with the bytes at local_path, read in batches on the executors; null and error where that fails."""
    import pyarrow as pa

    schema = ", ".join(f"`{n}` {t}" for n, t in items.dtypes if n not in ("content", "error")) + ", content binary, error string"
    keep = [n for n, _ in items.dtypes if n not in ("content", "error")]

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):  # a file at a time: contents may be large
                row = b.slice(k, 1)
                data = error = None
                try:
                    with open(row.column(row.schema.get_field_index("local_path"))[0].as_py(), "rb") as f:
                        data = f.read()
                except (OSError, TypeError) as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([*(row.column(i) for i in range(len(keep))), pa.array([data], pa.binary()), pa.array([error], pa.string())], names=[*keep, "content", "error"])

    return items.select(*keep).mapInArrow(run, schema)


CHUNK = 1 << 20


def _hashed(path: str, size: int, ends: int | None) -> str:
    """SHA-256 of a file read in chunks, or with `ends` of its first and last bytes with a zero byte between."""
    import hashlib

    digest = hashlib.sha256()
    with open(path, "rb") as f:
        if ends is None:
            while chunk := f.read(CHUNK):
                digest.update(chunk)
        else:
            digest.update(f.read(ends) + b"\0")
            f.seek(size - ends)
            digest.update(f.read(ends))
    return digest.hexdigest()


def hash_files(files: DataFrame, *, ends: int | None = None) -> DataFrame:
    """uri, hash, error of rows (uri, size, local_path): files are read on the executors, only digests leave the task."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            out = []
            for size, path in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                try:
                    out.append((_hashed(path, size, ends), None))
                except (OSError, TypeError, ValueError) as e:
                    out.append((None, str(e)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[k] for x in out], pa.string()) for k in (0, 1))], names=["uri", "hash", "error"])

    return files.select("uri", "size", "local_path").mapInArrow(run, "uri string, hash string, error string")


def from_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Items of any store that Spark reads: paths, sizes, times in ms, contents."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    return files.select(
        F.col("path").alias("uri"), F.col("length").alias("size"), (F.unix_millis("modificationTime") * 1_000_000).alias("mtime_ns"), F.lit(None).cast("string").alias("validator"),
        (~F.startswith("path", F.lit("file:"))).alias("is_remote"), F.lit(None).cast("string").alias("provided_hash"), F.lit(None).cast("string").alias("local_path"), "content",
    )


def from_table(df: DataFrame, uri, content) -> DataFrame:
    """Any DataFrame as items: uri and content are columns of it."""
    return df.select(uri.cast("string").alias("uri"), content.cast("binary").alias("content")).withColumn("size", F.octet_length("content").cast("long")).withColumns({"mtime_ns": F.lit(0).cast("long"), "validator": F.lit(None).cast("string"), "is_remote": F.lit(False), "provided_hash": F.lit(None).cast("string")})


def read_playlists(spark: SparkSession, path: str) -> DataFrame:
    """playlist, uri, info of each entry of the playlists at path; info is the tag before it, null if none."""
    lines = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("playlist"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    from pyspark.sql import Window

    from kindred.sources.sinks import ITEM_TAG

    before = F.lag("line").over(Window.partitionBy("playlist").orderBy("pos"))
    entry = (F.col("line") != "") & ~F.startswith("line", F.lit("#"))
    info = F.when(F.startswith("before", F.lit(ITEM_TAG)), F.expr(f"substring(before, {len(ITEM_TAG) + 1})"))
    return lines.withColumn("before", before).filter(entry).select("playlist", "pos", F.col("line").alias("uri"), F.from_json(info, "role string, similarity double").alias("info"))
