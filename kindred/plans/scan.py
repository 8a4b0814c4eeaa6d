"""Finding identical and similar items, in discovery and in reference mode."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import images
from kindred.functions.columns import SAMPLE_BYTES, extension, hamming
from kindred.operators import cache as caches
from kindred.operators import exact, star
from kindred.operators.hamming import in_blocks, radius
from kindred.plans.registry import ExtractionFailed, Extractor, get_extractor, register
from kindred.sources import items as files


class Cancelled(Exception):
    """A scan was told to stop."""


@dataclass
class Watch:
    """What goes on in a scan: progress(phase, done, total) at each phase; cancelled() is asked there, on_group(group) told
    of each group of the result (anchor, [(uri, similarity), ...]), on_snapshot(groups, done, total) of provisional ones."""

    progress: Callable[[str, int, int], None] | None = None
    cancelled: Callable[[], bool] | None = None
    on_group: Callable[[str, list[tuple[str, float]]], None] | None = None
    on_snapshot: Callable[[DataFrame, int, int], None] | None = None

    def step(self, phase: str, done: int = 0, total: int = 0) -> None:
        if self.cancelled is not None and self.cancelled():
            raise Cancelled
        if self.progress is not None:
            self.progress(phase, done, total)

    def tell(self, groups: DataFrame) -> DataFrame:
        if self.on_group is None:
            return groups
        groups = star.cut(groups)
        members = F.array_sort(F.collect_list(F.when(F.col("role") == "member", F.struct((-F.col("similarity")).alias("far"), "uri"))))
        for g in groups.groupBy("rank", "anchor").agg(members.alias("m")).orderBy(F.desc("rank"), "anchor").toLocalIterator():
            self.on_group(g["anchor"], [(m["uri"], -m["far"]) for m in g["m"]])
        return groups


@dataclass
class ScanResult:
    """groups: rank, anchor, uri, role, similarity. The other DataFrames hold uris. A cancelled scan has the groups known by then."""

    groups: DataFrame
    unreadable: DataFrame | None = None
    errors: DataFrame | None = None
    skipped_remote: int = 0
    cancelled: bool = False


@dataclass
class FeatureSet:
    """Features that can be grouped again at any threshold. role: item or reference."""

    extractor: Extractor
    features: DataFrame
    result: ScanResult | None = None


GROUPS = "rank long, anchor string, uri string, role string, similarity double"


def star_rows(g: DataFrame) -> DataFrame:
    """rank, anchor, member, similarity as rank, anchor, uri, role, similarity, with a row for each anchor."""
    members = g.select("rank", "anchor", F.col("member").alias("uri"), F.lit("member").alias("role"), "similarity")
    heads = g.select("rank", "anchor").distinct().select("rank", "anchor", F.col("anchor").alias("uri"), F.lit("anchor").alias("role"), F.lit(1.0).alias("similarity"))
    return heads.unionByName(members)


def in_order(references: DataFrame) -> DataFrame:
    """uri, rank: references in the order given, the first with the greatest rank."""
    pos = F.monotonically_increasing_id()
    return references.select("uri", pos.alias("pos")).groupBy("uri").agg((-F.min("pos")).alias("rank"))


def file_keys(items: DataFrame, watch: Watch, cache: caches.Cache | None) -> tuple[DataFrame, DataFrame]:
    """uri, size, mtime_ns, key, ref of listed files, and those that can't be read (uri, error).

    Nothing is read of files whose size is theirs alone (or, with references,
    no reference has), whose digest is in the cache or came with them, or
    whose beginning and end, for large ones, no other of their size has.
    """
    rows = star.cut(items)
    known = F.lit(None).cast("string") if "provided_hash" not in items.columns else F.when(F.lower("provided_hash").startswith("sha256:"), F.col("provided_hash"))
    rows = rows.withColumn("known", known)
    if cache is not None:
        found = caches.lookup(rows, cache.table("files").withColumnRenamed("content_hash", "data"))
        rows = found.withColumn("known", F.coalesce("data", "known")).drop("data", "state")
    both = F.max("ref").cast("int") - F.min("ref").cast("int")
    sizes = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ref").cast("int")).alias("refs"), both.alias("mixed"))
    wanted = sizes.filter("n > 1 AND (refs = 0 OR mixed = 1)").select("size")
    rows = star.cut(rows.join(wanted, "size"))
    todo = rows.filter("known IS NULL")
    watch.step("sample")
    large = todo.filter(F.col("size") > 2 * SAMPLE_BYTES)
    samples = star.cut(files.hash_files(large, ends=SAMPLE_BYTES)) if not large.isEmpty() else todo.select("uri", F.lit(None).cast("string").alias("hash"), F.lit(None).cast("string").alias("error")).limit(0)
    plan = exact.sampled_plan(rows.join(samples.select("uri", "hash"), "uri", "left").select("uri", "size", F.col("hash").alias("sample")))
    todo = todo.join(samples.filter("error IS NOT NULL").select("uri"), "uri", "left_anti").join(plan.filter("to_hash").select("uri"), "uri", "left_semi")
    watch.step("hash")
    fresh = star.cut(files.hash_files(todo))
    keys = rows.join(fresh.select("uri", F.concat(F.lit("sha256:"), "hash").alias("fresh")), "uri", "left")
    keys = star.cut(keys.select("uri", "size", "mtime_ns", "validator", F.coalesce("known", "fresh").alias("key"), "ref", F.col("known").isNotNull().alias("hit")))
    if cache is not None:
        new = keys.filter("NOT hit AND key IS NOT NULL").select("uri", "size", "mtime_ns", "validator", F.col("key").alias("content_hash"), F.unix_timestamp(F.current_timestamp()).alias("last_seen"))
        cache.put("files", new.dropDuplicates(["uri"]), seen=keys.filter("hit").select("uri"))
    broken = samples.unionByName(fresh).filter("error IS NOT NULL").select("uri", "error")
    return keys.select("uri", "size", "mtime_ns", "key", "ref"), broken


def find_identical(items: DataFrame, *, references: DataFrame | None = None, min_size: int = 1, cache: caches.Cache | None = None, watch: Watch | None = None) -> ScanResult:
    """Groups of equal items, those that free most first; or the items equal to each reference, in the references' order.

    Items have their bytes in `content`, or only a `local_path`: then as few
    files as can be are read, see file_keys, and with a cache none that is
    unchanged. Items that can't be read are reported and take no part.
    """
    watch = watch or Watch()
    spark = items.sparkSession
    try:
        watch.step("list")
        if "content" not in items.columns and "local_path" in items.columns:
            own = items.filter(F.col("size") >= min_size).dropDuplicates(["uri"])
            if references is None:
                keys, broken = file_keys(own.withColumn("ref", F.lit(False)), watch, cache)
            else:
                refs = references.filter(F.col("size") >= min_size).dropDuplicates(["uri"])
                keys, broken = file_keys(exact.not_references(own, refs).withColumn("ref", F.lit(False)).unionByName(refs.withColumn("ref", F.lit(True)), allowMissingColumns=True), watch, cache)
            watch.step("group")
            if references is None:
                g = exact.groups_of(keys.drop("ref")).withColumn("rank", F.col("reclaimable"))
                return ScanResult(watch.tell(g.select("rank", "anchor", "uri", "role", "similarity")), unreadable=broken)
            heads = keys.filter("ref AND key IS NOT NULL").select(F.col("uri").alias("anchor"), "size", "key")
            g = keys.filter("NOT ref").join(heads, ["size", "key"]).select("anchor", F.col("uri").alias("member"), F.lit(1.0).alias("similarity"))
        else:
            broken = items.filter("content IS NULL AND provided_hash IS NULL").select("uri") if {"content", "provided_hash"} <= set(items.columns) else None
            good = items if broken is None else items.filter("content IS NOT NULL OR provided_hash IS NOT NULL")
            if references is None:
                rows = good
                if cache is not None:
                    rows = caches.lookup(good, cache.table("files").withColumnRenamed("content_hash", "data"))
                    rows = rows.withColumn("provided_hash", F.coalesce("data", "provided_hash", F.concat(F.lit("sha256:"), F.sha2("content", 256))))
                    slim = star.cut(rows.select("uri", "size", "mtime_ns", "validator", "provided_hash", "state"))  # no contents
                    seen = slim.filter("state = 'hit'").select("uri")
                    new = slim.filter("state <> 'hit'").select("uri", "size", "mtime_ns", "validator", F.col("provided_hash").alias("content_hash"), F.unix_timestamp(F.current_timestamp()).alias("last_seen"))
                    cache.put("files", new.dropDuplicates(["uri"]), seen=seen)
                    rows = slim.select("uri", "size", "mtime_ns", "provided_hash", F.lit(None).cast("binary").alias("content"))
                watch.step("group")
                g = exact.exact_groups(rows, min_size=min_size).withColumn("rank", F.col("reclaimable"))
                return ScanResult(watch.tell(g.select("rank", "anchor", "uri", "role", "similarity")), unreadable=broken)
            watch.step("group")
            g = exact.exact_references(good, references, min_size=min_size).select("anchor", F.col("uri").alias("member"), "similarity")
        g = g.join(in_order(references).withColumnRenamed("uri", "anchor"), "anchor")
        return ScanResult(watch.tell(star_rows(g)), unreadable=broken)
    except Cancelled:
        return ScanResult(spark.createDataFrame([], GROUPS), cancelled=True)


def extract_features(items: DataFrame, extractor: str = "image", *, references: DataFrame | None = None, params: dict | None = None, cache: caches.Cache | None = None, include_remote: bool = False, min_size: int = 0, watch: Watch | None = None, batches: int = 4) -> FeatureSet:
    """A feature for each item the extractor handles; unchanged items are taken from the cache, and only others are read.

    With watch.on_snapshot or watch.cancelled, items are extracted in
    `batches` turns; after each, what there is goes into the cache, is
    grouped for on_snapshot, and stays if the scan is cancelled.
    """
    watch = watch or Watch()
    ex = get_extractor(extractor, **(params or {}))
    own = items.filter(F.col("size") >= min_size)
    skipped = 0
    if ex.extensions:
        own = own.filter(extension(F.col("uri")).isin(*ex.extensions))
    if not include_remote and "is_remote" in own.columns:
        skipped = own.filter("is_remote").count()
        own = own.filter("NOT coalesce(is_remote, false)")
    own = exact.first_of_each(own, ["uri"], [F.col("uri")]).withColumns({"role": F.lit("item"), "ref_rank": F.lit(None).cast("long")})
    if references is not None:
        refs = references.join(in_order(references).withColumnRenamed("rank", "ref_rank"), "uri").dropDuplicates(["uri"])
        if ex.extensions:
            handled = extension(F.col("uri")).isin(*ex.extensions)
            for r in refs.filter(~handled).select("uri").limit(20).collect():
                warnings.warn(f"{ex.name} doesn't handle the reference {r['uri']}", stacklevel=2)
            refs = refs.filter(handled)
        own = exact.not_references(own, refs).unionByName(refs.withColumn("role", F.lit("reference")), allowMissingColumns=True)
    todo, features = own, None
    key = {"extractor": F.lit(ex.name), "extractor_version": F.lit(ex.version), "params_digest": F.lit(ex.digest)}
    slim = ("uri", "size", "mtime_ns", "validator", "role", "ref_rank")
    if cache is not None:
        known = cache.table("features").filter((F.col("extractor") == ex.name) & (F.col("extractor_version") == ex.version) & (F.col("params_digest") == ex.digest))
        looked = caches.lookup(own, known)
        features = star.cut(looked.filter("state <> 'miss'").select(*slim, "data", F.lit("cached").alias("status"), F.lit(None).cast("string").alias("message")))
        todo = looked.filter("state = 'miss'").drop("data", "state")
    turns = batches if watch.on_snapshot is not None or watch.cancelled is not None else 1
    cancelled = False
    for turn in range(turns):
        try:
            watch.step("extract", turn, turns)
        except Cancelled:
            cancelled = True
            break
        part = todo if turns == 1 else todo.filter(F.pmod(F.xxhash64("uri"), F.lit(turns)) == turn)
        if not ex.needs_path and "content" not in part.columns:
            part = files.with_content(part)
        fresh = star.cut(_extract(ex, part))
        if cache is not None:
            now = F.unix_timestamp(F.current_timestamp())
            new = fresh.filter("status <> 'failed'").dropDuplicates(["uri"]).select("uri", "size", "mtime_ns", "validator", *(v.alias(k) for k, v in key.items()), "data", now.alias("last_seen"))
            cache.put("features", new, seen=None if turn or features is None else features.select("uri", *(v.alias(k) for k, v in key.items())))
        features = fresh if features is None else features.unionByName(fresh)
        if watch.on_snapshot is not None and turn < turns - 1:
            watch.on_snapshot(group_features(FeatureSet(ex, features.filter("data IS NOT NULL"))), turn + 1, turns)
    if features is None:
        features = star.cut(_extract(ex, todo.limit(0) if ex.needs_path or "content" in todo.columns else files.with_content(todo.limit(0))))
    unreadable = features.filter("data IS NULL AND status <> 'failed'").select("uri")
    return FeatureSet(ex, features.filter("data IS NOT NULL"), ScanResult(features, unreadable, features.filter("status = 'failed'").select("uri", "message"), skipped, cancelled))


def _extract(ex: Extractor, items: DataFrame) -> DataFrame:
    """status: done, unreadable (for good) or failed (this time)."""
    cols = items.select("uri", "size", "mtime_ns", "validator" if "validator" in items.columns else F.lit(None).cast("string").alias("validator"), "role", "ref_rank", "local_path" if ex.needs_path else "content")

    def run(batches):
        for b in batches:
            data, status, message = [], [], []
            for x in b.column(6):
                d = m = None
                try:
                    d, s = ex.extract(x.as_py()), "done"
                except ExtractionFailed as e:
                    s, m = "failed" if e.transient else "unreadable", str(e)
                except Exception as e:  # noqa: BLE001  an extractor's own failure is that item's
                    s, m = "failed", f"{type(e).__name__}: {e}"
                data.append(d), status.append(s), message.append(m)
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(data, pa.binary()), pa.array(status, pa.string()), pa.array(message, pa.string())], names=["uri", "size", "mtime_ns", "validator", "role", "ref_rank", "data", "status", "message"])

    return cols.mapInArrow(run, "uri string, size long, mtime_ns long, validator string, role string, ref_rank long, data binary, status string, message string")


def all_pairs(ex: Extractor, queries: DataFrame, features: DataFrame, threshold: float) -> DataFrame:
    """Edges by the extractor's own similarity, for extractors without an index: blocks of queries meet blocks of features."""
    n = max(1, -(-features.count() // 1024))
    m = max(1, -(-queries.count() // 1024))
    a = queries.select(F.col("uri").alias("a"), F.col("data").alias("da")).withColumn("ka", F.pmod(F.xxhash64("a"), F.lit(m))).withColumn("kb", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")))
    b = features.select(F.col("uri").alias("b"), F.col("data").alias("db")).withColumn("kb", F.pmod(F.xxhash64("b"), F.lit(n))).withColumn("ka", F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>")))

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        names, prepared = y["b"].to_pylist(), ex.prepare(y["db"].to_pylist())
        out = [(p, q, s) for p, dp in zip(x["a"].to_pylist(), x["da"].to_pylist()) for q, s in zip(names, ex.similarities(dp, prepared)) if p != q and s >= threshold]
        return pa.table({"a": pa.array([r[0] for r in out], pa.string()), "b": pa.array([r[1] for r in out], pa.string()), "similarity": pa.array([float(r[2]) for r in out], pa.float64())})

    return a.groupBy("ka", "kb").cogroup(b.groupBy("ka", "kb")).applyInArrow(meet, "a string, b string, similarity double")


def group_features(fs: FeatureSet, threshold: float | None = None) -> DataFrame:
    """Star groups at a threshold: rank, anchor, uri, role, similarity. Extraction isn't repeated."""
    t = fs.extractor.default_threshold if threshold is None else threshold
    if not 0 <= t <= 1:
        raise ValueError("a threshold is between 0 and 1")
    items = fs.features.filter("role = 'item'")
    refs = fs.features.filter("role = 'reference'")
    reference_mode = not refs.isEmpty()
    queries = refs if reference_mode else items
    edges = fs.extractor.edges(items, queries, t)
    if edges is None:
        edges = all_pairs(fs.extractor, queries, items, t)
    elif t <= 0:  # an index leaves out what it has no reason to compare: the similarity of that is 0
        pairs = in_blocks(queries.select(F.col("uri").alias("a")), items.select(F.col("uri").alias("b"))).filter("a <> b")
        edges = pairs.join(edges, ["a", "b"], "left").select("a", "b", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
    if reference_mode:
        g = star.reference_groups(edges).join(refs.select(F.col("uri").alias("anchor"), F.col("ref_rank").alias("rank")), "anchor")
    else:
        g = star.star_groups(items.select(F.col("uri").alias("id"), "size"), edges).withColumn("rank", -F.col("rank"))
    return star_rows(g.select("rank", "anchor", "member", "similarity"))


def find_similar(items: DataFrame, extractor: str = "image", *, threshold: float | None = None, watch: Watch | None = None, **options) -> ScanResult:
    """Star groups of similar items. A cancelled scan has the groups of what was extracted by then."""
    watch = watch or Watch()
    fs = extract_features(items, extractor, watch=watch, **options)
    r = fs.result
    if watch.progress is not None:
        watch.progress("group", 0, 0)
    return ScanResult(watch.tell(group_features(fs, threshold)), r.unreadable, r.errors, r.skipped_remote, r.cancelled)


@register
class Image(Extractor):
    """Perceptual hashes of pictures that Spark's image source decodes."""

    name, version = "image", 1
    extensions = frozenset({".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tif", ".tiff"})
    default_params = {"algorithm": "phash", "hash_size": 8}
    default_threshold = 0.8
    modules = ("PIL",)

    def validate(self, params: dict) -> None:
        if params["algorithm"] not in images.ALGORITHMS:
            raise ValueError(f"algorithm is one of {', '.join(images.ALGORITHMS)}")
        n = params["hash_size"]
        if n < 2 or params["algorithm"] == "whash" and n & (n - 1):
            raise ValueError("hash_size is at least 2, and a power of two for whash")

    def extract(self, data: bytes) -> bytes:
        import io

        import numpy as np
        from PIL import Image as Pil
        from PIL import ImageOps

        try:
            with Pil.open(io.BytesIO(data)) as im:
                px = np.asarray(ImageOps.exif_transpose(im).convert("L"), dtype=float)
        except (OSError, ValueError, SyntaxError) as e:
            raise ExtractionFailed(str(e)) from e
        return images.pack(images.ALGORITHMS[self.params["algorithm"]](px, self.params["hash_size"]))

    def edges(self, features: DataFrame, queries: DataFrame, threshold: float) -> DataFrame | None:
        return binary_edges(features, queries, threshold)


def binary_edges(features: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """Edges of equally long bit strings (data binary) by Hamming similarity.

    Within distance r one of r + 1 pieces of the bytes is equal, so pieces
    join by equality; with more pieces than bytes, all pairs in blocks are
    left (see hamming.pairs for 64 bits).
    """
    sizes = features.agg(F.max(F.octet_length("data"))).first()[0] or 1
    r = radius(threshold, 8 * sizes)
    n = min(r + 1, sizes) if r < sizes else 0
    word = lambda c: F.transform(F.sequence(F.lit(1), F.lit(sizes)), lambda i: F.conv(F.hex(F.substring(c, i, F.lit(1))), 16, 10).cast("long"))
    a, b = queries.select(F.col("uri").alias("a"), F.col("data").alias("da")), features.select(F.col("uri").alias("b"), F.col("data").alias("db"))
    if n:
        edges = [sizes * k // n for k in range(n + 1)]
        keys = lambda c: F.array(*(F.substring(c, edges[k] + 1, edges[k + 1] - edges[k]) for k in range(n)))
        met = a.select("a", "da", F.posexplode(keys(F.col("da"))).alias("k", "key")).join(b.select("b", "db", F.posexplode(keys(F.col("db"))).alias("k", "key")), ["k", "key"]).select("a", "da", "b", "db").distinct()
    else:
        met = in_blocks(a, b)
    d = hamming(word(F.col("da")), word(F.col("db")))
    out = met.filter("a <> b").select("a", "b", F.greatest(F.lit(0.0), 1 - 2 * d / F.lit(8.0 * sizes)).alias("similarity"))
    return out.filter(F.col("similarity") >= threshold)


def decoded_images(images_df: DataFrame, algorithm: str = "phash", hash_size: int = 8) -> DataFrame:
    """uri, data of rows of spark.read.format("image"): hashes without Pillow. Undecodable pictures have width -1 and no data."""
    import numpy as np

    def run(batches):
        for b in batches:
            out = []
            for h, w, c, d in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
                px = np.frombuffer(d, np.uint8).reshape(h, w, c) if h and h > 0 else None
                out.append(None if px is None else images.pack(images.ALGORITHMS[algorithm](images.grey(px), hash_size)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["uri", "data"])

    flat = images_df.select(F.col("image.origin").alias("uri"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("c"), F.col("image.data").alias("d"))
    return flat.mapInArrow(run, "uri string, data binary")

