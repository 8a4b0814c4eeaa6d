"""Exact duplicates by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 counts the cells that the digests fall into: a cell with one row is
no duplicate. The cells with more become a bitmap, a Bloom filter with one
hash function. Pass 2 looks every digest up in it: rows in a clear cell pass
straight through, only the others shuffle, as (doc_id, digest). There are
CELLS_A_ROW cells a row, so that one row in that many shuffles in vain; a
false positive costs a shuffled row of a hundred bytes, never a wrong
result. What is broadcast is bounded: at most MAX_CELLS / 8 bytes = 64 MB.
Beyond MAX_CELLS / CELLS_A_ROW rows more of them shuffle in vain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import SPACE_CLASS, cut

CELLS_A_ROW, MAX_CELLS = 16, 1 << 29
BLOCK = 32_768  # bits of one bitmap, as bitmap_construct_agg has it


def digest(text: Column) -> Column:
    """SHA-256 of a text with each run of white space replaced by one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE_CLASS, " ").cast("binary"), 256)


def digests(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("text_sha256"))


def _cell(cells: int) -> Column:
    return F.pmod(F.xxhash64("text_sha256"), F.lit(cells))


def repeated_cells(slim: DataFrame) -> tuple[DataFrame, int]:
    """The bitmap of cells that several rows of slim fall into, in blocks (block_, bits_), made once; and how many cells there are."""
    cells = BLOCK
    most = min(MAX_CELLS, CELLS_A_ROW * slim.count())
    while cells < most:
        cells *= 2
    many = slim.select(_cell(cells).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    bits = many.select((F.col("cell") / BLOCK).cast("long").alias("block_"), F.pmod("cell", F.lit(BLOCK)).alias("bit"))
    return cut(bits.groupBy("block_").agg(F.expr("bitmap_construct_agg(bit)").alias("bits_"))), cells


def probe(rows: DataFrame, bitmap: DataFrame, cells: int) -> DataFrame:
    """rows with again: whether their text_sha256 falls into a cell of the bitmap."""
    rows = rows.withColumn("cell_", _cell(cells)).withColumn("block_", (F.col("cell_") / BLOCK).cast("long"))
    # at most MAX_CELLS / BLOCK = 16384 rows of 4 KB
    rows = rows.join(F.broadcast(bitmap), "block_", "left").withColumn("bit_", F.pmod("cell_", F.lit(BLOCK)).cast("int"))
    rows = rows.withColumn("byte_", F.conv(F.hex(F.substring(F.col("bits_"), F.expr("bit_ div 8 + 1").cast("int"), F.lit(1))), 16, 10).cast("int"))
    hit = F.expr("shiftright(byte_, bit_ % 8) & 1") == 1
    return rows.withColumn("again", F.coalesce(hit, F.lit(False))).drop("cell_", "block_", "bits_", "bit_", "byte_")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each document.

    Of equal texts the smallest doc_id stays. Null and empty texts are equal,
    and so form one group. A row with the doc_id and text of another is the
    same document: it counts in group_size and comes back once. Null ids sort
    last and stay only if their group has no other. An empty table gives an
    empty result; other columns aren't read.
    """
    rows = cut(digests(docs))
    probed = cut(probe(rows, *repeated_cells(rows)))
    alone = probed.filter(~F.col("again")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    # pre-aggregated on the map side; the join back is to unique digests, so a hot one can be split
    each = probed.filter("again").groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    groups = probed.filter("again").groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    back = each.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")
    return alone.unionByName(back)


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs, with its own columns, without the rows that exact_dedup doesn't keep; only rows that may have copies shuffle."""
    slim = cut(digests(docs))
    # the columns of docs travel as one value, so that none clashes
    rows = docs.select(F.struct(*docs.columns).alias("row_"), F.col("doc_id").cast("long").alias("id_"), digest(F.col("text")).alias("text_sha256"))
    bitmap, cells = repeated_cells(slim)
    rows = probe(rows, bitmap, cells)
    groups = probe(slim, bitmap, cells).filter("again").groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"))
    kept = rows.filter("again").join(groups, "text_sha256").filter("id_ <=> keep_id").dropDuplicates(["text_sha256", "id_"])
    return rows.filter(~F.col("again")).select("row_.*").unionByName(kept.select("row_.*"))
