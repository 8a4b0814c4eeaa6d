"""Best-fit packing of documents into sequences under several capacities.

What decides where a piece goes is its length alone: tokens, one document,
and attention cost (length squared). So pieces of one length can stand for
each other, and the plan needs only how many there are of each length: at
most `tokens` numbers, however large the input. `plan` places lengths in
falling order, vector best fit: of the kinds of bins that still have room
in every capacity, the one with the best score takes the piece, and bins
that hold the same lengths are placed as one kind, by count. The plan is a
table of ranges (length, rank from, rank to -> first sequence, per
sequence, offset). Pieces get their rank within their length from counts of
buckets of bounded size, so no length is ever gathered in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import cut

TOKENS = 2048
BUCKET_ROWS = 20_000
SEPARATOR = 0
RESIDUAL, DOT = "residual", "dot"


def plan(counts: dict[int, int], *, tokens: int = TOKENS, documents: int | None = None, attention: int | None = None, weights=(1.0, 1.0, 1.0), score: str = RESIDUAL) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, how many, first sequence, per sequence, offset) that place every piece.

    Capacities of a sequence: tokens, documents, attention (sum of squared
    lengths); None means as large as tokens allow. score: `residual` takes
    the bin with the least weighted norm of what is left after placing,
    `dot` the one with the greatest weighted product of what is left and what
    is placed. Ties go to the older kind of bin. A length over any capacity
    is an error.
    """
    documents = tokens if documents is None else documents
    attention = tokens * tokens if attention is None else attention
    cap = np.array([tokens, documents, attention], dtype=float)
    wt = np.array(weights, dtype=float)
    out: list[tuple[int, int, int, int, int, int]] = []
    # kinds of open bins: rows of left (tokens, documents, attention), first bin, bins
    left = np.zeros((0, 3))
    first, size = np.zeros(0, np.int64), np.zeros(0, np.int64)
    bins = 0
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        need = np.array([length, 1, length * length], dtype=float)
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        rest, rank = counts[length], 0
        while rest:
            room = np.flatnonzero((left >= need).all(1))
            if len(room):
                now = left[room]
                goodness = -(wt * ((now - need) / cap) ** 2).sum(1) if score == RESIDUAL else (wt * (now / cap) * (need / cap)).sum(1)
                k = int(room[goodness.argmax()])
                have, at, n = left[k], int(first[k]), int(size[k])
            else:
                k, have, at, n = -1, cap, bins, rest
            # by residual, a bin that takes one stays the best for the next, and a new one is opened only where no other has
            # room: both are filled; by dot product, what is left of a bin falls, and another may be the best for the next
            per = int((have // need).min()) if score == RESIDUAL or k < 0 else 1
            if k < 0:
                n = -(-rest // per)
                bins += n
            take = min(rest, n * per)
            full, over = divmod(take, per)
            offset = int(tokens - have[0])
            if full:
                out.append((length, rank, full * per, at, per, offset))
            if over:
                out.append((length, rank + full * per, over, at + full, over, offset))
            new = [(have - per * need, at, full)] if full else []
            if over:
                new.append((have - over * need, at + full, 1))
            if n > full + bool(over):
                new.append((have, at + full + bool(over), n - full - bool(over)))
            keep = np.arange(len(size)) != k
            left = np.concatenate([left[keep], *[x[0][None] for x in new]])
            first = np.concatenate([first[keep], [x[1] for x in new]]).astype(np.int64)
            size = np.concatenate([size[keep], [x[2] for x in new]]).astype(np.int64)
            rest -= take
            rank += take
        # a kind without room for a single token or document can take nothing more
        alive = (left[:, 0] >= 1) & (left[:, 1] >= 1) & (left[:, 2] >= 1)
        left, first, size = left[alive], first[alive], size[alive]
    return out


def token_counts(docs: DataFrame, vocab: str, *, tokens: int = TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces of each document's ids followed by SEPARATOR: doc_id, copy, piece, start, length, ids_crc32 (and ids).

    vocab: path of a tokenizers .json, the same on all machines. The ids are
    those of the tokenizers library with add_special_tokens=False: none is
    added, but where a text has the string of an added token, that is one id.
    Only documents of more than `tokens` ids are cut; of these, the first
    piece takes what is over. Null and empty texts have the separator alone.
    Every row is a document of its own, repeated rows too; other columns
    aren't read. An empty table gives an empty result.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    if with_ids:
        fields.append(("ids", pa.list_(pa.int64())))
        schema += ", ids array<long>"
    out = pa.schema(fields)

    def run(batches):
        from kindred.llm.chunks import tokenizer

        ids_of = tokenizer(vocab)
        for b in batches:
            rows = []
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                for doc_id, ids in zip(part.column(0).to_pylist(), ids_of([x or "" for x in part.column(1).to_pylist()])):
                    ids += np.uint32(SEPARATOR).tobytes()
                    n = len(ids) // 4
                    begin, piece = 0, 0
                    end = n % tokens or min(n, tokens)
                    while begin < n:
                        raw = ids[4 * begin : 4 * end]
                        rows.append((doc_id, piece, begin, end - begin, zlib.crc32(raw)) + ((np.frombuffer(raw, "<u4").astype("i8"),) if with_ids else ()))
                        begin, end, piece = end, end + tokens, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)] if rows else [pa.array([], f.type) for f in out], schema=out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pack(pieces: DataFrame, *, tokens: int = TOKENS, documents: int | None = None, attention: int | None = None, weights=(1.0, 1.0, 1.0), score: str = RESIDUAL) -> DataFrame:
    """pieces with sequence_id and offset. pieces: doc_id, piece, start, length (1 to tokens), any more columns.

    Every row gets a place of its own, repeated rows too. Ties in the order
    of rows of one length are broken by doc_id and piece, then at will. An
    empty table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = cut(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `tokens` rows
    rows = plan(counts, tokens=tokens, documents=documents, attention=attention, weights=weights, score=score)
    spans = spark.createDataFrame([(n, r, r + c, s, p, o) for n, r, c, s, p, o in rows], "length long, rank_from long, rank_to long, seq long, per long, at long")
    # buckets of a length hold some BUCKET_ROWS rows; their counts, added up in order, give each bucket's first rank
    buckets = spark.createDataFrame([(n, max(1, c // BUCKET_ROWS)) for n, c in counts.items()], "length long, buckets long")
    dealt = pieces.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", F.monotonically_increasing_id()), F.col("buckets"))).drop("buckets")
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("place", F.row_number().over(inside) - 1).join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("place"))
    # the plan as one row a length: its ranges in an array, searched by the rank
    by_length = spans.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("rank_from", "rank_to", "seq", "per", "at"))).alias("spans"))
    found = ranked.join(F.broadcast(by_length), "length").withColumn("span", F.filter("spans", lambda s: (s["rank_from"] <= F.col("rank")) & (F.col("rank") < s["rank_to"]))[0])
    k = F.col("rank") - F.col("span.rank_from")
    return found.withColumns({"sequence_id": F.col("span.seq") + F.expr("(rank - span.rank_from) div span.per"), "offset": F.col("span.at") + F.pmod(k, F.col("span.per")) * F.col("length")}).select(*pieces.columns, "sequence_id", "offset")
