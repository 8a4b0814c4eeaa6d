"""Encoding and decoding whole texts with a byte-level BPE vocabulary."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECODE_BLOCK = 65_536


def encode_decode(docs: DataFrame, vocab: str, *, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Encode every whole text by the transducer, decode the ids again.

    docs: doc_id, text, any other columns (not read). Null text counts as
    empty: no ids, the digest of nothing. Repeated rows come back as often as
    they came. Result: doc_id, n_tokens, ids_sha256, decoded_sha256, and with
    with_ids the ids, with with_text the text that the streaming decoder made.
    vocab: path of a rank file, the same on all machines.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields.append(("ids", pa.list_(pa.int64())))
        schema += ", ids array<long>"
    if with_text:
        fields.append(("decoded", pa.string()))
        schema += ", decoded string"
    out = pa.schema(fields)

    def run(batches):
        import numpy as np

        from kindred.llm.bpe import Decoder, Utf8, encoder

        enc = encoder(vocab)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode(text.as_py() or "")
                digest, decoder, utf8, parts = hashlib.sha256(), Decoder(enc), Utf8(), []
                for at in range(0, len(ids), 4 * DECODE_BLOCK):
                    raw = decoder.feed(ids[at : at + 4 * DECODE_BLOCK])
                    digest.update(raw)
                    if with_text:
                        parts.append(utf8.feed(raw))
                if not decoder.finish():
                    raise ValueError(f"the ids of document {doc_id} don't decode to text")
                row = [doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), digest.hexdigest()]
                if with_ids:
                    row.append(np.frombuffer(ids, "<u4").astype("i8"))
                if with_text:
                    row.append("".join(parts) + utf8.finish())
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)] if rows else [pa.array([], f.type) for f in out], schema=out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
