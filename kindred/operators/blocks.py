"""Pairs of blocks of rows: each block is a compressed Arrow table, kept once in the shared checkpoint folder, and a task reads the two that it compares.

No row is sent once for each partner, and results leave a task as they are found.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators.star import cut

SIDE = 32  # at most SIDE x SIDE tasks


def give_back() -> None:
    """Free memory goes back to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def long64(h: Column) -> Column:
    """Four 16-bit numbers from the low end as the bits of one long."""
    part = lambda k: F.shiftleft(F.get(h, F.lit(k)), 16 * k)
    return part(0).bitwiseOR(part(1)).bitwiseOR(part(2)).bitwiseOR(part(3))


def blocks(rows: DataFrame, key: str, size: int, describe: Callable[[pa.Table], pa.Table] = lambda t: t, total: int | None = None, side: int = SIDE) -> DataFrame:
    """block, data: rows in blocks of about `size`, those of one key in the same; describe may change a block's table. total: how many rows there are, if known; with side more than SIDE, tasks are more and smaller."""
    n = max(1, -(-(rows.count() if total is None else total) // size))

    def pack(t: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        held = describe(t.drop_columns(["block"])).combine_chunks()
        with pa.ipc.new_stream(sink, held.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(held)
        return pa.table({"block": t.column("block").slice(0, 1), "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64(key), F.lit(n)))
    return cut(dealt.groupBy("block").applyInArrow(pack, "block long, data binary")).coalesce(min(n, side))


def meet(a: DataFrame, b: DataFrame, same: bool, run: Callable, schema: str) -> DataFrame:
    """What run makes of the pairs of blocks that a task has, with same of unordered pairs. run takes what `tables` takes."""
    x, y = a.toDF("block_a", "data_a"), b.toDF("block_b", "data_b")
    met = x.join(y.hint("shuffle_replicate_nl"), F.expr("block_a <= block_b" if same else "block_a >= 0 AND block_b >= 0"))
    return met.select("block_a", "data_a", "block_b", "data_b").mapInArrow(run, schema)


def tables(batches) -> Iterator[tuple[int, pa.Table, int, pa.Table]]:
    """Block of a and its table, block of b and its table; those of one block of a come together."""
    known, s = None, None
    for batch in batches:
        for k in range(batch.num_rows):
            p, x, q, y = (c[k] for c in batch.columns)
            if known != p.as_py():
                known, s = p.as_py(), pa.ipc.open_stream(x.as_buffer()).read_all().combine_chunks()
            yield known, s, q.as_py(), pa.ipc.open_stream(y.as_buffer()).read_all().combine_chunks()
