"""Star groups of sequences: all that line up with one another, whatever values they share and however many share them.

The rules are those of `sequence.similarities` without its stop-list. Equal
sequences are one class: they have the same neighbours, so a class is
compared once and its members are added to the groups at the end. Classes
are compared block by block (`blocks.py`): votes for offsets are counted,
and the offsets with most of them compared item by item, where two blocks
meet; no vote becomes a row.

A pair can only be as similar as its overlap is long. Votes for offsets that
overlap too little to reach the threshold, and those that fail it when
their items are compared, make no pair a candidate; of a candidate all votes
count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.columns import SCRAMBLE
from kindred.operators.blocks import blocks, give_back, meet, tables
from kindred.operators.sequence import CANDIDATES, MAX_REPEATS, MIN_VOTES
from kindred.operators.star import cut, release, star_groups

BLOCK, LEAST_BLOCK, PARTS, SIDE = 4096, 256, 8, 64  # sequences of a block, at most and at least; blocks of few sequences; at most SIDE x SIDE tasks
AT_ONCE, CELLS = 1 << 18, 1 << 23  # votes, and items compared, at once; pairs marked at once
WINDOW, ROWS = 32, 1 << 13  # items of a pair compared at once, and pairs


class Block:
    """Sequences one after another: items, and where each begins; keys (value, sequence, place) in order of values and in order of sequences."""

    def __init__(self, t: pa.Table):
        column = t.column("items").combine_chunks() if isinstance(t.column("items"), pa.ChunkedArray) else t.column("items")
        raw = column.cast(pa.large_binary())
        at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        self.id = t.column("id").to_numpy()
        self.items = np.frombuffer(raw.buffers()[2], np.uint8)[at[0] : at[-1]].view("<u4") if at[-1] > at[0] else np.zeros(0, np.uint32)
        padded = np.concatenate([self.items, np.zeros(WINDOW, np.uint32)])
        self.items = padded[: len(self.items)]
        self.windows = np.ndarray(len(self.items) + 1, f"V{4 * WINDOW}", padded, strides=(4,))  # the items from each place on, copied as a whole
        self.at = (at - at[0]) // 4
        self.n = np.diff(self.at)
        hit = np.flatnonzero(self.items * np.uint32(SCRAMBLE) < np.uint32(1 << 30))
        in_each = np.diff(np.searchsorted(hit, self.at))
        of = np.repeat(np.arange(len(self.n), dtype=np.int32), in_each)
        place = (hit - np.repeat(self.at[:-1], in_each)).astype(np.int32)
        words = np.sort(self.items[hit].astype(np.uint64) << np.uint64(32) | np.arange(len(hit), dtype=np.uint64))
        order = (words & np.uint64(0xFFFFFFFF)).astype(np.int64)
        value, of, place = (words >> np.uint64(32)).astype(np.uint32), of[order], place[order]
        run = np.flatnonzero(_new(value) | _new(of))
        size = np.diff(run, append=len(of))
        keep = np.repeat(size <= MAX_REPEATS, size)
        self.value, self.of, self.place = value[keep], of[keep], place[keep]
        self.first = np.flatnonzero(_new(self.value))
        self.known = self.value[self.first]
        self.count = np.diff(self.first, append=len(self.value))
        self.keys = np.bincount(self.of, minlength=len(self.n))


def _new(x: np.ndarray) -> np.ndarray:
    """Whether each is unlike the one before it."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def _each(rows: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row so many times: the row, and first, first + 1, and so on."""
    at = np.cumsum(n) - n
    return np.repeat(rows, n), np.arange(int(n.sum())) + np.repeat(first - at, n)


def _runs(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of n that add up to at most `most`, or of one."""
    total = np.cumsum(n)
    at = 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(total, (int(total[at - 1]) if at else 0) + most, side="right")))
        yield at, end
        at = end


def overlap(nx: np.ndarray, ny: np.ndarray, d: np.ndarray) -> np.ndarray:
    """How many items i of the first have an item i + d of the second."""
    return np.minimum(nx, ny - d) - np.maximum(-d, 0)


def candidates(s: Block, t: Block, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """x, y, d, forward, backward: sequences of s and t, offsets to compare them at, and in which directions."""
    at = np.searchsorted(t.known, s.known)
    hit = at < len(t.known)
    hit[hit] = t.known[at[hit]] == s.known[hit]
    first, n = (np.where(hit, z[np.minimum(at, len(t.known) - 1)], 0) if len(t.known) else np.zeros(len(at), np.int64) for z in (t.first, t.count))
    use = np.repeat(hit, s.count)
    first, n = np.repeat(first, s.count)[use], np.repeat(n, s.count)[use]
    order = np.argsort(s.of[use], kind="stable")
    of, place, first, n = s.of[use][order], s.place[use][order], first[order], n[order]
    bounds = np.searchsorted(of, np.arange(len(s.n) + 1))
    per = np.concatenate([[0], np.cumsum(n)])[bounds]
    width = len(t.n)
    sn, tn = s.n.astype(np.int32), t.n.astype(np.int32)
    step = max(1, CELLS // max(1, width))
    for lo, hi in ((at, min(at + step, end)) for begin, end in _runs(np.diff(per), AT_ONCE) for at in range(begin, end, step)):
        a, b = bounds[lo], bounds[hi]
        if a == b:
            continue
        k, m = _each(np.arange(a, b), first[a:b], n[a:b])
        x, y, d = of[k], t.of[m], t.place[m] - place[k]
        if same:  # each pair once; a sequence doesn't meet itself
            ok = x < y
            k, m, x, y, d = k[ok], m[ok], x[ok], y[ok], d[ok]
        pair = (x - lo).astype(np.int64) * width + y
        nx, ny = sn[x], tn[y]
        long = overlap(nx, ny, d) + 4 >= threshold * np.minimum(nx, ny)  # so long that an offset beside it can reach the threshold
        word = np.sort(pair[long] << 32 | (d[long].astype(np.int64) + (1 << 31)))
        near = word[1:] - word[:-1] <= 1
        close = np.zeros(len(word), bool)  # offsets with votes enough beside them: MIN_VOTES is 2
        close[1:] = near
        close[:-1] |= near
        word = word[close]
        word = word[_new(word)]
        word = np.sort(np.concatenate([word - 1, word, word + 1]))
        word = word[_new(word)]
        w = word >> 32
        word = w[reaches(s, t, w // width + lo, w % width, (word & 0xFFFFFFFF) - (1 << 31), threshold)]
        if not len(word):
            continue
        chosen = np.zeros((hi - lo) * width, bool)
        chosen[word] = True
        ok = chosen[pair]
        if ok.any():
            yield from _best(pair[ok], d[ok].astype(np.int64), place[k[ok]], t.place[m[ok]], lo, width)


def _best(pair, d, px, py, lo: int, width: int):
    """The offsets with most votes of each pair, as sequence.best_offsets has them, and those beside them."""
    order = np.lexsort((d, pair))
    pair, d, px, py = pair[order], d[order], px[order], py[order]
    start = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (d[1:] != d[:-1])]))
    votes, px, py = np.diff([*start, len(d)]), np.minimum.reduceat(px, start), np.minimum.reduceat(py, start)
    pair, d = pair[start], d[start]
    near = votes.copy()
    next_ = np.flatnonzero((pair[1:] == pair[:-1]) & (d[1:] - d[:-1] == 1))
    near[next_] += votes[next_ + 1]
    near[next_ + 1] += votes[next_]
    begin = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    rank = np.arange(len(pair)) - np.repeat(begin, np.diff([*begin, len(pair)]))
    flags = np.zeros(len(pair), np.int64)
    for bit, seen, by in ((1, px, d), (2, py, -d)):
        order = np.lexsort((by, seen, -votes, pair))
        flags[order[rank < CANDIDATES]] |= bit
    flags[near < MIN_VOTES] = 0
    ok = flags > 0
    pair, d, flags = (np.concatenate(z) for z in ([pair[ok]] * 3, [d[ok] - 1, d[ok], d[ok] + 1], [flags[ok]] * 3))
    if not len(pair):
        return
    order = np.lexsort((d, pair))
    pair, d, flags = pair[order], d[order], flags[order]
    start = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (d[1:] != d[:-1])]))
    flags = np.bitwise_or.reduceat(flags, start)
    pair, d = pair[start], d[start]
    yield pair // width + lo, pair % width, d, (flags & 1) > 0, (flags & 2) > 0


def reaches(s: Block, t: Block, x: np.ndarray, y: np.ndarray, d: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair reaches the threshold at its offset. What is not compared yet adds at most 1 an item, so most pairs are out after a few windows."""
    out = np.zeros(len(x), bool)
    for k in range(0, len(x), ROWS):
        part = slice(k, k + ROWS)
        a, b, move = x[part], y[part], d[part]
        n, least = overlap(s.n[a], t.n[b], move), np.minimum(s.n[a], t.n[b])
        i, j = s.at[a] + np.maximum(-move, 0), t.at[b] + np.maximum(move, 0)
        live = np.flatnonzero((n > 0) & (n >= threshold * least))
        n, least, i, j = n[live], least[live], i[live], j[live]
        errors, done = np.zeros(len(live), np.int64), 0
        while len(live):
            whole = done + WINDOW <= n
            if not whole.all():
                rest = ~whole
                last = live[rest]
                out[k + last] = scores(s, t, a[last], b[last], move[last]) >= threshold
                live, n, least, i, j, errors = (z[whole] for z in (live, n, least, i, j, errors))
                if not len(live):
                    break
            other = s.windows[i + done].view(np.uint64) ^ t.windows[j + done].view(np.uint64)
            bits = np.bitwise_count(other).view(np.uint64).reshape(len(live), -1)  # of 64 bits in each byte
            low = np.uint64(0x00FF00FF00FF00FF)
            bits = ((bits & low) + (bits >> np.uint64(8) & low)) * np.uint64(0x0001000100010001) >> np.uint64(48)
            for c in range(bits.shape[1]):
                errors += bits[:, c].view(np.int64)
            done += WINDOW
            ok = (n - errors / 16.0) / least >= threshold
            if not ok.all():
                live, n, least, i, j, errors = (z[ok] for z in (live, n, least, i, j, errors))
    return out


def scores(s: Block, t: Block, x: np.ndarray, y: np.ndarray, d: np.ndarray) -> np.ndarray:
    """sequence.score of each pair at its offset."""
    n, least = np.maximum(overlap(s.n[x], t.n[y], d), 0), np.minimum(s.n[x], t.n[y])
    i, j = s.at[x] + np.maximum(-d, 0), t.at[y] + np.maximum(d, 0)
    errors = np.zeros(len(x), np.int64)
    some = np.flatnonzero(n)
    for lo, hi in _runs(n[some], AT_ONCE):
        rows, size = some[lo:hi], n[some[lo:hi]]
        bits = np.bitwise_count(s.items[_each(rows, i[rows], size)[1]] ^ t.items[_each(rows, j[rows], size)[1]])
        errors[rows] = np.add.reduceat(bits, np.cumsum(size) - size, dtype=np.int64)
    return np.maximum(0.0, n - errors / 16.0) / least


def links(s: Block, t: Block, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """a, b, similarity of sequences that reach the threshold: of s and t, and turned round."""
    for x, y, d, forward, backward in candidates(s, t, same, threshold):
        score = scores(s, t, x, y, d)
        for turned, asked in ((False, forward), (True, backward)):
            ok = asked & (score >= threshold) & (score > 0)
            if ok.any():
                a, b, z = x[ok], y[ok], score[ok]  # in order of pairs
                start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                a, b, z = s.id[a[start]], t.id[b[start]], np.maximum.reduceat(z, start)
                yield (b, a, z) if turned else (a, b, z)


def classes(t: pa.Table) -> pa.Table:
    """id (smallest), items, ids: of each distinct sequence that has items."""
    by: dict[bytes, list[int]] = {}
    for k, v in zip(t.column("id").to_pylist(), t.column("items").to_pylist()):
        if v and k is not None:
            by.setdefault(v, []).append(k)
    held = sorted((sorted(ids), v) for v, ids in by.items())
    return pa.table({"id": pa.array([i[0] for i, _ in held], pa.int64()), "items": pa.array([v for _, v in held], pa.large_binary()), "ids": pa.array([i for i, _ in held], pa.list_(pa.int64()))})


def groups(seqs: DataFrame, total: int, threshold: float) -> DataFrame:
    """anchor, member, similarity: star groups of sequences, longer ones first. seqs: id, items (little-endian unsigned 32-bit numbers); total: about how many there are. threshold is more than 0."""
    size = min(BLOCK, max(LEAST_BLOCK, -(-total // PARTS)))
    held = blocks(seqs.select("id", "items"), "items", size, classes, total, SIDE)
    release(seqs.sparkSession)

    def members(batches):
        for batch in batches:
            for data in batch.column("data"):
                t = pa.ipc.open_stream(data.as_buffer()).read_all()
                b = Block(t)
                ids = t.column("ids").combine_chunks()
                of = np.repeat(np.arange(len(b.id)), ids.value_lengths().to_numpy())
                each = ids.flatten().to_numpy()
                # a sequence with one indexed item isn't found by its own copies
                alone = b.keys[of] < MIN_VOTES
                out = (b.id[of], np.where(alone, each, b.id[of]), each, b.n[of])
                yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in out], names=["class", "rep", "id", "size"])
        give_back()

    def run(batches):
        block, s = None, None
        for p, x, q, y in tables(batches):
            if block != p:
                block, s = p, Block(x)
            for a, b, z in links(s, s if p == q else Block(y), p == q, threshold):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(z, pa.float64())], names=["a", "b", "similarity"])
            give_back()

    m = cut(held.mapInArrow(members, "class long, rep long, id long, size long"))
    conf, rows = seqs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(rows)
    conf.set(rows, 1)  # a pair of blocks goes to Python by itself: a task may have many
    try:
        e = cut(meet(held, held, True, run, "a long, b long, similarity double"))
    finally:
        conf.set(rows, before)
    alone = m.filter("rep <> class").select("class", "rep")
    for side in ("a", "b"):  # of sequences that their copies don't find every copy has the links
        more = e.join(alone.withColumnRenamed("class", side), side).drop(side).withColumnRenamed("rep", side)
        e = e.unionByName(more)
    own = m.filter("rep = class AND id <> class").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("similarity")).distinct()
    g = star_groups(m.filter("id = rep").select("id", "size"), e.unionByName(own))
    out = g.join(m.select(F.col("rep").alias("member"), "id"), "member").filter("anchor <> id")
    return out.select("anchor", F.col("id").alias("member"), "similarity")
