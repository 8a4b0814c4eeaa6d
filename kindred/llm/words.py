"""Words of texts as 64-bit numbers, and hashes of runs of them, for many texts at once."""

from __future__ import annotations

import re

import numpy as np
import xxhash

U = np.uint64
CHUNK = 1 << 20  # bytes hashed in one go
LONG = 4096  # words of more bytes are hashed by xxhash
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: odd multipliers; each base gives an independent hash
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(size, base, U), np.full(size, inverse, U)
        up[0] = down[0] = 1
        got = _powers[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 1 << 21:  # for one very long text: not kept
            _powers.pop(base)
    return got


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xFF51AFD7ED558CCD)
    return h ^ (h >> U(32))


def runs(ids: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of each run of width ids; empty if there are fewer."""
    n = len(ids)
    if n < width:
        return np.zeros(0, U)
    up, down = _tables(base, n + 1)
    s = np.zeros(n + 1, U)
    np.cumsum(ids * up[:n], out=s[1:])
    return mix((s[width:] - s[:-width]) * down[: n - width + 1])


_NUMBER = mix(np.arange(1, 257, dtype=U) * U(BASES[2]))  # of each byte
_LOWER = _NUMBER[np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)])]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[*range(9, 14), 32]] = True


def _hashed(blob: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and places of the words of blob: sums of the bytes' numbers times powers by place, as for runs."""
    raw = np.frombuffer(blob, np.uint8)
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = _IS_SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1])
    begin, end = edge[::2], edge[1::2]
    up, down = _tables(BASES[0], len(raw) + 1)
    s = np.zeros(len(raw) + 1, U)
    np.cumsum((_LOWER if lower else _NUMBER)[raw] * up[: len(raw)], out=s[1:])
    ids = mix((s[end] - s[begin]) * down[begin] + (end - begin).astype(U))
    for i in np.flatnonzero(end - begin > LONG):
        ids[i] = _long(blob[begin[i] : end[i]], lower)
    return ids, begin


def _long(word: bytes, lower: bool) -> int:
    return xxhash.xxh3_64_intdigest(word.lower() if lower else word)


def text_words(texts: list[bytes | None], *, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, and where each text's begin and the last one's end.

    Words: runs of other bytes than space, tab, line feed, vertical tab, form
    feed and return; lower: A-Z count as a-z. Null texts have none.
    """
    blob = b"\n".join([t or b"" for t in texts])
    ids, places, pos = [], [], 0
    while pos < len(blob):
        end = min(pos + CHUNK, len(blob))
        if end < len(blob):
            m = SPACE.search(blob, end)
            stop = m.start() if m else len(blob)
            if stop - end > CHUNK:  # a word of over a MB: what is before it, then itself
                end = 1 + max(blob.rfind(c, pos, end) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
                if end <= pos:
                    ids.append(np.array([_long(blob[pos:stop], lower)], U))
                    places.append(np.array([pos]))
                    pos = stop
                    continue
            else:
                end = stop
        h, at = _hashed(blob[pos:end], lower)
        ids.append(h)
        places.append(at + pos)
        pos = end
    if not ids:
        return np.zeros(0, U), np.zeros(len(texts) + 1, np.int64)
    first = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])])
    return np.concatenate(ids), np.searchsorted(np.concatenate(places), first).astype(np.int64)
