"""Texts as sequences of 32-bit values: the first 32 bits of the MD5 of each run of words, many runs at once.

Runs of up to 55 bytes are one block of MD5 and hashed by arrays; longer ones one by one.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

U = np.uint32
K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
TURN = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
ONE_BLOCK, AT_ONCE = 55, 8192  # bytes of a message of one block; messages hashed at once, so that arrays stay in the cache
TEXT = 1 << 20  # bytes of texts that are split at once


def md5_head(blocks: np.ndarray) -> np.ndarray:
    """The first 32 bits, big-endian, of the MD5 of padded messages of one block each: rows of 64 bytes."""
    m = np.ascontiguousarray(blocks.view("<u4").T.astype(U))
    a, b, c, d = (np.full(m.shape[1], x, U) for x in START)
    for i in range(64):
        r = i // 16
        if r == 0:
            f, g = d ^ (b & (c ^ d)), i
        elif r == 1:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif r == 2:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += m[g]
        f += U(K[i])
        turn = TURN[r][i % 4]
        a, d, c, b = d, c, b, b + (f << U(turn) | f >> U(32 - turn))
    return (a + U(START[0])).byteswap()


def hashes(buffer: bytes, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of buffer[first:end], for each."""
    out = np.zeros(len(first), U)
    data = np.concatenate([np.frombuffer(buffer, np.uint8), np.zeros(64, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(data, 64)
    size = end - first
    inside = np.arange(64) < np.arange(ONE_BLOCK + 1)[:, None]
    keep = np.where(inside, 255, 0).astype(np.uint8)
    pad = np.where(np.arange(64) == np.arange(ONE_BLOCK + 1)[:, None], 128, 0).astype(np.uint8)
    pad.view("<u4")[:, 14] = 8 * np.arange(ONE_BLOCK + 1)
    brief = np.flatnonzero(size <= ONE_BLOCK)
    for k in range(0, len(brief), AT_ONCE):
        rows = brief[k : k + AT_ONCE]
        n = size[rows]
        out[rows] = md5_head(windows[first[rows]] & keep[n] | pad[n])
    for k in np.flatnonzero(size > ONE_BLOCK).tolist():
        out[k] = int.from_bytes(hashlib.md5(buffer[first[k] : end[k]]).digest()[:4], "big")
    return out


def sequences(texts: list[bytes | None], words: int = 3) -> list[bytes]:
    """Of each text the values of its runs of words, in order, as little-endian 32-bit numbers. Words lie between [ \\t-\\r]+, null texts have none."""
    out, first, size = [], 0, 0
    for k, t in enumerate(texts):
        size += len(t or b"")
        if size >= TEXT or k + 1 == len(texts):
            out += _sequences(texts[first : k + 1], words)
            first, size = k + 1, 0
    return out


def _sequences(texts: list[bytes | None], words: int) -> list[bytes]:
    plain = [b" ".join((t or b"").split()) for t in texts]
    buffer = b"\n".join(plain)
    data = np.frombuffer(buffer, np.uint8)
    at = np.cumsum([0, *(len(p) + 1 for p in plain)])
    gaps = np.flatnonzero((data == 32) | (data == 10))
    first, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    of = np.searchsorted(at, first, side="right") - 1
    last = np.arange(len(first) - words + 1) + words - 1 if len(first) >= words else np.zeros(0, np.int64)
    last = last[(of[last - words + 1] == of[last]) & (end[last] > first[last])]  # an empty text is no word
    values = hashes(buffer, first[last - words + 1], end[last]).astype("<u4")
    cuts = np.searchsorted(of[last], np.arange(len(plain) + 1))
    return [values[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
