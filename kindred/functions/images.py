"""Perceptual hashes of decoded pictures, in Arrow batches of numpy arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def grey(data: np.ndarray) -> np.ndarray:
    """Luma of a height x width x channels array in blue, green, red order, as Spark's image source has it."""
    if data.shape[2] == 1:
        return data[:, :, 0].astype(float)
    return data[:, :, 0] * 0.114 + data[:, :, 1] * 0.587 + data[:, :, 2] * 0.299


def _lanczos(size_in: int, size_out: int, lobes: int = 3) -> np.ndarray:
    """Weights from size_in samples to size_out, widened when shrinking."""
    scale = max(size_in / size_out, 1.0)
    centre = (np.arange(size_out) + 0.5) * size_in / size_out
    x = (np.arange(size_in)[None] + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return w / w.sum(1, keepdims=True)


def resize(px: np.ndarray, height: int, width: int) -> np.ndarray:
    return np.clip(np.rint(_lanczos(px.shape[0], height) @ px @ _lanczos(px.shape[1], width).T), 0, 255)


def dct_low(px: np.ndarray, n: int) -> np.ndarray:
    """The n x n low frequencies of a type-II cosine transform (factor 2, not normalised) of the last two axes."""

    def basis(size: int) -> np.ndarray:
        return 2 * np.cos(np.pi * np.arange(n)[:, None] * (2 * np.arange(size)[None] + 1) / (2 * size))

    return basis(px.shape[-2]) @ px @ basis(px.shape[-1]).T


def phash(px: np.ndarray, n: int = 8) -> np.ndarray:
    """Which low frequencies exceed their median; px: 4n x 4n."""
    low = dct_low(px, n).reshape(*px.shape[:-2], -1)
    return low > np.median(low, axis=-1, keepdims=True)


def ahash(px: np.ndarray) -> np.ndarray:
    flat = px.reshape(*px.shape[:-2], -1)
    return flat > flat.mean(-1, keepdims=True)


def dhash(px: np.ndarray) -> np.ndarray:
    """px: n rows of n + 1."""
    return (px[..., 1:] > px[..., :-1]).reshape(*px.shape[:-2], -1)


def whash(px: np.ndarray, n: int) -> np.ndarray:
    """The n x n approximation that Haar wavelets leave of a picture whose side is a power of two; which exceed their median."""
    k = px.shape[0] // n
    low = px.reshape(n, k, n, k).mean((1, 3)).reshape(-1)
    return low > np.median(low)


def _side(px: np.ndarray, n: int) -> int:
    return max(n, 1 << (min(px.shape).bit_length() - 1))


def pack(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes() if len(bits) % 8 == 0 else (int("".join("1" if b else "0" for b in bits), 2)).to_bytes(-(-len(bits) // 8), "big")


ALGORITHMS = {
    "phash": lambda px, n: phash(resize(px, 4 * n, 4 * n), n), "ahash": lambda px, n: ahash(resize(px, n, n)),
    "dhash": lambda px, n: dhash(resize(px, n, n + 1)), "whash": lambda px, n: whash(resize(px, _side(px, n), _side(px, n)), n),
}


def phash_words(n: int):
    """A column function: arrays of 8 x 8 values to the pHash of n x n bits (at most 62) as one number."""

    @F.pandas_udf("long")
    def run(px: pd.Series) -> pd.Series:
        if not len(px):
            return pd.Series([], dtype="int64")
        bits = phash(np.stack(px.to_numpy()).reshape(-1, 8, 8), n)
        return pd.Series((bits * (1 << np.arange(n * n - 1, -1, -1, dtype=np.int64))).sum(1))

    return run
