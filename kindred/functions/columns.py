"""Column expressions: hashes, bit vectors, names, filters."""

from __future__ import annotations

import json
from hashlib import sha256

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLE_BYTES = 64 * 1024
#: Multiplier that scrambles a uint32 before sampling. Fixed value.
SCRAMBLE = 0x9E3779B1


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def sample_hash(content: Column, size: Column, n: int = SAMPLE_BYTES) -> Column:
    """Hash of the first and last n bytes with a zero byte between; null for contents of at most 2 n bytes."""
    ends = F.concat(F.substring(content, F.lit(1), F.lit(n)), F.lit(b"\0"), F.substring(content, (size - n + 1).cast("int"), F.lit(n)))
    return F.when(size > 2 * n, F.sha2(ends, 256))


def algorithm(digest: Column) -> Column:
    return F.lower(F.split_part(digest, F.lit(":"), F.lit(1)))


def base_name(uri: Column) -> Column:
    """What follows the last slash of either kind; ``group`` if nothing does."""
    name = F.regexp_extract(F.regexp_replace(uri, r"[/\\]+$", ""), r"([^/\\]*)$", 1)
    return F.when(name == "", "group").otherwise(name)


def extension(uri: Column) -> Column:
    """Lower-case extension with its dot; none for names that only begin with dots."""
    return F.lower(F.regexp_extract(F.element_at(F.split(uri, "/"), -1), r"^\.*[^.].*?(\.[^.]*)$", 1))


def below_any(path: Column, roots: list[str]) -> Column:
    """Whether path equals one of roots or lies below it."""
    out = F.lit(False)
    for r in roots:
        out = out | (path == r) | F.startswith(path, F.lit(r.rstrip("/") + "/"))
    return out


def sampled(v: Column) -> Column:
    """Whether a uint32 is among the fourth whose scrambled value is small. Multiplied in halves: a product of 64 bits would overflow."""
    low = (v.bitwiseAND(65535)) * SCRAMBLE
    high = (F.shiftright(v, 16) * SCRAMBLE).bitwiseAND(65535) * 65536
    return (high + low).bitwiseAND(0xFFFFFFFF) < (1 << 30)


def uint32(text: Column) -> Column:
    """The first 32 bits of a text's md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def bands64(hex16: Column) -> Column:
    """A 64-bit value given as 16 hex digits, as four 16-bit numbers from the low end: there is no unsigned 64-bit type."""
    return F.array(*(F.conv(F.substring(hex16, 13 - 4 * k, 4), 16, 10).cast("long") for k in range(4)))


def pack_bits(bits: Column) -> Column:
    """An array of booleans, most significant first, as 16-bit numbers from the low end of the value."""
    words = lambda k: F.aggregate(
        F.slice(bits, F.greatest(F.size(bits) - 16 * (k + 1) + 1, F.lit(1)), F.greatest(F.least(F.lit(16), F.size(bits) - 16 * k), F.lit(0))), F.lit(0).cast("long"), lambda a, b: a * 2 + b.cast("long")
    )
    return F.array(*(words(k) for k in range(4)))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two arrays of numbers differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def hamming_similarity(distance: Column, bits: int = 64) -> Column:
    return F.greatest(F.lit(0.0), 1 - 2 * distance / F.lit(float(bits)))


def average_bits(pixels: Column) -> Column:
    """Which pixels are brighter than their mean."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x) / F.size(pixels)
    # in an array of its own, else the mean would be made anew for each pixel
    return F.transform(F.array(mean), lambda m: F.transform(pixels, lambda v: v > m))[0]


def difference_bits(pixels: Column, width: int, rows: int) -> Column:
    """Which pixels are brighter than the one before in their row: rows x (width - 1) bits."""
    at = [r * width + c for r in range(rows) for c in range(width - 1)]
    return F.array(*(F.get(pixels, F.lit(i + 1)) > F.get(pixels, F.lit(i)) for i in at))


def params_digest(params: dict) -> str:
    return sha256(json.dumps(params, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
