"""Functions on bit patterns, in numpy over Arrow batches: 64-bit wrapping hashes, half floats, bit streams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The increment and multipliers of the splitmix64 finaliser.
GOLDEN = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB

#: Streams of draws, so that different uses of a seed never meet.
STREAMS = {"latent": 1, "network": 2, "batch_pixel": 3, "batch_texel": 4}


def mix64(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.uint64) + np.uint64(GOLDEN)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def noise_key(seed: int, stream: int, step: int, pair, index: np.ndarray) -> np.ndarray:
    """A 64-bit draw that depends on its key only: nothing is stored, and a task that runs again draws the same."""
    pair = np.asarray(pair, np.uint64)
    with np.errstate(over="ignore"):
        start = mix64(np.uint64(seed ^ (stream << 56) ^ (step << 32)) ^ pair)
        return mix64(start + np.asarray(index, np.uint64) * np.uint64(GOLDEN))


def gauss(key: np.ndarray) -> np.ndarray:
    """A standard normal from 24 + 24 bits of a draw (Box-Muller, cosine branch), in double."""
    u1 = ((key >> np.uint64(40)).astype(np.float64) + 1) / (1 << 24)
    u2 = (key & np.uint64(0xFFFFFF)).astype(np.float64) / (1 << 24)
    return np.sqrt(-2 * np.log(u1)) * np.cos(2 * np.pi * u2)


def _longs(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def noise_u32(seed: int, stream: int, step: int, pair: Column, index: Column) -> Column:
    """The upper 32 bits of a draw, as a long."""

    @F.arrow_udf("long")
    def run(p: pa.Array, i: pa.Array) -> pa.Array:
        return pa.array((noise_key(seed, stream, step, _longs(p), _longs(i)) >> np.uint64(32)).astype(np.int64))

    return run(pair.cast("long"), index.cast("long"))


def noise_gauss(seed: int, stream: int, step: int, pair: Column, index: Column) -> Column:
    @F.arrow_udf("double")
    def run(p: pa.Array, i: pa.Array) -> pa.Array:
        return pa.array(gauss(noise_key(seed, stream, step, _longs(p), _longs(i))))

    return run(pair.cast("long"), index.cast("long"))


def to_half(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-float bit patterns (to nearest, ties to even), and which values are beyond the range or not finite."""
    with np.errstate(over="ignore"):
        half = np.asarray(values, np.float32).astype(np.float16)
    return half.view(np.uint16), ~np.isfinite(half)


def from_half(patterns: np.ndarray) -> np.ndarray:
    return np.asarray(patterns, np.uint16).view(np.float16).astype(np.float32)


def round_half(values: np.ndarray) -> tuple[np.ndarray, int, float]:
    """Values through half floats, how many changed and by how much at most; refuses what half floats cannot hold."""
    patterns, bad = to_half(values)
    if bad.any():
        raise ValueError("a weight is not finite or beyond 65504")
    out = from_half(patterns)
    d = np.abs(out - np.asarray(values, np.float32))
    return out, int((d != 0).sum()), float(d.max(initial=0))


def half_column(column: Column) -> Column:
    """A float column through half floats; null where out of range."""

    @F.arrow_udf("float")
    def run(values: pa.Array) -> pa.Array:
        patterns, bad = to_half(values.to_numpy(zero_copy_only=False))
        return pa.array(from_half(patterns), mask=bad)

    return run(column.cast("float"))


def ulp_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Floats that lie between two float32 values, over the monotone order of their bit patterns."""

    def order(x: np.ndarray) -> np.ndarray:
        i = np.asarray(x, np.float32).view(np.int32).astype(np.int64)
        return np.where(i < 0, -(i & 0x7FFFFFFF), i)

    return np.abs(order(a) - order(b))


def ulp_column(a: Column, b: Column) -> Column:
    @F.arrow_udf("long")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(ulp_distance(x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)))

    return run(a.cast("float"), b.cast("float"))


def fnv1a(data: bytes, width: int = 32) -> int:
    """FNV-1a of 32 or 64 bits."""
    h, prime = (2166136261, 16777619) if width == 32 else (14695981039346656037, 1099511628211)
    mask = (1 << width) - 1
    for b in data:
        h = ((h ^ b) * prime) & mask
    return h


def fnv1a_column(data: Column) -> Column:
    """FNV-1a 32 of a binary column, all rows of a batch a byte at a time; longest rows first, so that short ones drop out."""

    @F.arrow_udf("long")
    def run(values: pa.Array) -> pa.Array:
        rows = [v.as_py() or b"" for v in values]
        order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
        sizes = np.array([len(rows[i]) for i in order])
        flat = np.frombuffer(b"".join(rows[i] for i in order), np.uint8).astype(np.uint64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        h = np.full(len(rows), 2166136261, np.uint64)
        for at in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(-sizes, -at, side="left"))
            h[:n] = ((h[:n] ^ flat[starts[:n] + at]) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
        out = np.empty(len(rows), np.int64)
        out[order] = h.astype(np.int64)
        return pa.array(out)

    return run(data)


def pack_bits(values: np.ndarray, widths: np.ndarray | int) -> np.ndarray:
    """A bit stream (array of 0 and 1) of values, each its own width, least significant bit first."""
    values = np.asarray(values, np.uint64)
    widths = np.broadcast_to(np.asarray(widths, np.int64), values.shape)
    total = int(widths.sum())
    which = np.repeat(np.arange(len(values)), widths)
    shift = np.arange(total) - np.repeat(np.cumsum(widths) - widths, widths)
    return ((values[which] >> shift.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)


class BitReader:
    """Reads such a stream; reading past the end raises an error that names the place."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
        self.at = 0
        self.sync = 0

    def take(self, count: int, width: int) -> np.ndarray:
        end = self.at + count * width
        if end > len(self.bits):
            raise ValueError(f"the stream ends at bit {len(self.bits)}, {end} are needed")
        part = self.bits[self.at : end].reshape(count, width).astype(np.uint64)
        self.at = end
        return (part << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).astype(np.int64)

    def marker(self, expected: int) -> None:
        got = int(self.take(1, 6)[0])
        self.sync += 6
        if got != expected:
            raise ValueError(f"sync marker {got:#x} at bit {self.at - 6} where {expected:#x} is due")
