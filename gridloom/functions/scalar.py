"""Column expressions of the codec. Everything here runs inside Spark's own code generation.

Spark divides floats as doubles; ``f32`` rounds back, which for a single division gives the float32 result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import GAIN_FLOOR

Num = Column | int | float


def f32(x: Num) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def case(pairs: list[tuple[Column, Num]], last: Num) -> Column:
    start = F.when(pairs[0][0], pairs[0][1])
    return reduce(lambda c, p: c.when(*p), pairs[1:], start).otherwise(last)


def clamp(v: Column, lo: Num, hi: Num) -> Column:
    """Clamp that takes NaN to ``lo``; Spark sorts NaN above everything, so it needs a test of its own."""
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    return F.when(F.isnan(v) | ~(v >= lo), lo).otherwise(F.least(v, hi))


def finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def leaky(x: Column, leak: Num) -> Column:
    return F.when(x > 0, x).otherwise(x * leak)


def squash(s: Column, clamp_output: bool) -> Column:
    """The output map: a clamped shift, or a sigmoid."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), s + 0.5)) if clamp_output else 1 / (1 + F.exp(-s))


def to_8bit(v: Column) -> Column:
    """[0, 1] to 0..255, half away from zero."""
    return F.round(f32(f32(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))) * f32(255.0)), 0).cast("int")


def psnr(mse: Column) -> Column:
    return F.when(mse > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), 10 * F.log10(F.lit(65025.0) / mse)))).otherwise(100.0)


def range_of(lo: Column, hi: Column) -> Column:
    """A channel's range, never below 1e-6."""
    return F.greatest(f32(hi - lo), f32(1e-6))


def minmax_index(v: Column, lo: Column, width: Column, levels: Num) -> Column:
    """Post-hoc grid index, half away from zero."""
    t = f32(f32(f32(v - lo) / width) * f32(levels))
    return F.greatest(F.lit(0), F.least(F.lit(levels) if not isinstance(levels, Column) else levels, F.round(t, 0).cast("int")))


def halfeven_index(v: Column, lo: Column, width: Column, levels: int) -> Column:
    """Frozen-grid index, half to even, clamped before the cast."""
    return clamp(F.rint(f32(f32(f32(v - lo) / width) * f32(levels))), 0.0, float(levels)).cast("int")


def grid_value(k: Column, lo: Column, width: Column, levels: Num) -> Column:
    return f32(lo + f32(f32(k / levels) * width))


def fixed_index(v: Column, bits: int) -> Column:
    """Index on the fixed [-1, 1] grid, half away from zero."""
    levels = (1 << bits) - 1
    t = f32(f32(f32(v + f32(1.0)) * f32(0.5)) * f32(levels))
    return F.greatest(F.lit(0), F.least(F.lit(levels), F.round(t, 0).cast("int")))


def code_length(count: Column, total: Column) -> Column:
    """-log2(count / total), 0 where either is 0."""
    return F.when((count > 0) & (total > 0), -F.log2(count / total)).otherwise(0.0)


def floor_log2(v: Column) -> Column:
    """Exact, by the length of the binary form."""
    return F.length(F.bin(v)) - 1


def run_cost(run: Column) -> Column:
    """Exp-Golomb cost of a zero run in 1/16 bit."""
    return 16 * (2 * floor_log2(run + 1) + 1)


def magnitude_cost(mag: Column) -> Column:
    return 16 * (2 * floor_log2(mag) + 1)


def low_weight(token: Column, position: Column, weight16: int) -> Column:
    """The first-order pair (zigzag 1 and 2) costs weight16/16 of its token."""
    return F.when(position <= 2, F.shiftright(token * weight16 + 8, 4)).otherwise(token)


def first_order(i: Column) -> Column:
    """Whether natural index i is (1,0) or (0,1)."""
    return (i == 1) | (i == 8)


def quant_dc(d: Column, step: Num) -> Column:
    return clamp(F.rint(f32(d / step)), -1024.0, 1024.0).cast("int")


def quant_ac(d: Column, step: Column, i: Column, deadzone: bool) -> Column:
    plain = clamp(F.round(f32(d / step), 0), -1024.0, 1024.0).cast("int")
    if not deadzone:
        return plain
    tau = f32(f32(step) * f32(0.5))
    beyond = clamp(F.floor(f32(f32(f32(F.abs(d) - tau) / step) + f32(0.5))).cast("double"), 0.0, 1024.0).cast("int")
    zoned = F.when(F.abs(d) <= tau, 0).otherwise(F.when(d < 0, -beyond).otherwise(beyond))
    return F.when(first_order(i), plain).otherwise(zoned)


def dequant_dc(q: Column, step: Num) -> Column:
    return f32(q) * f32(step)


def dequant_ac(q: Column, step: Column, i: Column, deadzone: bool) -> Column:
    plain = f32(q) * f32(step)
    if not deadzone:
        return plain
    centre = f32(f32(f32(step) * f32(0.5)) + f32(F.abs(q)) * f32(step))
    return F.when(first_order(i), plain).when(q == 0, f32(0.0)).otherwise(F.when(q < 0, -centre).otherwise(centre))


def gain_code(gain: Column) -> Column:
    """Log code 0..15 of a block gain."""
    g = F.greatest(gain, F.lit(GAIN_FLOOR))
    return F.greatest(F.lit(0), F.least(F.lit(15), F.round(F.log2(g / GAIN_FLOOR) / 0.6, 0).cast("int")))


def code_gain(k: Column) -> Column:
    return F.lit(GAIN_FLOOR) * F.pow(F.lit(2.0), k * 0.6)


def nonzero_bucket(nz: Column) -> Column:
    return case([(nz <= 2, nz), (nz <= 4, 3), (nz <= 8, 4), (nz <= 16, 5), (nz <= 32, 6)], 7)


def last_bucket(lnz: Column) -> Column:
    return case([(lnz == 0, 0), (lnz <= 2, 1), (lnz <= 5, 2), (lnz <= 9, 3), (lnz <= 20, 4), (lnz <= 35, 5)], 6)


def bits_bucket(bits: Column) -> Column:
    return case([(bits < 8 * 2**k, k) for k in range(7)], 7)


def sync_value(base: int, level: Column, channel: Column) -> Column:
    """The 6-bit marker of a place in the container."""
    return (F.lit(base) + level * 13 + channel * 7).bitwiseAND(F.lit(63))


def fnv1a32(data: Column) -> Column:
    """FNV-1a over a binary column, as a fold that stays within a signed long. Suited to short keys; ``bits.fnv1a_column`` is faster on long ones."""
    digits = F.hex(data)
    bytes_ = F.transform(F.when(F.length(data) > 0, F.sequence(F.lit(1), F.length(data))).otherwise(F.array().cast("array<int>")), lambda i: F.conv(F.substr(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    return F.aggregate(bytes_, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))


def uniform_below(u: Column, n: Num) -> Column:
    """A 32-bit draw to [0, n) by the high half of the product."""
    return F.shiftright(u * n, 32).cast("int")


def list_text(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")
