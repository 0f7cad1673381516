"""Quantisation of grid values: min/max grids, fixed grids, palettes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import f32, fixed_index, grid_value, halfeven_index, minmax_index, range_of
from ..functions.tables import fixed_grid


def fit_ranges(df: DataFrame, channel: str | list[str], value: str) -> DataFrame:
    """(channel.., lo, hi, width) per channel: one grouping with partial minima and maxima."""
    keys = [channel] if isinstance(channel, str) else channel
    return df.groupBy(*keys).agg(F.min(f32(F.col(value))).alias("lo"), F.max(f32(F.col(value))).alias("hi")).withColumn("width", range_of(F.col("lo"), F.col("hi")))


def grid_table(ranges: DataFrame, bits: int) -> DataFrame:
    """ranges with every grid value (k, value) of its channel; ``ranges`` needs lo and hi only."""
    levels = (1 << bits) - 1
    wide = ranges if "width" in ranges.columns else ranges.withColumn("width", range_of(F.col("lo"), F.col("hi")))
    return wide.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("value", grid_value(F.col("k"), F.col("lo"), F.col("width"), levels))


def quantize_posthoc(df: DataFrame, channel: str | list[str], value: str, bits: int) -> DataFrame:
    """df with k (index on the channel's own min/max grid, half away from zero) and q (the grid's value).

    The ranges are one row per channel; Spark broadcasts them by their size, or joins by channel.
    """
    keys = [channel] if isinstance(channel, str) else channel
    levels = (1 << bits) - 1
    both = df.join(fit_ranges(df, keys, value), keys)
    k = both.withColumn("k", minmax_index(f32(F.col(value)), F.col("lo"), F.col("width"), levels))
    return k.withColumn("q", grid_value(F.col("k"), F.col("lo"), F.col("width"), levels))


def snap_frozen(df: DataFrame, ranges: DataFrame, channel: str | list[str], value: str, bits: int, clamp_first: bool = True) -> DataFrame:
    """df with z (the value clamped to the frozen range), k (half to even), q and moved (whether q differs from the value)."""
    keys = [channel] if isinstance(channel, str) else channel
    levels = (1 << bits) - 1
    both = df.join(ranges, keys)
    v = f32(F.col(value))
    z = F.least(F.greatest(v, F.col("lo")), F.col("hi")) if clamp_first else v
    out = both.withColumn("z", z).withColumn("k", halfeven_index(F.col("z"), F.col("lo"), F.col("width"), levels))
    return out.withColumn("q", grid_value(F.col("k"), F.col("lo"), F.col("width"), levels)).withColumn("moved", F.col("q") != v)


def fixed_value(k: Column, bits: int) -> Column:
    return f32(F.element_at(F.array(*(f32(x) for x in fixed_grid(bits))), k + 1))


def snap_fixed(df: DataFrame, value: str, bits: int) -> DataFrame:
    """df with k, q and moved on the fixed [-1, 1] grid."""
    out = df.withColumn("k", fixed_index(f32(F.col(value)), bits))
    return out.withColumn("q", fixed_value(F.col("k"), bits)).withColumn("moved", F.col("q") != f32(F.col(value)))


def palette(df: DataFrame, channel: str, index: str, value: str) -> DataFrame:
    """(channel, k, value, exact): the value that each index stands for, and whether it is the only one."""
    return df.groupBy(channel, F.col(index).alias("k")).agg(F.min(value).alias("value"), (F.min(value) == F.max(value)).alias("exact"))


def active_levels(levels: DataFrame, searched_level0: bool) -> DataFrame:
    """Levels that take part in random search: all, but for level 0 where it is searched exactly."""
    return levels.where(~((F.col("l") == 0) & F.lit(searched_level0)))


def already_discrete(levels: DataFrame) -> DataFrame:
    """levels(l, fixed boolean, frozen_bits int, dct boolean) with ``discrete``: whether training left the level on a grid of its own."""
    return levels.withColumn("discrete", ((F.col("l") == 0) & (F.col("fixed") | F.col("dct"))) | (F.col("frozen_bits") > 0))


def candidate_decodes(bits: Column) -> Column:
    """How often a search over fixed grids decodes a texel: the grid values of all channels (array of bits)."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda n, b: n + F.call_function("shiftleft", F.lit(1).cast("long"), b))


def refresh(levels: DataFrame, ranges: DataFrame, bits: dict[int, int]) -> DataFrame:
    """(l, c, y, x, z, zq, moved) of levels(l, c, y, x, v): the copy that is decoded.

    Levels in ``bits`` are snapped to their frozen ranges(l, c, lo, hi, width), and their shadow z is clamped to them; others are copied.
    """
    out = levels.where(~F.col("l").isin(list(bits))).select("l", "c", "y", "x", F.col("v").alias("z"), F.col("v").alias("zq"), F.lit(False).alias("moved"))
    for level, b in bits.items():
        own = snap_frozen(levels.where(F.col("l") == level), ranges, ["l", "c"], "v", b)
        out = out.unionByName(own.select("l", "c", "y", "x", "z", F.col("q").alias("zq"), "moved"))
    return out


def fit_all(levels: DataFrame, bits: dict[int, int]) -> tuple[DataFrame, DataFrame]:
    """Freeze the ranges of the levels in ``bits`` from what they hold, then snap: (ranges, refreshed levels)."""
    ranges = fit_ranges(levels.where(F.col("l").isin(list(bits))), ["l", "c"], "v")
    return ranges, refresh(levels, ranges, bits)
