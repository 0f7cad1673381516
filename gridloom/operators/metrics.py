"""Distortion and summary statistics of planes. Squared errors are sums of integers: exact, whatever the order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import psnr, to_8bit


def mse_8bit(a: DataFrame, b: DataFrame, keys: list[str], extent: tuple[int, int] | None = None, group: list[str] | None = None) -> DataFrame:
    """(group.., n, sse, mse, psnr) of two planes whose values in [0, 1] are first rounded to 8 bits; ``extent`` (width, height) leaves padding out."""
    inside = (lambda d: d.where((F.col("x") < extent[0]) & (F.col("y") < extent[1]))) if extent else (lambda d: d)
    joined = inside(a).withColumnRenamed("v", "va").join(inside(b).withColumnRenamed("v", "vb"), keys)
    d = to_8bit(F.col("va")) - to_8bit(F.col("vb"))
    summed = joined.groupBy(*(group or [])).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((d * d).cast("long")), F.lit(0).cast("long")).alias("sse"))
    return summed.withColumn("mse", F.col("sse") / F.col("n")).withColumn("psnr", psnr(F.col("mse")))


def weighted_mse(per_texture: DataFrame, weights: dict[int, float]) -> DataFrame:
    """One row: the weighted mean of per-texture mse (texture, mse); a texture of weight 0 drops out."""
    w = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("texture")]
    return per_texture.agg((F.sum(w * F.col("mse")) / F.sum(w)).alias("mse"))


def difference_histogram(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(diff 0..3, n, worst): how many 8-bit values differ by 0, 1, 2 and more on the common extent."""
    d = F.abs(to_8bit(F.col("va")) - to_8bit(F.col("vb")))
    joined = a.withColumnRenamed("v", "va").join(b.withColumnRenamed("v", "vb"), keys).select(d.alias("d"))
    return joined.groupBy(F.least("d", F.lit(3)).alias("diff")).agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("worst"))


def plane_distortion(df: DataFrame, value: str, snapped: str, keys: list[str] | None = None) -> DataFrame:
    """rms and largest of (snapped - value) x 32, and the percentage that moved."""
    d = (F.col(snapped).cast("double") - F.col(value).cast("double")) * 32
    return df.groupBy(*(keys or [])).agg(F.sqrt(F.avg(d * d)).alias("rms"), F.max(F.abs(d)).alias("largest"), (100 * F.avg((F.col(snapped) != F.col(value)).cast("int"))).alias("moved_pct"))


def value_stats(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    v = F.col(value).cast("double")
    return df.groupBy(*(keys or [])).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.max(F.abs(v)).alias("largest"))


def median(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Exact median, the mean of the two middle values of an even count; nulls don't count.

    Values are counted in BINS equal parts of their group's range, and only the parts that hold the middle are sorted, so no task gets the values
    of a group.
    """
    v = F.col(value)
    spread = df.where(v.isNotNull()).groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count(v).alias("_n"))
    bin_ = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(BINS - 1), F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS))).otherwise(F.lit(0))
    placed = df.where(v.isNotNull()).join(spread, keys).withColumn("_bin", bin_)
    # BINS rows a group at most.
    upto = F.sum("_m").over(Window.partitionBy(*keys).orderBy("_bin"))
    bins = placed.groupBy(*keys, "_bin", "_n").agg(F.count(F.lit(1)).alias("_m")).withColumn("_upto", upto)
    first, last = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1  # ranks of the middle values, from 1
    middle = bins.where((F.col("_upto") >= first) & (F.col("_upto") - F.col("_m") < last)).select(*keys, "_bin", (F.col("_upto") - F.col("_m")).alias("_before"))
    counted = placed.join(middle, [*keys, "_bin"]).groupBy(*keys, "_bin", "_before", "_n", v.alias("_v")).agg(F.count(F.lit(1)).alias("_m"))
    ranked = counted.withColumn("_upto", F.col("_before") + F.sum("_m").over(Window.partitionBy(*keys, "_bin").orderBy("_v")))
    held = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col("_v")))
    return ranked.groupBy(*keys).agg(((held(first) + held(last)) / 2).alias("median"))


#: Parts of a range in which median() counts.
BINS = 4096


def churn(old: DataFrame, new: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """(group.., moved1, moved2): codes that moved by one or more, and by two or more."""
    d = F.abs(F.col("new") - F.col("old"))
    joined = old.withColumnRenamed("code", "old").join(new.withColumnRenamed("code", "new"), keys)
    return joined.groupBy(*group).agg(F.count_if(d >= 1).alias("moved1"), F.count_if(d >= 2).alias("moved2"))


def compare_losses(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(worse, better, ties) of two searches by their loss per texel."""
    joined = a.withColumnRenamed("loss", "la").join(b.withColumnRenamed("loss", "lb"), keys)
    return joined.agg(F.count_if(F.col("lb") > F.col("la")).alias("worse"), F.count_if(F.col("lb") < F.col("la")).alias("better"), F.count_if(F.col("lb") == F.col("la")).alias("ties"))


def gradient_rms(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.sqrt(F.avg(F.col(column) * F.col(column))).alias("rms"))


def pair_moments(df: DataFrame) -> DataFrame:
    """df(dl, lsum): mean and spread of the pair differences, mean loss."""
    return df.agg(F.avg("dl").alias("mean"), F.stddev_pop("dl").alias("sd"), F.avg("lsum").alias("loss"))
