"""How many bits symbols cost: histograms, entropies and exact accounting.

Counts are integers and so independent of the order of summation; logarithms are taken of counts only, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, keys: list[str], symbol: str) -> DataFrame:
    return df.groupBy(*keys, F.col(symbol).alias("k")).agg(F.count(F.lit(1)).alias("n"))


def entropy_of_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., n, bits): N log2 N - sum n log2 n from a table with n per symbol: one more grouping, no window over it."""
    total = F.sum("n")
    return counts.groupBy(*keys).agg(total.alias("n"), (total * F.log2(total) - F.sum(F.col("n") * F.log2(F.col("n")))).alias("bits"))


def order0(df: DataFrame, keys: list[str], symbol: str) -> DataFrame:
    return entropy_of_counts(histogram(df, keys, symbol), keys)


def with_neighbours(df: DataFrame, keys: list[str], symbol: str, default: Column | int | None = 0) -> DataFrame:
    """df with ``up`` and ``left``, the symbols before it in its column and its row.

    Neighbours are found by an equi-join on the shifted key, which hashes on the whole position; a window per row or column would
    bring a whole line of a plane to one task.
    """
    at = [*keys, "y", "x"]
    up = df.select(*keys, (F.col("y") + 1).alias("y"), "x", F.col(symbol).alias("up"))
    left = df.select(*keys, "y", (F.col("x") + 1).cast(df.schema["x"].dataType).alias("x"), F.col(symbol).alias("left"))
    out = df.join(up, at, "left").join(left, at, "left")
    return out if default is None else out.fillna(default, ["up", "left"])


def context_entropy(df: DataFrame, keys: list[str], symbol: str) -> DataFrame:
    """(keys.., n, bits): H(symbol, up, left) - H(up, left); outside the plane a neighbour is 0. Triples are counted once and pairs from them."""
    triples = with_neighbours(df, keys, symbol).groupBy(*keys, "up", "left", F.col(symbol).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    by_pair = triples.groupBy(*keys, "up", "left").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return by_pair.groupBy(*keys).agg(F.sum("m").alias("n"), (F.sum(F.col("m") * F.log2("m")) - F.sum("s")).alias("bits"))


def dpcm_residuals(df: DataFrame, keys: list[str], symbol: str, bits: int) -> DataFrame:
    """df with r, the symbol less its prediction modulo 2^bits: half of left + up, whichever there is on a border, 0 at the origin."""
    near = with_neighbours(df, keys, symbol, None)
    predicted = F.when(F.col("up").isNotNull() & F.col("left").isNotNull(), F.shiftright(F.col("up") + F.col("left"), 1)).otherwise(F.coalesce("left", "up", F.lit(0)))
    return near.withColumn("r", (F.col(symbol) - predicted).bitwiseAND(F.lit((1 << bits) - 1)))


def dpcm_entropy(df: DataFrame, keys: list[str], symbol: str, bits: int) -> DataFrame:
    return order0(dpcm_residuals(df, keys, symbol, bits), keys, "r")


def bitrate_report(symbols: DataFrame, keys: list[str], symbol: str, bits: int, pixels: int, n_weights: int = 0) -> DataFrame:
    """(keys.., n, raw_bits, h0_bits, ctx_bits, dpcm_bits, header_bits, bpp_raw, bpp_h0, bpp_ctx) of each quantised channel.

    The network's weights are charged 16 bits each and a channel's range 64 bits, as a container stores them.
    """
    h0 = order0(symbols, keys, symbol).withColumnRenamed("bits", "h0_bits")
    ctx = context_entropy(symbols, keys, symbol).select(*keys, F.col("bits").alias("ctx_bits"))
    dpcm = dpcm_entropy(symbols, keys, symbol, bits).select(*keys, F.col("bits").alias("dpcm_bits"))
    joined = h0.join(ctx, keys).join(dpcm, keys)
    side = F.lit(64 + 16 * n_weights)
    out = joined.withColumns({"raw_bits": F.col("n") * bits, "header_bits": side.cast("long")})
    per = lambda c: (F.col(c) + side) / pixels
    return out.withColumns({"bpp_raw": per("raw_bits"), "bpp_h0": per("h0_bits"), "bpp_ctx": per("ctx_bits")})


def raw_accounting(levels: DataFrame, n_weights: int) -> DataFrame:
    """levels(l, w, h, c, bits): raw bits with a range per channel, and the network's 16 bits a weight, in total."""
    return levels.agg(F.sum(F.col("w") * F.col("h") * F.col("c") * F.col("bits")).alias("latent_bits"), F.sum(F.col("c") * 64).alias("header_bits"), F.lit(16 * n_weights).cast("long").alias("network_bits"))


def running_best(df: DataFrame, order: str, value: str, keys: list[str] | None = None, chunk: int = 1 << 16) -> DataFrame:
    """df with best, the largest value so far within its keys, by ``order`` (an integer column).

    A window takes ``chunk`` places of the order at most; one over the chunks' maxima adds what lies before.
    """
    at = [*(keys or []), "_c"]
    dealt = df.withColumn("_c", F.floor(F.col(order) / chunk))
    earlier = Window.partitionBy(*(keys or [])).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    tops = dealt.groupBy(*at).agg(F.max(value).alias("_m")).select(*at, F.max("_m").over(earlier).alias("_b"))
    own = F.max(value).over(Window.partitionBy(*at).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_o", own).join(tops, at).withColumn("best", F.greatest("_o", "_b")).select(*df.columns, "best")


def reconcile(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., a_bits, b_bits, equal) of two accounts of bits, neither losing a key."""
    joined = a.select(*keys, F.col("bits").alias("a_bits")).join(b.select(*keys, F.col("bits").alias("b_bits")), keys, "full")
    return joined.withColumn("equal", F.col("a_bits").eqNullSafe(F.col("b_bits")))
