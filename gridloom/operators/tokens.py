"""Run-length tokens of quantised blocks, what they cost, and rate-aware truncation.

A block is one row with an array of 64 symbols, so its tokens are found within the row, by array functions: no window, no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import code_length, low_weight, magnitude_cost, run_cost
from ..functions.tables import EOB, NN, ZIGZAG

SIGN_COST, EOB_COST = 16, 32


def zigzag(symbols: Column) -> Column:
    return F.transform(F.array(*map(F.lit, ZIGZAG)), lambda i: F.element_at(symbols, i + 1))


def nonzeros(symbols: Column) -> Column:
    """Structs (p, q) of the nonzero AC symbols in zigzag order. One pass over the block, with nothing evaluated again inside it."""
    placed = F.transform(F.array(*map(F.lit, ZIGZAG)), lambda i, p: F.struct(p.alias("p"), F.element_at(symbols, i + 1).alias("q")))
    return F.filter(placed, lambda s: (s["p"] > 0) & (s["q"] != 0))


def _last(at: Column) -> Column:
    return F.coalesce(F.try_element_at(at, F.lit(-1))["p"], F.lit(0))


def tokens(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., p, prev, run, mag, neg): a token per nonzero AC symbol; run EOB (p and mag null) ends a block whose last symbol is 0.

    prev is the position of the nonzero before (0 for none), the context of a token. A magnitude is capped at 256.
    """
    at = nonzeros(F.col("sym"))
    before = F.slice(F.concat(F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q"))), at), F.lit(1), F.size(at))
    each = F.zip_with(at, before, lambda a, b: F.struct(a["p"].alias("p"), b["p"].alias("prev"), a["q"].alias("q")))
    none = F.lit(None).cast("int")
    end = F.when(_last(at) < NN - 1, F.array(F.struct(none.alias("p"), _last(at).alias("prev"), none.alias("q")))).otherwise(F.array().cast("array<struct<p:int,prev:int,q:int>>"))
    rows = blocks.select(*keys, F.explode(F.concat(each, end)).alias("t"))
    q = F.col("t.q")
    return rows.select(*keys, "t.p", "t.prev", F.when(q.isNull(), EOB).otherwise(F.col("t.p") - F.col("t.prev") - 1).alias("run"), F.when(q.isNotNull(), F.least(F.abs(q), F.lit(256))).alias("mag"), (q < 0).alias("neg"))


def block_shape(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., nz, lnz, interior, trailing): nonzeros, last nonzero position, zeros before it and after it."""
    at = nonzeros(F.col("sym"))
    return blocks.select(*keys, F.size(at).alias("nz"), _last(at).alias("lnz")).withColumn("interior", F.col("lnz") - F.col("nz")).withColumn("trailing", 63 - F.col("lnz"))


def token_cost(weight16: int = 16) -> Column:
    """Proxy cost of a token row in 1/16 bit."""
    own = run_cost(F.col("run")) + magnitude_cost(F.col("mag")) + SIGN_COST
    return F.when(F.col("run") == EOB, EOB_COST).otherwise(low_weight(own, F.col("p"), weight16))


def block_bits(blocks: DataFrame, keys: list[str], weight16: int = 16) -> DataFrame:
    """(keys.., bits16): proxy bits of each block in 1/16 bit; every block has a token, so none is lost."""
    return tokens(blocks, keys).groupBy(*keys).agg(F.coalesce(F.sum(token_cost(weight16).cast("long")), F.lit(0)).alias("bits16"))


def proxy_totals(costs: DataFrame, key: str) -> DataFrame:
    """Proxy bits in all (key null) and per key: a rollup of integers."""
    return costs.rollup(key).agg(F.sum("bits16").alias("bits16"), F.count(F.lit(1)).alias("blocks"))


def dc_residuals(blocks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys.., by, bx, dc, r): DC symbols less that of the block to the left, or above on the left border, or 0. An equi-join on the one block asked for."""
    own = blocks.select(*(keys or []), "by", "bx", F.element_at("sym", 1).alias("dc"))
    asked = own.withColumns({"ay": F.when(F.col("bx") > 0, F.col("by")).otherwise(F.col("by") - 1), "ax": F.when(F.col("bx") > 0, F.col("bx") - 1).otherwise(F.col("bx"))})
    there = own.select(*(keys or []), F.col("by").alias("ay"), F.col("bx").alias("ax"), F.col("dc").alias("before"))
    return asked.join(there, [*(keys or []), "ay", "ax"], "left").select(*(keys or []), "by", "bx", "dc", (F.col("dc") - F.coalesce("before", F.lit(0))).alias("r"))


def bits_by_class(blocks: DataFrame, dc_bits: int) -> DataFrame:
    """(class, raw, h0, ctx) bits of the classes dc, run, mag, sign and eob of one channel's blocks (by, bx, sym).

    Runs, magnitudes and DC residuals are symbols of three streams in one table, counted once by context and symbol. Code lengths are
    taken from the counts alone: windows over that table, whose size the alphabets bound (64 contexts of 65 runs and 256 magnitudes, and the residuals).
    """
    none = F.lit(None).cast("int")
    symbol = lambda stream, context, value: F.struct(F.lit(stream).alias("stream"), context.alias("context"), value.alias("symbol"))
    both = F.array(symbol("run", F.col("prev"), F.col("run")), F.when(F.col("mag").isNotNull(), symbol("mag", F.col("prev"), F.col("mag"))))
    of_tokens = tokens(blocks, ["by", "bx"]).select(F.explode(F.array_compact(both)).alias("s")).select("s.*")
    streams = of_tokens.unionByName(dc_residuals(blocks).select(F.lit("dc").alias("stream"), none.alias("context"), F.col("r").alias("symbol")))
    counts = streams.groupBy("stream", "context", "symbol").agg(F.count(F.lit(1)).alias("n"))
    total = lambda *keys: F.sum("n").over(Window.partitionBy(*keys))
    spent = counts.withColumns({"ctx": F.col("n") * code_length(F.col("n"), total("stream", "context")), "h0": F.col("n") * code_length(total("stream", "symbol"), total("stream"))})
    end = (F.col("stream") == "run") & (F.col("symbol") == EOB)
    # A magnitude comes with a sign, which costs one bit however it is counted.
    classes = F.when(F.col("stream") == "mag", F.array(F.lit("mag"), F.lit("sign"))).otherwise(F.array(F.when(end, "eob").otherwise(F.col("stream"))))
    each = spent.withColumn("class", F.explode(classes))
    sign, n = F.col("class") == "sign", F.col("n").cast("double")
    summed = each.groupBy("class").agg(F.sum("n").alias("n"), F.sum(F.when(sign, n).otherwise(F.col("h0"))).alias("h0"), F.sum(F.when(sign, n).otherwise(F.col("ctx"))).alias("ctx"))
    widths = blocks.sparkSession.createDataFrame([("dc", dc_bits), ("run", 7), ("mag", 8), ("sign", 1), ("eob", 7)], "class string, bits long")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return widths.join(summed, "class", "left").select("class", (F.coalesce("n", F.lit(0)) * F.col("bits")).alias("raw"), zero("h0"), zero("ctx"))


def block_entropy(blocks: DataFrame) -> DataFrame:
    """(by, bx, bits double): what each block of (by, bx, sym) costs in order-0 code lengths of the plane's own DC residuals, runs and magnitudes, and its signs.

    Code lengths are a table that its alphabets bound; the symbols are joined back to it.
    """
    t = tokens(blocks, ["by", "bx"])
    signs = F.when(F.col("mag").isNotNull(), 1).otherwise(0)
    symbol = lambda stream, value, sign: F.struct(F.lit(stream).alias("stream"), value.alias("symbol"), sign.cast("int").alias("sign"))
    both = F.array(symbol("run", F.col("run"), signs), F.when(F.col("mag").isNotNull(), symbol("mag", F.col("mag"), F.lit(0))))
    rows = t.select("by", "bx", F.explode(F.array_compact(both)).alias("s")).select("by", "bx", "s.*")
    rows = rows.unionByName(dc_residuals(blocks).select("by", "bx", F.lit("dc").alias("stream"), F.col("r").alias("symbol"), F.lit(0).alias("sign")))
    counts = rows.groupBy("stream", "symbol").agg(F.count(F.lit(1)).alias("n"))
    lengths = counts.select("stream", "symbol", code_length(F.col("n"), F.sum("n").over(Window.partitionBy("stream"))).alias("length"))
    return rows.join(lengths, ["stream", "symbol"]).groupBy("by", "bx").agg(F.sum(F.col("length") + F.col("sign")).alias("bits"))


def _cost(v: np.ndarray) -> np.ndarray:
    """16 x Exp-Golomb length of v >= 1."""
    return 16 * (2 * (np.frexp(v.astype(np.float64))[1] - 1) + 1)


def truncate(coefficients: np.ndarray, symbols: np.ndarray, values: np.ndarray, lam16: float, weight16: int = 16) -> np.ndarray:
    """Symbols (blocks x 64, natural order) less those that cost more than they are worth.

    From the last zigzag position down, a nonzero goes if the distortion that it saves is below lam16 times its token's cost,
    counting what its going does to the token after it. One pass over positions; all blocks at once.
    """
    order = np.array(ZIGZAG)
    q, c, v = symbols[:, order].astype(np.int64), coefficients[:, order].astype(np.float32), values[:, order].astype(np.float32)
    nonzero = q != 0
    place = np.where(nonzero, np.arange(NN), 0)
    place[:, 0] = 0
    before = np.concatenate([np.zeros((len(q), 1), np.int64), np.maximum.accumulate(place, axis=1)[:, :-1]], axis=1)
    after = np.full(len(q), NN)
    for p in range(NN - 1, 0, -1):
        on = nonzero[:, p]
        run = p - before[:, p] - 1
        token = _cost(np.maximum(run, 0) + 1) + _cost(np.maximum(np.minimum(256, np.abs(q[:, p])), 1)) + SIGN_COST
        if p <= 2:
            token = (token * weight16 + 8) >> 4
        gap = np.maximum(after - p - 1, 0)
        saved = np.where(after == NN, token - (EOB_COST if p == NN - 1 else 0), token + _cost(gap + 1) - _cost(gap + np.maximum(run, 0) + 2))
        lost = c[:, p] * c[:, p] - (c[:, p] - v[:, p]) * (c[:, p] - v[:, p])
        drop = on & (lost < np.float32(lam16) * saved.astype(np.float32))
        q[drop, p] = 0
        after = np.where(on & ~drop, p, after)
    out = np.empty_like(symbols)
    out[:, order] = q
    return out


def truncate_column(coefficients: Column, symbols: Column, values: Column, lam16: float, weight16: int = 16) -> Column:
    """truncate() over columns of 64-element arrays."""

    @F.arrow_udf("array<int>")
    def run(c: pa.Array, s: pa.Array, v: pa.Array) -> pa.Array:
        table = lambda a: a.flatten().to_numpy(zero_copy_only=False).reshape(-1, NN)
        out = truncate(table(c), table(s), table(v), lam16, weight16).astype(np.int32).reshape(-1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) + 1, NN), pa.int32()), pa.array(out))

    return run(coefficients, symbols, values)


def lambda_per_code(lam: float, gains: list[float]) -> list[float]:
    """The truncation weight of each scale code: lambda / (16 gain^2)."""
    return [lam / (16 * g * g) for g in gains]
