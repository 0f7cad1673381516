"""8 x 8 cosine transform and its quantiser.

Blocks are arrays of 64 floats in natural order (row * 8 + column). The transform adds up eight products at a time in float32,
in a fixed order; it runs on whole Arrow batches in numpy, where each step is one array operation over all blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp, dequant_ac, dequant_dc, f32, quant_ac, quant_dc
from ..functions.tables import BASIS, NN, ZIGZAG


def blocks_of(plane: DataFrame, value: str = "v", keys: list[str] | None = None) -> DataFrame:
    """(keys.., by, bx, w array<float>) from (y, x, v): one grouping by block. The plane must be whole (see grid.pad_blocks); a block that isn't is an error."""
    i = (F.col("y") % 8 * 8 + F.col("x") % 8).cast("int")
    packed = plane.groupBy(*(keys or []), F.floor(F.col("y") / 8).cast("int").alias("by"), F.floor(F.col("x") / 8).cast("int").alias("bx")).agg(F.array_sort(F.collect_list(F.struct(i.alias("i"), f32(F.col(value)).alias("v")))).alias("s"))
    whole = F.when(F.size("s") == NN, F.col("s")).otherwise(F.raise_error(F.concat(F.lit("block "), "by", F.lit(","), "bx", F.lit(" isn't whole: pad the plane first"))))
    return packed.withColumn("w", F.transform(whole, lambda s: s["v"])).drop("s")


def pixels_of(blocks: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """(keys.., y, x, v): the inverse of blocks_of."""
    out = blocks.select(*(keys or []), "by", "bx", F.posexplode(value).alias("i", "v"))
    return out.select(*(keys or []), (F.col("by") * 8 + F.floor(F.col("i") / 8)).cast("long").alias("y"), (F.col("bx") * 8 + F.col("i") % 8).cast("int").alias("x"), "v")


def _passes(a: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """sum_j second[j] (sum_i first[i] a): columns, then rows, in order of i and j, in float32."""
    t = np.zeros_like(a)
    for i in range(8):
        t = t + a[:, :, i, None] * first[None, None, i, :]
    out = np.zeros_like(a)
    for j in range(8):
        out = out + second[None, j, :, None] * t[:, j, None, :]
    return out


def forward(blocks: np.ndarray) -> np.ndarray:
    return _passes(blocks, BASIS.T, BASIS.T)


def inverse(coefficients: np.ndarray) -> np.ndarray:
    """Rows first, then columns: the mirrored order."""
    t = np.zeros_like(coefficients)
    for u in range(8):
        t = t + BASIS[None, u, :, None] * coefficients[:, u, None, :]
    out = np.zeros_like(coefficients)
    for v in range(8):
        out = out + BASIS[None, None, v, :] * t[:, :, v, None]
    return out


def _apply(function, column: Column) -> Column:
    @F.arrow_udf("array<float>")
    def run(values: pa.Array) -> pa.Array:
        flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, 8, 8)
        out = function(flat).reshape(-1).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) + 1, NN), pa.int32()), pa.array(out))

    return run(column)


def dct(column: Column) -> Column:
    """Coefficients of a column of 64-element blocks."""
    return _apply(forward, column)


def idct(column: Column) -> Column:
    return _apply(inverse, column)


def to_plane(v: Column) -> Column:
    """A value of [-1, 1] on the [0, 64] plane."""
    return f32(clamp(f32(v), f32(-1.0), f32(1.0)) + f32(1.0)) * f32(32.0)


def quantize(coefficients: Column, steps: Column, dc_step: int, deadzone: bool) -> Column:
    """64 symbols of 64 coefficients."""
    each = F.zip_with(coefficients, steps, lambda d, s: F.struct(d.alias("d"), s.alias("s")))
    return F.transform(each, lambda e, i: F.when(i == 0, quant_dc(e["d"], dc_step)).otherwise(quant_ac(e["d"], e["s"], i, deadzone)))


def dequantize(symbols: Column, steps: Column, dc_step: int, deadzone: bool) -> Column:
    each = F.zip_with(symbols, steps, lambda q, s: F.struct(q.alias("q"), s.alias("s")))
    return F.transform(each, lambda e, i: F.when(i == 0, dequant_dc(e["q"], dc_step)).otherwise(dequant_ac(e["q"], e["s"], i, deadzone)))


def steps_literal(values: list[int]) -> Column:
    return F.array(*map(F.lit, values))


def snap_blocks(plane: DataFrame, steps: list[int], dc_step: int, deadzone: bool, value: str = "v", keys: list[str] | None = None) -> DataFrame:
    """(keys.., by, bx, w, coef, sym, raw array<float>, zq array<float>, clamped): blocks through the quantiser and back."""
    s = steps_literal(steps)
    out = blocks_of(plane.withColumn("_p", to_plane(F.col(value))), "_p", keys).withColumn("coef", dct(F.col("w"))).withColumn("sym", quantize(F.col("coef"), s, dc_step, deadzone))
    return reconstruct(out, s, dc_step, deadzone)


def recon_statistics(blocks: DataFrame, dc_bits: int, keys: list[str] | None = None) -> DataFrame:
    """(keys.., blocks, nonzeros, dc_only, clamped, ends, last_sum, raw_bits) of reconstructed blocks(sym, clamped): partial and final sums of counts within
    the rows. ``ends`` are blocks that need an end token, ``last_sum`` the last nonzero positions of those that have any."""
    at = F.filter(F.transform(steps_literal(ZIGZAG), lambda i, p: F.struct(p.alias("p"), F.element_at("sym", i + 1).alias("q"))), lambda s: (s["p"] > 0) & (s["q"] != 0))
    shaped = blocks.select(*(keys or []), "clamped", F.size(at).alias("nz"), F.coalesce(F.try_element_at(at, F.lit(-1))["p"], F.lit(0)).alias("lnz"))
    n, nonzeros, ends = F.count(F.lit(1)), F.sum("nz"), F.count_if(F.col("lnz") < NN - 1)
    raw = n * dc_bits + 16 * nonzeros + 7 * ends + 4 * n
    return shaped.groupBy(*(keys or [])).agg(n.alias("blocks"), nonzeros.alias("nonzeros"), F.count_if(F.col("nz") == 0).alias("dc_only"), F.sum("clamped").alias("clamped"), ends.alias("ends"), F.sum(F.when(F.col("nz") > 0, F.col("lnz"))).alias("last_sum"), raw.alias("raw_bits"))


def reconstruct(blocks: DataFrame, steps: Column, dc_step: int, deadzone: bool) -> DataFrame:
    """blocks(sym) with the plane values that the symbols stand for, and how many of them were clamped to [-1, 1]."""
    back = blocks.withColumn("raw", F.transform(idct(dequantize(F.col("sym"), steps, dc_step, deadzone)), lambda v: f32(f32(v / 32) - f32(1.0))))
    return back.withColumn("zq", F.transform("raw", lambda v: clamp(v, f32(-1.0), f32(1.0)))).withColumn("clamped", F.size(F.filter("raw", lambda v: (v < -1) | (v > 1))))
