"""Grids as tables: planes (y, x, v), their reshaping, sampling, and the joins between pixels and texels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import bits_bucket, f32, last_bucket, nonzero_bucket, to_8bit


def plane_of_arrays(df: DataFrame, row: str, values: str) -> DataFrame:
    """Long form (y long, x int, v float) of a table with one array per row."""
    return df.select(F.col(row).alias("y"), F.posexplode(values).alias("x", "v")).select("y", "x", f32(F.col("v")).alias("v"))


def rows_of_plane(plane: DataFrame) -> DataFrame:
    """One row (y, v array<float>) per plane row, elements in order of x."""
    return plane.groupBy("y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda s: s["v"]).alias("v"))


def pad_replicate(plane: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """Extend by repeating the last column and row. Only the border is copied, by exploding its own rows; nothing is joined."""
    last_x, last_y = F.col("x") == width - 1, F.col("y") == height - 1
    xs = F.when(last_x, F.sequence(F.lit(width - 1), F.lit(max(to_width, width) - 1))).otherwise(F.array("x"))
    ys = F.when(last_y, F.sequence(F.lit(height - 1), F.lit(max(to_height, height) - 1)).cast("array<bigint>")).otherwise(F.array(F.col("y").cast("long")))
    return plane.select("x", F.explode(ys).alias("y"), "v").select("y", F.explode(xs).alias("x"), "v")


def padded_size(size: int, multiple: int) -> int:
    return -(-size // multiple) * multiple


def pad_blocks(plane: DataFrame, width: int, height: int, multiple: int = 8) -> DataFrame:
    """The plane padded to whole blocks."""
    return pad_replicate(plane, width, height, padded_size(width, multiple), padded_size(height, multiple))


def centre_crop(plane: DataFrame, width: int, height: int, size: int) -> DataFrame:
    """The centre size x size part, moved to the origin; a range filter that reaches the scan."""
    w, h = min(size, width), min(size, height)
    ox, oy = (width - w) // 2, (height - h) // 2
    return plane.where(F.col("x").between(ox, ox + w - 1) & F.col("y").between(oy, oy + h - 1)).select((F.col("y") - oy).alias("y"), (F.col("x") - ox).alias("x"), "v")


def pack_channels(planes: DataFrame, key: str, n: int) -> DataFrame:
    """(y, x, v array) that holds the values of keys 0..n-1 of a table (key, y, x, v) side by side; one grouping, not n joins."""
    picked = [F.max(F.when(F.col(key) == k, F.col("v"))).alias(f"c{k}") for k in range(n)]
    return planes.where(F.col(key).between(0, n - 1)).groupBy("y", "x").agg(*picked).select("y", "x", F.array(*(f"c{k}" for k in range(n))).alias("v"))


def rank_in_key(rows: DataFrame, key: str, order: str, chunk: int = 4096) -> DataFrame:
    """``rows`` with y long: 0, 1, .. within each key by ``order`` (an integer column).

    A window takes at most ``chunk`` values of ``order`` of a key, and one over the chunks' counts adds what lies before.
    """
    dealt = rows.withColumn("_c", F.floor(F.col(order) / chunk))
    before = F.sum("_n").over(Window.partitionBy("_k").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1))
    counts = dealt.groupBy(F.col(key).alias("_k"), F.col("_c").alias("_d")).agg(F.count(F.lit(1)).alias("_n")).select("_k", "_d", F.coalesce(before, F.lit(0)).alias("_b"))
    inside = F.row_number().over(Window.partitionBy(key, "_c").orderBy(order)) - 1
    ranked = dealt.withColumn("_i", inside).join(counts, (F.col(key).eqNullSafe(F.col("_k"))) & F.col("_c").eqNullSafe(F.col("_d")))
    return ranked.withColumn("y", (F.col("_b") + F.col("_i")).cast("long")).drop("_c", "_i", "_k", "_d", "_b")


def slice_channels(packed: DataFrame, first: int, count: int) -> DataFrame:
    return packed.select("y", "x", F.slice("v", first + 1, count).alias("v"))


def side_by_side(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    return left.select("y", "x", "v").unionByName(right.select("y", (F.col("x") + width).alias("x"), "v"))


def level_offsets(levels: DataFrame) -> DataFrame:
    """levels(l, w, h, c) with size and off, the place of each level in one flat vector."""
    from pyspark.sql import Window

    size = F.col("w") * F.col("h") * F.col("c")
    before = Window.orderBy("l").rowsBetween(Window.unboundedPreceding, -1)  # a handful of levels
    return levels.withColumn("size", size).withColumn("off", F.coalesce(F.sum(size).over(before), F.lit(0)))


def luma(*textures: tuple[Column, Column, Column]) -> Column:
    """Mean luma of RGB values in [0, 1], scaled to [-1, 1]: what a full-resolution level may begin with."""
    total = sum((0.299 * r + 0.587 * g + 0.114 * b for r, g, b in textures), F.lit(0.0))
    return f32(total * 2 / len(textures) - 1)


def centre(pixel: Column, n_pixels: int, shift: Column | float = 0.0) -> Column:
    """A pixel centre, moved by a part of a pixel, in [0, 1]."""
    return f32(f32(f32(f32(pixel) + f32(0.5)) + f32(shift)) / n_pixels)


def taps(pixel: Column, n_pixels: int, n_texels: int, nearest: bool = False, shift: Column | float = 0.0) -> dict[str, Column]:
    """One axis of sampling: the texels a pixel centre reads, and the fraction. Fractions come from the floor before clamping."""
    u = centre(pixel, n_pixels, shift)
    x = f32(u * f32(n_texels)) if nearest else f32(f32(u * f32(n_texels)) - f32(0.5))
    i = F.floor(x).cast("int")
    held = lambda k: F.greatest(F.lit(0), F.least(F.lit(n_texels - 1), k))
    return {"at": i, "lo": held(i), "hi": held(i if nearest else i + 1), "f": f32(x - f32(i))}


def taps_batch(pixel: np.ndarray, n_pixels: int, n_texels: int, nearest: bool = False, shift: float = 0.0) -> dict[str, np.ndarray]:
    """taps() of numpy integers in the same float32 steps, with u, the centre itself."""
    u = ((pixel.astype(np.float32) + np.float32(0.5) + np.float32(shift)).astype(np.float64) / n_pixels).astype(np.float32)
    x = u * np.float32(n_texels) - np.float32(0 if nearest else 0.5)
    i = np.floor(x).astype(np.int64)
    lo, hi = (np.clip(k, 0, n_texels - 1) for k in (i, i if nearest else i + 1))
    return {"u": u, "lo": lo, "hi": hi, "f": x - i.astype(np.float32)}


def axis(spark, n_pixels: int, n_texels: int, nearest: bool = False) -> DataFrame:
    """The taps of every pixel of an axis: n rows instead of n x n."""
    t = taps(F.col("p"), n_pixels, n_texels, nearest)
    del t["at"]
    return spark.range(n_pixels).select(F.col("id").cast("int").alias("p")).select("p", *(c.alias(k) for k, c in t.items()))


def sample(pixels: DataFrame, texels: DataFrame, image: tuple[int, int], size: tuple[int, int], nearest: bool = False) -> DataFrame:
    """pixels(y, x, ..) with the texel grid's value ``s`` at each pixel centre.

    A pixel reads up to four texels. The coarse side is prepared for that: every texel goes to the cells whose corners it is, one grouping
    puts a cell's corners side by side, and pixels find their cell by one equi-join (broadcast where Spark's size check
    allows). The blend adds up from left to right in float32.
    """
    tx, ty = taps(F.col("x"), image[0], size[0], nearest), taps(F.col("y"), image[1], size[1], nearest)
    if nearest:
        asked = pixels.withColumns({"tx": tx["lo"], "ty": ty["lo"].cast("long")})
        return asked.join(texels.select(F.col("x").alias("tx"), F.col("y").cast("long").alias("ty"), F.col("v").alias("s")), ["tx", "ty"]).drop("tx", "ty")
    one = f32(1.0)
    weights = [(one - tx["f"]) * (one - ty["f"]), tx["f"] * (one - ty["f"]), (one - tx["f"]) * ty["f"], tx["f"] * ty["f"]]
    keyed = pixels.withColumns({f"w{k}": w for k, w in enumerate(weights)} | {"cx": tx["at"], "cy": ty["at"]})
    out = keyed.join(cells(texels, size), ["cx", "cy"])
    total = F.col("w0") * F.col("s0") + F.col("w1") * F.col("s1") + F.col("w2") * F.col("s2") + F.col("w3") * F.col("s3")
    return out.select(*pixels.columns, f32(total).alias("s"))


def cells(texels: DataFrame, size: tuple[int, int], value: str = "v") -> DataFrame:
    """(cx, cy, s0 .. s3): the corners of each cell between texels - left and right above, then below - where cells reach one beyond the border."""

    def sides(at: Column, n: int) -> Column:
        """The cells on an axis of which a texel is the near or the far end."""
        near, far = F.array(at, F.when(at == 0, F.lit(-1))), F.array(at - 1, F.when(at == n - 1, F.lit(n - 1)))
        told = lambda cells, end: F.transform(F.array_compact(cells), lambda c: F.struct(c.cast("int").alias("c"), F.lit(end).alias("end")))
        return F.concat(told(near, 0), told(far, 1))

    dealt = texels.select(F.col(value).alias("v"), sides(F.col("x").cast("int"), size[0]).alias("sx"), F.explode(sides(F.col("y").cast("int"), size[1])).alias("sy"))
    dealt = dealt.select("v", "sy", F.explode("sx").alias("sx"))
    corner = F.col("sy.end") * 2 + F.col("sx.end")
    return dealt.groupBy(F.col("sx.c").alias("cx"), F.col("sy.c").alias("cy")).agg(*(F.max(F.when(corner == k, F.col("v"))).alias(f"s{k}") for k in range(4)))


def position_features(pixels: DataFrame, spec: str, image: tuple[int, int], level1: tuple[int, int] | None = None, shift: tuple = (0.0, 0.0)) -> DataFrame:
    """pixels with ``pos``: 2u-1, 2v-1 for ``uv`` and twice the offset within the level-1 cell, less one, for ``lv1local``."""
    parts: list[Column] = []
    two, one = f32(2.0), f32(1.0)
    for name in parse_positions(spec):
        if name == "uv":
            parts += [f32(two * centre(F.col(a), n, d) - one) for a, n, d in zip("xy", image, shift, strict=True)]
        else:
            if level1 is None:
                raise ValueError("lv1local needs a second level")
            parts += [f32(two * taps(F.col(a), n, m, shift=d)["f"] - one) for a, n, m, d in zip("xy", image, level1, shift, strict=True)]
    return pixels.withColumn("pos", F.array(*parts) if parts else F.array().cast("array<float>"))


def parse_positions(spec: str) -> list[str]:
    names = [x.strip() for x in spec.split(",") if x.strip()]
    if names in ([], ["none"]):
        return []
    for name in names:
        if name not in ("uv", "lv1local"):
            raise ValueError(f"unknown positional input: {name}")
    return names


def footprint_sums(pixels: DataFrame, value: str, image: tuple[int, int], size: tuple[int, int], nearest: bool = False) -> DataFrame:
    """(ty, tx, total, n): each pixel's value added to the different texels it reads (a clamped tap counts once).

    The scatter form: an explode and one grouping with partial sums, where the gather form would be a range join.
    """
    tx, ty = taps(F.col("x"), image[0], size[0], nearest), taps(F.col("y"), image[1], size[1], nearest)
    keys = F.array_distinct(F.array(*(F.struct(b.cast("int").alias("ty"), a.alias("tx")) for a in (tx["lo"], tx["hi"]) for b in (ty["lo"], ty["hi"]))))
    return pixels.select(F.explode(keys).alias("t"), F.col(value).alias("d")).groupBy("t.ty", "t.tx").agg(F.sum("d").alias("total"), F.count(F.lit(1)).alias("n"))


def texel_ranges(spark, n_pixels: int, n_texels: int) -> DataFrame:
    """(t, first, past): the pixels whose nearest texel is t, on one axis; texels without pixels are absent."""
    return axis(spark, n_pixels, n_texels, True).groupBy(F.col("lo").alias("t")).agg(F.min("p").alias("first"), (F.max("p") + 1).alias("past"))


def block_sums(plane: DataFrame, value: str = "v") -> DataFrame:
    """(by, bx, n, low, high) of each 8 x 8 block: attribution by integer division of the key."""
    return plane.groupBy(F.floor(F.col("y") / 8).cast("int").alias("by"), F.floor(F.col("x") / 8).cast("int").alias("bx")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))


def grey_of_values(plane: DataFrame) -> DataFrame:
    """8-bit picture of signed values: v/3 + 0.5, clamped."""
    return plane.withColumn("grey", to_8bit(f32(f32(F.col("v") / 3) + f32(0.5))))


def grey_of_residual(joined: DataFrame, shadow: str, snapped: str) -> DataFrame:
    """8-bit picture of (shadow - snapped) x 2 + 0.5."""
    d = f32(F.col(shadow) - F.col(snapped)) * f32(2.0) + f32(0.5)
    return joined.withColumn("grey", to_8bit(d))


def expand_blocks(blocks: DataFrame, value: str) -> DataFrame:
    """(y, x, value) for each pixel of 8 x 8 blocks (by, bx, value): a block map drawn pixel by pixel."""
    out = blocks.select(F.col("by"), F.col("bx"), value, F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    return out.select((F.col("by") * 8 + F.floor(F.col("i") / 8).cast("int")).alias("y"), (F.col("bx") * 8 + F.col("i") % 8).alias("x"), value)


#: Colours of the eight steps of a block map (fixed values).
RAMP = [(0, 0, 0), (0, 0, 128), (0, 64, 255), (0, 220, 255), (0, 200, 0), (255, 230, 0), (255, 128, 0), (255, 255, 255)]


def map_colours(blocks: DataFrame, kind: str) -> DataFrame:
    """(by, bx, rgb array<int>) of blocks(by, bx, nz, lnz, code, bits): one colour a block for what it has most of.

    Kinds: nz, lnz and bits by step of the ramp, code as a grey, dconly white where a block has its mean alone.
    """
    ramp = F.array(*(F.array(*map(F.lit, c)) for c in RAMP))
    grey = lambda g: F.array(g, g, g)
    steps = {"nz": lambda: nonzero_bucket(F.col("nz")), "lnz": lambda: last_bucket(F.col("lnz")), "bits": lambda: bits_bucket(F.col("bits"))}
    if kind == "code":
        colour = grey((F.col("code") * 17).cast("int"))
    elif kind == "dconly":
        colour = grey(F.when(F.col("nz") == 0, 255).otherwise(0))
    elif kind in steps:
        colour = F.get(ramp, steps[kind]())
    else:
        raise ValueError(f"no such map: {kind}")
    return blocks.select("by", "bx", colour.alias("rgb"))
