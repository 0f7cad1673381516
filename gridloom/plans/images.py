"""Queries of network inputs, filter evaluation, maps and pictures, each with equivalent SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import decode as D
from ..operators import filtering as FI
from ..operators import grid as G
from ..operators import tokens as K
from .codec import CODE, COARSE, E_SQL, LABELS, SEED, SYM_SQL, TO8, TOKEN_SQL, U_SQL, _coarse, blend_sql, blocks_e, network_sql, plane_e, query, symbols_e, table, tap_sql

#: Inputs: a sample of each of two levels and the place.
IMAGE_NET = D.Network.drawn((4, 6, 3), SEED)
EIGHTHS = "c8 AS (SELECT y * 8 // h AS y, x // 8 AS x, max(v) AS v FROM e, hh GROUP BY 1, 2)"


def levels(spark: SparkSession, sf_dir: str) -> tuple[list[FI.Level], int]:
    """A nearest level of 16 x 16 and a bilinear one of 8 x 8, both from all of plane E; and its height."""
    h = table(spark, sf_dir, "embeddings").count()
    eighths = plane_e(spark, sf_dir).groupBy(F.floor(F.col("y") * 8 / h).cast("int").alias("y"), F.floor(F.col("x") / 8).cast("int").alias("x")).agg(F.max("v").alias("v"))
    return [FI.Level(t.withColumn("v", F.array("v")), (n, n), near) for t, n, near in ((_coarse(spark, sf_dir), 16, True), (eighths, 8, False))], h


def uv_sql(u: str) -> str:
    return f"CAST(CAST(2 AS FLOAT) * {u} - CAST(1 AS FLOAT) AS DOUBLE)"


UX, UY = U_SQL.format(p="x", n="64"), U_SQL.format(p="y", n="h")
LEVELS_SQL = f"""{COARSE}, {EIGHTHS}, p8 AS (SELECT y, x, {tap_sql('x', '64', 8)} AS sx, {tap_sql('y', 'h', 8)} AS sy FROM e, hh), b8 AS ({blend_sql('p8', 'c8', 8, 8, ', t.fx AS fx, t.fy AS fy')}),
n16 AS (SELECT p.y AS y, p.x AS x, c.v AS s, ux, uy FROM (SELECT y, x, {UX} AS ux, {UY} AS uy FROM e, hh) p JOIN c ON c.x = greatest(0, least(15, CAST(floor(ux * CAST(16 AS FLOAT)) AS INTEGER))) AND c.y = greatest(0, least(15, CAST(floor(uy * CAST(16 AS FLOAT)) AS INTEGER))))"""


@query(f"{LEVELS_SQL} SELECT y, x, [CAST(n16.s AS DOUBLE), CAST(b8.s AS DOUBLE), {uv_sql('ux')}, {uv_sql('uy')}, {uv_sql('fx')}, {uv_sql('fy')}] AS f FROM n16 JOIN b8 USING (y, x)")
def pixel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the network is given at every pixel: both levels, the place, and the place within the cell of level 1."""
    both, h = levels(spark, sf_dir)
    out = FI.features(plane_e(spark, sf_dir).select("y", "x"), both, (64, h), "uv,lv1local")
    return out.select("y", F.col("x").cast("long").alias("x"), "f")


def _three_channels(v: np.ndarray) -> np.ndarray:
    """The target image of plane E's values (1, ..)."""
    v = v.astype(np.float64)
    return np.concatenate([v + 0.5, 0.5 - v, v / 2 + 0.5])


_BASE, _BASE_LAST = network_sql(IMAGE_NET, "src")
_MOVED, _MOVED_LAST = network_sql(IMAGE_NET, "mv", "m")
SHIFTS = ", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(FI.OFFSETS))
MOVED_U = "CAST(CAST(CAST(CAST(CAST({p} AS FLOAT) + CAST(0.5 AS FLOAT) AS FLOAT) + CAST({d} AS FLOAT) AS FLOAT) AS DOUBLE) / {n} AS FLOAT)"


def moved_taps(n_x: int | str, n_y: int | str) -> str:
    tap = lambda u, n: f"CAST(CAST({u} * CAST({n} AS FLOAT) AS FLOAT) - CAST(0.5 AS FLOAT) AS FLOAT)"
    return f"(SELECT k, y, x, h, {tap('ux', n_x)} AS sx, {tap('uy', n_y)} AS sy FROM pk)"


@query(
    f"""{LEVELS_SQL}, src AS (SELECT y, x, [CAST(n16.s AS DOUBLE), CAST(b8.s AS DOUBLE), {uv_sql('ux')}, {uv_sql('uy')}] AS f FROM n16 JOIN b8 USING (y, x)), {_BASE},
img AS (SELECT r.y AS y, r.x AS x, f[1] AS r1, f[2] AS r2, f[3] AS r3, CAST(v AS DOUBLE) + 0.5 AS t1, 0.5 - CAST(v AS DOUBLE) AS t2, CAST(v AS DOUBLE) / 2 + 0.5 AS t3 FROM {_BASE_LAST} r JOIN e USING (y, x)),
o(k, ox, oy) AS (VALUES {SHIFTS}), pk AS (SELECT k, y, x, h, {MOVED_U.format(p='x', d='ox', n='64')} AS ux, {MOVED_U.format(p='y', d='oy', n='h')} AS uy FROM e, hh, o),
q64 AS {moved_taps(64, 'h')}, q16 AS {moved_taps(16, 16)}, q8 AS {moved_taps(8, 8)},
fi AS ({blend_sql('q64', 'img', 64, 't.h', ', t.k AS k', ('r1', 'r2', 'r3', 't1', 't2', 't3'))}),
i16 AS ({blend_sql('q16', 'c', 16, 16, ', t.k AS k, greatest(0, least(15, ix)) // 8 = greatest(0, least(15, ix + 1)) // 8 AND greatest(0, least(15, iy)) // (t.h // 8) = greatest(0, least(15, iy + 1)) // (t.h // 8) AS inner_')}),
i8 AS ({blend_sql('q8', 'c8', 8, 8, ', t.k AS k')}),
mv AS (SELECT pk.k AS k, pk.y AS y, pk.x AS x, inner_, [CAST(i16.s AS DOUBLE), CAST(i8.s AS DOUBLE), {uv_sql('ux')}, {uv_sql('uy')}] AS f FROM pk JOIN i16 USING (k, y, x) JOIN i8 USING (k, y, x)), {_MOVED},
er AS (SELECT m.k, inner_, (f[1] - s_r1) ** 2 + (f[2] - s_r2) ** 2 + (f[3] - s_r3) ** 2 AS e, (s_r1 - s_t1) ** 2 + (s_r2 - s_t2) ** 2 + (s_r3 - s_t3) ** 2 AS rt, (f[1] - s_t1) ** 2 + (f[2] - s_t2) ** 2 + (f[3] - s_t3) ** 2 AS it FROM {_MOVED_LAST} m JOIN fi USING (k, y, x)),
su AS (SELECT k, count(*) AS n, count(*) FILTER (WHERE inner_) AS ni, sum(e) AS e, coalesce(sum(e) FILTER (WHERE inner_), 0) AS ei, coalesce(sum(e) FILTER (WHERE NOT inner_), 0) AS eo, sum(rt) AS rt, sum(it) AS it FROM er GROUP BY k)
SELECT CAST(k AS INTEGER) AS k, round(10 * log10(n * 3 / e), 4) AS "all", CASE WHEN ni > 0 AND ei > 0 THEN round(10 * log10(ni * 3 / ei), 4) ELSE 99 END AS interior, CASE WHEN n > ni AND eo > 0 THEN round(10 * log10((n - ni) * 3 / eo), 4) ELSE 99 END AS edge,
round(100.0 * (n - ni) / n, 4) AS edge_pct, round(10 * log10(n * 3 / rt), 4) AS reference_target, round(10 * log10(n * 3 / it), 4) AS inputs_target FROM su"""
)
def evaluate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five offsets, three ways to move an image, over all pixels and those inside and across blocks."""
    both, h = levels(spark, sf_dir)
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.select(F.col("vec_id").alias("y"), F.transform("embedding", lambda v, x: x).alias("x"), F.col("embedding").cast("array<float>").alias("v"))
    out = FI.evaluate_rows(rows, both, IMAGE_NET, (64, h), "uv", spread=_three_channels)
    return out.select("k", *(F.round(c, 4).alias(c) for c in ("all", "interior", "edge", "edge_pct", "reference_target", "inputs_target")))


@query(f"WITH {E_SQL} SELECT y, x, {TO8.format(v='CAST(CAST(CAST(v AS DOUBLE) / 3 AS FLOAT) + CAST(0.5 AS FLOAT) AS FLOAT)')} AS grey FROM e")
def latent_picture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: plane E as 8-bit grey."""
    return G.grey_of_values(plane_e(spark, sf_dir)).select("y", F.col("x").cast("long").alias("x"), "grey")


@query(f"{SYM_SQL} SELECT y, x, {TO8.format(v='CAST(CAST(CAST(v - q AS FLOAT) * CAST(2 AS FLOAT) AS FLOAT) + CAST(0.5 AS FLOAT) AS FLOAT)')} AS grey FROM q")
def residual_picture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What quantising took from plane E, as 8-bit grey."""
    return G.grey_of_residual(symbols_e(spark, sf_dir), "v", "q").select("y", F.col("x").cast("long").alias("x"), "grey")


@query("SELECT vec_id, CAST((0.299 * a + 0.587 * b + 0.114 * c + (0.299 * d + 0.587 * e + 0.114 * f)) * 2 / 2 - 1 AS FLOAT) AS luma FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) + 0.5 AS a, CAST(embedding[2] AS DOUBLE) + 0.5 AS b, CAST(embedding[3] AS DOUBLE) + 0.5 AS c, CAST(embedding[62] AS DOUBLE) + 0.5 AS d, CAST(embedding[63] AS DOUBLE) + 0.5 AS e, CAST(embedding[64] AS DOUBLE) + 0.5 AS f FROM embeddings)")
def luma_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean luma of two textures, the first and the last three elements of a vector."""
    at = lambda i: F.element_at("embedding", i).cast("double") + 0.5
    return table(spark, sf_dir, "embeddings").select("vec_id", G.luma((at(1), at(2), at(3)), (at(62), at(63), at(64))).alias("luma"))


@query(f"SELECT y, x, [{', '.join(f'max(v) FILTER (WHERE label = {k})' for k in range(3, 7))}] AS v FROM (SELECT label, y, unnest(range(64)) AS x, CAST(unnest(embedding) AS FLOAT) AS v FROM (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS y FROM embeddings)) GROUP BY y, x")
def slice_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels 3 to 6 of all labels side by side."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    rows = G.rank_in_key(vectors, "label", "vec_id").select("label", "y", F.posexplode("embedding").alias("x", "v"))
    return G.slice_channels(G.pack_channels(rows.select("label", "y", F.col("x").cast("long").alias("x"), S.f32(F.col("v")).alias("v")), "label", LABELS), 3, 4)


BLOCK_SQL = f"""{TOKEN_SQL}, dcs AS (SELECT "by", bx, q AS dc FROM qs WHERE i = 0), res AS (SELECT a."by", a.bx, a.dc - coalesce(b.dc, 0) AS r FROM dcs a LEFT JOIN dcs b ON b."by" = CASE WHEN a.bx > 0 THEN a."by" ELSE a."by" - 1 END AND b.bx = CASE WHEN a.bx > 0 THEN a.bx - 1 ELSE a.bx END),
ld AS (SELECT r, -log2(n / sum(n) OVER ()) AS len FROM (SELECT r, count(*) AS n FROM res GROUP BY r)), lr AS (SELECT run, -log2(n / sum(n) OVER ()) AS len FROM (SELECT run, count(*) AS n FROM tok GROUP BY run)),
lm AS (SELECT mag, -log2(n / sum(n) OVER ()) AS len FROM (SELECT mag, count(*) AS n FROM tok WHERE mag IS NOT NULL GROUP BY mag)),
bb AS (SELECT "by", bx, sum(len) AS bits FROM (SELECT "by", bx, len FROM res JOIN ld USING (r) UNION ALL SELECT "by", bx, len + CASE WHEN mag IS NULL THEN 0 ELSE 1 END FROM tok JOIN lr USING (run) UNION ALL SELECT "by", bx, len FROM tok JOIN lm USING (mag)) GROUP BY "by", bx),
sh AS (SELECT "by", bx, count(*) FILTER (WHERE q <> 0 AND p > 0) AS nz, coalesce(max(p) FILTER (WHERE q <> 0 AND p > 0), 0) AS lnz FROM zz GROUP BY "by", bx)"""


@query(f'{BLOCK_SQL} SELECT "by", bx, round(bits, 6) AS bits FROM bb')
def block_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lengths joined back to the symbols of each block."""
    return K.block_entropy(blocks_e(spark, sf_dir).select("by", "bx", "sym")).select(F.col("by").cast("long").alias("by"), F.col("bx").cast("long").alias("bx"), F.round("bits", 6).alias("bits"))


KINDS = ("nz", "code", "bits", "lnz", "dconly")
RAMP_SQL = "[" + ", ".join(str(list(c)) for c in G.RAMP) + "]"
MAP_SQL = f"""{BLOCK_SQL}, st AS (SELECT "by", bx, nz, lnz, bits, CAST(("by" + bx) % 16 AS INTEGER) AS code FROM sh JOIN bb USING ("by", bx)),
mp AS (SELECT 'nz' AS kind, "by", bx, {RAMP_SQL}[1 + CASE WHEN nz <= 2 THEN nz WHEN nz <= 4 THEN 3 WHEN nz <= 8 THEN 4 WHEN nz <= 16 THEN 5 WHEN nz <= 32 THEN 6 ELSE 7 END] AS rgb FROM st
UNION ALL SELECT 'code', "by", bx, [code * 17, code * 17, code * 17] FROM st
UNION ALL SELECT 'bits', "by", bx, {RAMP_SQL}[1 + CASE WHEN bits < 8 THEN 0 WHEN bits < 16 THEN 1 WHEN bits < 32 THEN 2 WHEN bits < 64 THEN 3 WHEN bits < 128 THEN 4 WHEN bits < 256 THEN 5 WHEN bits < 512 THEN 6 ELSE 7 END] FROM st
UNION ALL SELECT 'lnz', "by", bx, {RAMP_SQL}[1 + CASE WHEN lnz = 0 THEN 0 WHEN lnz <= 2 THEN 1 WHEN lnz <= 5 THEN 2 WHEN lnz <= 9 THEN 3 WHEN lnz <= 20 THEN 4 WHEN lnz <= 35 THEN 5 ELSE 6 END] FROM st
UNION ALL SELECT 'dconly', "by", bx, CASE WHEN nz = 0 THEN [255, 255, 255] ELSE [0, 0, 0] END FROM st)"""


@query(f'{MAP_SQL} SELECT kind, y * 8 + r.i // 8 AS y, bx * 8 + r.i % 8 AS x, rgb[1] AS r, rgb[2] AS g, rgb[3] AS b FROM (SELECT kind, "by" AS y, bx, rgb FROM mp), range(64) r(i)')
def block_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five maps of plane E's blocks, pixel by pixel; the scale code is by + bx here."""
    blocks = blocks_e(spark, sf_dir).select("by", "bx", "sym")
    shape = K.block_shape(blocks, ["by", "bx"]).join(K.block_entropy(blocks), ["by", "bx"]).withColumn("code", (F.col("by") + F.col("bx")) % 16)
    maps = None
    for kind in KINDS:
        one = G.expand_blocks(G.map_colours(shape, kind), "rgb").select(F.lit(kind).alias("kind"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *(F.get("rgb", F.lit(k)).alias(c) for k, c in enumerate("rgb")))
        maps = one if maps is None else maps.unionByName(one)
    return maps


#: Every scale code of the blocks' own step table is this one.
assert CODE == 6
