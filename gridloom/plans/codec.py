"""Queries of the grid codec over the driver's tables, each with equivalent SQL.

Plane E is the table of embeddings, a row per vector and a column per element; plane L are prices by return flag; sequence V are events in
order of id. Floating results are rounded to six digits on either side, since sums have no fixed order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import scalar as S
from ..functions import tables as T
from ..operators import decode as D
from ..operators import grid as G
from ..operators import metrics as M
from ..operators import quant as Q
from ..operators import rate as R
from ..operators import tokens as K
from ..operators import train as TR
from ..operators import transform as X
from ..sources import container as C

Query = Callable[[SparkSession, str], DataFrame]
BITS = 4
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plane_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.plane_of_arrays(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")


def padded_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plane E in whole 8 x 8 blocks."""
    return G.pad_blocks(plane_e(spark, sf_dir), 64, table(spark, sf_dir, "embeddings").count())


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("c"), F.col("l_extendedprice").alias("v"))


def symbols_e(spark: SparkSession, sf_dir: str, bits: int = BITS) -> DataFrame:
    """Plane E as post-hoc grid indices, one channel."""
    return Q.quantize_posthoc(plane_e(spark, sf_dir).withColumn("c", F.lit(0)), "c", "v", bits)


def r6(column: F.Column) -> F.Column:
    return F.round(column.cast("double"), 6)


#: Plane E, its range and indices, in SQL. Float division is done in double and rounded, as both engines do it.
E_SQL = "e AS (SELECT vec_id AS y, unnest(range(len(embedding))) AS x, CAST(unnest(embedding) AS FLOAT) AS v FROM embeddings)"
RANGE_SQL = "rg AS (SELECT min(v) AS lo, max(v) AS hi, greatest(CAST(max(v) - min(v) AS FLOAT), CAST(1e-6 AS FLOAT)) AS width FROM e)"


def index_sql(levels: int, rounding: str = "round") -> str:
    t = f"CAST(CAST(CAST(CAST(v - lo AS FLOAT) AS DOUBLE) / CAST(width AS DOUBLE) AS FLOAT) * CAST({levels} AS FLOAT) AS FLOAT)"
    rounded = f"round({t})" if rounding == "round" else f"round_even({t}, 0)"
    return f"CAST(greatest(0, least({levels}, CAST({rounded} AS INTEGER))) AS INTEGER)"


def value_sql(levels: int, k: str = "k") -> str:
    return f"CAST(lo + CAST(CAST(CAST({k} AS DOUBLE) / {levels} AS FLOAT) * width AS FLOAT) AS FLOAT)"


SYM_SQL = f"WITH {E_SQL}, {RANGE_SQL}, s AS (SELECT y, x, v, lo, hi, width, {index_sql(15)} AS k FROM e, rg), q AS (SELECT *, {value_sql(15)} AS q FROM s)"


# Quantisation


@query(
    """
WITH rg AS (SELECT l_returnflag AS c, CAST(min(CAST(l_extendedprice AS FLOAT)) AS FLOAT) AS lo, CAST(max(CAST(l_extendedprice AS FLOAT)) AS FLOAT) AS hi FROM lineitem GROUP BY 1),
w AS (SELECT *, greatest(CAST(hi - lo AS FLOAT), CAST(1e-6 AS FLOAT)) AS width FROM rg)
SELECT c, CAST(k AS INTEGER) AS k, lo, hi, CAST(lo + CAST(CAST(CAST(k AS DOUBLE) / 15 AS FLOAT) * width AS FLOAT) AS FLOAT) AS value FROM w, range(16) t(k)
"""
)
def minmax_grid_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range and grid of each channel."""
    return Q.grid_table(Q.fit_ranges(prices(spark, sf_dir), "c", "v"), BITS).select("c", "k", "lo", "hi", "value")


@query(f"{SYM_SQL} SELECT y, CAST(x AS INTEGER) AS x, k, q FROM q")
def posthoc_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E7, E8, E10."""
    return symbols_e(spark, sf_dir).select("y", "x", "k", "q")


PRICES_SQL = f"""WITH rg AS (SELECT l_returnflag AS c, CAST(min(CAST(l_extendedprice AS FLOAT)) AS FLOAT) AS lo, greatest(CAST(CAST(max(CAST(l_extendedprice AS FLOAT)) AS FLOAT) - CAST(min(CAST(l_extendedprice AS FLOAT)) AS FLOAT) AS FLOAT), CAST(1e-6 AS FLOAT)) AS width FROM lineitem GROUP BY 1),
s AS (SELECT l_orderkey, l_linenumber, c, lo, width, {index_sql(15)} AS k FROM (SELECT l_orderkey, l_linenumber, c, CAST(l_extendedprice AS FLOAT) AS v, lo, width FROM lineitem JOIN rg ON l_returnflag = c))"""


@query(f"{PRICES_SQL} SELECT l_orderkey, l_linenumber, c, k, {value_sql(15)} AS q FROM s")
def posthoc_quantize_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prices of each flag on a grid of their own."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("c"), F.col("l_extendedprice").alias("v"))
    return Q.quantize_posthoc(rows, "c", "v", BITS).select("l_orderkey", "l_linenumber", "c", "k", "q")


@query(
    f"WITH {E_SQL}, {RANGE_SQL}, s AS (SELECT y, x, v, lo, width, {index_sql(255, 'even')} AS k FROM e, rg), q AS (SELECT *, {value_sql(255)} AS q FROM s) "
    "SELECT y, CAST(x AS INTEGER) AS x, k, q, q <> v AS moved FROM q"
)
def halfeven_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frozen grid."""
    e = plane_e(spark, sf_dir).withColumn("c", F.lit(0))
    return Q.snap_frozen(e, Q.fit_ranges(e, "c", "v"), "c", "v", 8).select("y", "x", "k", "q", "moved")


@query(
    f"""WITH {E_SQL}, s AS (SELECT y, x, v, CAST(greatest(0, least(7, CAST(round(CAST(CAST(CAST(v + CAST(1 AS FLOAT) AS FLOAT) * CAST(0.5 AS FLOAT) AS FLOAT) * CAST(7 AS FLOAT) AS FLOAT)) AS INTEGER))) AS INTEGER) AS k FROM e),
q AS (SELECT *, CAST(CAST(-1 AS FLOAT) + CAST(CAST(2 * k AS DOUBLE) / 7 AS FLOAT) AS FLOAT) AS q FROM s) SELECT y, CAST(x AS INTEGER) AS x, k, q, q <> v AS moved FROM q"""
)
def fixed_grid_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E11, E12, E13."""
    return Q.snap_fixed(plane_e(spark, sf_dir), "v", 3).select("y", "x", "k", "q", "moved")


@query(f"{SYM_SQL} SELECT k, min(q) AS value, min(q) = max(q) AS exact FROM q GROUP BY k")
def palette_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every index stands for one value."""
    return Q.palette(symbols_e(spark, sf_dir), "c", "k", "q").select("k", "value", "exact")


# Rate


@query("SELECT event_type AS k, count(*) AS n FROM events GROUP BY 1")
def symbol_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D8."""
    return R.histogram(table(spark, sf_dir, "events"), [], "event_type")


@query(
    """
WITH rg AS (SELECT l_returnflag AS c, CAST(min(CAST(l_extendedprice AS FLOAT)) AS FLOAT) AS lo, greatest(CAST(CAST(max(CAST(l_extendedprice AS FLOAT)) AS FLOAT) - CAST(min(CAST(l_extendedprice AS FLOAT)) AS FLOAT) AS FLOAT), CAST(1e-6 AS FLOAT)) AS width FROM lineitem GROUP BY 1),
s AS (SELECT c, {index} AS k FROM (SELECT c, CAST(l_extendedprice AS FLOAT) AS v, lo, width FROM lineitem JOIN rg ON l_returnflag = c)),
h AS (SELECT c, k, count(*) AS n FROM s GROUP BY c, k)
SELECT c, CAST(sum(n) AS BIGINT) AS n, round(-sum(n * log2(n / total)), 6) AS bits FROM (SELECT *, sum(n) OVER (PARTITION BY c) AS total FROM h) GROUP BY c
""".replace("{index}", index_sql(15))
)
def entropy_order0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D9, D15."""
    return R.order0(Q.quantize_posthoc(prices(spark, sf_dir), "c", "v", BITS), ["c"], "k").select("c", "n", r6(F.col("bits")).alias("bits"))


@query(f"{SYM_SQL} SELECT k, count(*) AS n FROM q GROUP BY 1")
def symbol_histogram_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D8 over the indices of plane E."""
    return R.histogram(symbols_e(spark, sf_dir), [], "k")


@query(f"{SYM_SQL}, h AS (SELECT k, count(*) AS n FROM q GROUP BY k) SELECT CAST(sum(n) AS BIGINT) AS n, round(-sum(n * log2(n / total)), 6) AS bits FROM (SELECT *, sum(n) OVER () AS total FROM h)")
def entropy_order0_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D9 over the indices of plane E."""
    return R.order0(symbols_e(spark, sf_dir), ["c"], "k").select("n", r6(F.col("bits")).alias("bits"))


NEAR_SQL = "n AS (SELECT y, x, k, lag(k) OVER (PARTITION BY x ORDER BY y) AS up, lag(k) OVER (PARTITION BY y ORDER BY x) AS lf FROM q)"
CTX_SQL = """t3 AS (SELECT coalesce(up, 0) AS u, coalesce(lf, 0) AS l, k, count(*) AS n FROM n GROUP BY ALL), t2 AS (SELECT u, l, sum(n) AS n FROM t3 GROUP BY u, l),
tot AS (SELECT count(*) AS n FROM q), ctx AS (SELECT (SELECT -sum(t3.n * log2(t3.n / tot.n)) FROM t3, tot) - (SELECT -sum(t2.n * log2(t2.n / tot.n)) FROM t2, tot) AS bits)"""
DPCM_SQL = """d AS (SELECT (k - CASE WHEN up IS NOT NULL AND lf IS NOT NULL THEN (up + lf) // 2 ELSE coalesce(lf, up, 0) END) & 15 AS r FROM n),
dh AS (SELECT r, count(*) AS n FROM d GROUP BY r), dpcm AS (SELECT -sum(n * log2(n / total)) AS bits FROM (SELECT *, sum(n) OVER () AS total FROM dh))"""


@query(f"{SYM_SQL}, {NEAR_SQL}, {CTX_SQL} SELECT (SELECT n FROM tot) AS n, round(bits, 6) AS bits FROM ctx")
def entropy_context_up_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D10, F1."""
    return R.context_entropy(symbols_e(spark, sf_dir), ["c"], "k").select("n", r6(F.col("bits")).alias("bits"))


@query(f"{SYM_SQL}, {NEAR_SQL}, {DPCM_SQL} SELECT (SELECT count(*) FROM q) AS n, round(bits, 6) AS bits FROM dpcm")
def entropy_dpcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D11."""
    return R.dpcm_entropy(symbols_e(spark, sf_dir), ["c"], "k", BITS).select("n", r6(F.col("bits")).alias("bits"))


@query(
    f"""{SYM_SQL}, {NEAR_SQL}, {CTX_SQL}, {DPCM_SQL}, h AS (SELECT k, count(*) AS n FROM q GROUP BY k), h0 AS (SELECT -sum(n * log2(n / total)) AS bits FROM (SELECT *, sum(n) OVER () AS total FROM h)),
px AS (SELECT count(*) * 64 AS n FROM embeddings)
SELECT tot.n AS n, tot.n * 4 AS raw_bits, round(h0.bits, 6) AS h0_bits, round(ctx.bits, 6) AS ctx_bits, round(dpcm.bits, 6) AS dpcm_bits, CAST(64 + 16 * 100 AS BIGINT) AS header_bits,
round((tot.n * 4 + 1664) / px.n, 6) AS bpp_raw, round((h0.bits + 1664) / px.n, 6) AS bpp_h0, round((ctx.bits + 1664) / px.n, 6) AS bpp_ctx FROM tot, h0, ctx, dpcm, px"""
)
def bitrate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What plane E costs at 4 bits, raw, order-0, in context and predicted."""
    s = symbols_e(spark, sf_dir)
    pixels = table(spark, sf_dir, "embeddings").count() * 64
    out = R.bitrate_report(s, ["c"], "k", BITS, pixels, n_weights=100)
    return out.select("n", "raw_bits", *(r6(F.col(c)).alias(c) for c in ("h0_bits", "ctx_bits", "dpcm_bits")), "header_bits", *(r6(F.col(c)).alias(c) for c in ("bpp_raw", "bpp_h0", "bpp_ctx")))


@query("SELECT event_id, value, max(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS best FROM events")
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """by nature one sequence; per run of a log it would be partitioned by run."""
    return R.running_best(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", "value")


# Distortion

TO8 = "CAST(round(CAST(CAST(least(1.0, greatest(0.0, {v})) AS FLOAT) * CAST(255 AS FLOAT) AS FLOAT)) AS INTEGER)"
UNIT = "CAST(CAST({v} + CAST(0.5 AS FLOAT) AS FLOAT) AS FLOAT)"
ERR_SQL = f"{SYM_SQL}, b AS (SELECT y, x, {TO8.format(v=UNIT.format(v='v'))} AS a8, {TO8.format(v=UNIT.format(v='q'))} AS b8 FROM q)"


def _unit(df: DataFrame, column: str) -> DataFrame:
    """A value of plane E moved into [0, 1]."""
    return df.select("y", "x", S.f32(S.f32(F.col(column)) + S.f32(0.5)).alias("v"))


@query(f"{ERR_SQL} SELECT count(*) AS n, CAST(sum((a8 - b8) * (a8 - b8)) AS BIGINT) AS sse, round(sum((a8 - b8) * (a8 - b8)) / count(*), 6) AS mse, round(least(100, greatest(0, 10 * log10(65025.0 / (sum((a8 - b8) * (a8 - b8)) / count(*))))), 6) AS psnr FROM b")
def mse_psnr_8bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plane E against its quantised copy; both are padded, and the padding is left out."""
    s, h = symbols_e(spark, sf_dir), table(spark, sf_dir, "embeddings").count()
    padded = lambda c: G.pad_replicate(_unit(s, c), 64, h, 72, G.padded_size(h + 4, 8))
    out = M.mse_8bit(padded("v"), padded("q"), ["y", "x"], extent=(64, h))
    return out.select("n", "sse", r6(F.col("mse")).alias("mse"), r6(F.col("psnr")).alias("psnr"))


@query(f"{ERR_SQL} SELECT CAST(least(abs(a8 - b8), 3) AS INTEGER) AS diff, count(*) AS n, CAST(max(abs(a8 - b8)) AS INTEGER) AS worst FROM b GROUP BY 1")
def diff_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D24."""
    s = symbols_e(spark, sf_dir)
    return M.difference_histogram(_unit(s, "v"), _unit(s, "q"), ["y", "x"])


@query(f"{SYM_SQL} SELECT round(sqrt(avg(d * d)), 6) AS rms, round(max(abs(d)), 6) AS largest, round(100 * avg(CAST(q <> v AS INTEGER)), 6) AS moved_pct FROM (SELECT *, (CAST(q AS DOUBLE) - CAST(v AS DOUBLE)) * 32 AS d FROM q)")
def plane_distortion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D16."""
    return M.plane_distortion(symbols_e(spark, sf_dir), "v", "q").select(*(r6(F.col(c)).alias(c) for c in ("rms", "largest", "moved_pct")))


@query("SELECT label, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(max(abs(v)), 6) AS largest FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY label")
def latent_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("v"))
    return M.value_stats(rows, "v", ["label"]).select("label", *(r6(F.col(c)).alias(c) for c in ("mean", "sd", "largest")))


@query("SELECT l_returnflag AS c, round(median(l_extendedprice), 6) AS median FROM lineitem GROUP BY 1")
def median_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D19, H1."""
    return M.median(prices(spark, sf_dir), "v", ["c"]).select("c", r6(F.col("median")).alias("median"))


@query(f"{SYM_SQL}, k8 AS (SELECT vec_id AS y, unnest(range(64)) AS x FROM embeddings), o AS (SELECT y, x, k AS code FROM q), w AS (SELECT y, x, (k * 7 + x) % 16 AS code FROM q) SELECT y % 4 AS g, count(*) FILTER (WHERE abs(o.code - w.code) >= 1) AS moved1, count(*) FILTER (WHERE abs(o.code - w.code) >= 2) AS moved2 FROM o JOIN w USING (y, x) GROUP BY 1")
def code_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that moved between two snapshots."""
    s = symbols_e(spark, sf_dir).select("y", "x", (F.col("y") % 4).alias("g"), F.col("k").alias("code"))
    return M.churn(s, s.select("y", "x", ((F.col("code") * 7 + F.col("x")) % 16).alias("code")), ["y", "x"], ["g"])


# Grids


@query(f"WITH {E_SQL}, hh AS (SELECT count(*) AS h FROM embeddings) SELECT py AS y, px AS x, e.v AS v FROM hh, range(72) a(px), (SELECT unnest(range((h + 11) // 8 * 8)) AS py FROM hh) b JOIN e ON e.x = least(px, 63) AND e.y = least(py, (SELECT h - 1 FROM hh))")
def replicate_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To a multiple of 8 above the size plus 4."""
    h = table(spark, sf_dir, "embeddings").count()
    out = G.pad_replicate(plane_e(spark, sf_dir), 64, h, 72, G.padded_size(h + 4, 8))
    return out.select("y", F.col("x").cast("long").alias("x"), "v")


@query(f"WITH {E_SQL}, hh AS (SELECT count(*) AS h FROM embeddings) SELECT y - (h - 48) // 2 AS y, x - 8 AS x, v FROM e, hh WHERE x BETWEEN 8 AND 55 AND y BETWEEN (h - 48) // 2 AND (h - 48) // 2 + 47")
def center_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2."""
    h = table(spark, sf_dir, "embeddings").count()
    return G.centre_crop(plane_e(spark, sf_dir), 64, h, 48).select("y", F.col("x").cast("long").alias("x"), "v")


@query("SELECT y, x, [max(v) FILTER (WHERE label = 0), max(v) FILTER (WHERE label = 1), max(v) FILTER (WHERE label = 2)] AS v, [max(v) FILTER (WHERE label = 1), max(v) FILTER (WHERE label = 2)] AS part FROM (SELECT label, vec_id // 10 AS y, unnest(range(64)) AS x, CAST(unnest(embedding) AS FLOAT) AS v FROM embeddings) WHERE label BETWEEN 0 AND 2 GROUP BY y, x")
def pack_slice_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three labels as channels of one plane."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.floor(F.col("vec_id") / 10).alias("y"), F.posexplode("embedding").alias("x", "v"))
    packed = G.pack_channels(rows.select("label", "y", F.col("x").cast("long").alias("x"), S.f32(F.col("v")).alias("v")), "label", 3)
    return packed.select("y", "x", "v", F.slice("v", 2, 2).alias("part"))


#: Labels of the embeddings table are 0 .. LABELS - 1.
LABELS = 10


@query(f"SELECT y, x, [{', '.join(f'max(v) FILTER (WHERE label = {k})' for k in range(LABELS))}] AS v FROM (SELECT label, y, unnest(range(64)) AS x, CAST(unnest(embedding) AS FLOAT) AS v FROM (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS y FROM embeddings)) GROUP BY y, x")
def pack_all_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector once, its label as the channel and its place within the label as the row."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    if strange := vectors.where(F.col("label").isNull() | ~F.col("label").between(0, LABELS - 1)).count():
        raise ValueError(f"{strange} vectors have a label outside 0 .. {LABELS - 1}")
    rows = G.rank_in_key(vectors, "label", "vec_id").select("label", "y", F.posexplode("embedding").alias("x", "v"))
    return G.pack_channels(rows.select("label", "y", F.col("x").cast("long").alias("x"), S.f32(F.col("v")).alias("v")), "label", LABELS)


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 16 x 16 texel grid of plane E: the largest value of each cell."""
    h = table(spark, sf_dir, "embeddings").count()
    return plane_e(spark, sf_dir).groupBy(F.floor(F.col("y") * 16 / h).cast("int").alias("y"), F.floor(F.col("x") / 4).cast("int").alias("x")).agg(F.max("v").alias("v"))


COARSE = f"WITH {E_SQL}, hh AS (SELECT count(*) AS h FROM embeddings), c AS (SELECT y * 16 // h AS y, x // 4 AS x, max(v) AS v FROM e, hh GROUP BY 1, 2)"
U_SQL = "CAST(CAST(CAST({p} AS FLOAT) + CAST(0.5 AS FLOAT) AS DOUBLE) / {n} AS FLOAT)"


def tap_sql(p: str, n: str, m: int) -> str:
    return f"CAST(CAST({U_SQL.format(p=p, n=n)} * CAST({m} AS FLOAT) AS FLOAT) - CAST(0.5 AS FLOAT) AS FLOAT)"


ONE = "CAST(1 AS FLOAT)"


def blend_sql(pixels: str, texels: str, w: int | str, h: int | str, keep: str = "", values: tuple[str, ...] = ("v",)) -> str:
    """A query for the bilinear samples of texels(y, x, v) at pixels(y, x, sx, sy, ..), float32 from left to right: s, or s_ and the name of each of several values."""
    held = lambda c, n: f"greatest(0, least({n} - 1, {c}))"
    blend = lambda v: f"({ONE} - fx) * ({ONE} - fy) * a.{v} + fx * ({ONE} - fy) * b.{v} + ({ONE} - fx) * fy * c1.{v} + fx * fy * d.{v}"
    sums = f"{blend(values[0])} AS s" if len(values) == 1 else ", ".join(f"{blend(v)} AS s_{v}" for v in values)
    corner = lambda name, dx, dy: f"LEFT JOIN {texels} {name} ON {name}.x = {held(f't.ix + {dx}', w)} AND {name}.y = {held(f't.iy + {dy}', h)}"
    return f"""SELECT t.y AS y, t.x AS x{keep}, {sums}
FROM (SELECT *, CAST(floor(sx) AS INTEGER) AS ix, CAST(floor(sy) AS INTEGER) AS iy, CAST(sx - CAST(floor(sx) AS FLOAT) AS FLOAT) AS fx, CAST(sy - CAST(floor(sy) AS FLOAT) AS FLOAT) AS fy FROM {pixels}) t
{corner('a', 0, 0)} {corner('b', 1, 0)} {corner('c1', 0, 1)} {corner('d', 1, 1)}"""


@query(f"{COARSE}, p AS (SELECT y, x, {tap_sql('x', '64', 16)} AS sx, {tap_sql('y', 'h', 16)} AS sy FROM e, hh) {blend_sql('p', 'c', 16, 16)}")
def bilinear_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coarse grid at every pixel of plane E, bit-equal in float32."""
    h = table(spark, sf_dir, "embeddings").count()
    out = G.sample(plane_e(spark, sf_dir).select("y", "x"), _coarse(spark, sf_dir), (64, h), (16, 16))
    return out.select("y", F.col("x").cast("long").alias("x"), "s")


@query(f"{COARSE}, p AS (SELECT y, x, CAST(floor({U_SQL.format(p='x', n='64')} * CAST(16 AS FLOAT)) AS INTEGER) AS tx, CAST(floor({U_SQL.format(p='y', n='h')} * CAST(16 AS FLOAT)) AS INTEGER) AS ty FROM e, hh) SELECT p.y AS y, p.x AS x, c.v AS s FROM p JOIN c ON c.x = greatest(0, least(15, tx)) AND c.y = greatest(0, least(15, ty))")
def nearest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B7, B8, G1."""
    h = table(spark, sf_dir, "embeddings").count()
    out = G.sample(plane_e(spark, sf_dir).select("y", "x"), _coarse(spark, sf_dir), (64, h), (16, 16), nearest=True)
    return out.select("y", F.col("x").cast("long").alias("x"), "s")


@query(f"WITH {E_SQL}, hh AS (SELECT count(*) AS h FROM embeddings) SELECT y, x, [round(CAST(2 * {U_SQL.format(p='x', n='64')} - 1 AS DOUBLE), 5) + 0.0, round(CAST(2 * {U_SQL.format(p='y', n='h')} - 1 AS DOUBLE), 5) + 0.0] AS pos FROM e, hh")
def position_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B10, B11, B12."""
    h = table(spark, sf_dir, "embeddings").count()
    out = G.position_features(plane_e(spark, sf_dir).select("y", "x"), "uv", (64, h))
    return out.select("y", F.col("x").cast("long").alias("x"), F.transform("pos", lambda p: F.round(p.cast("double"), 5)).alias("pos"))


@query(
    f"""{COARSE}, p AS (SELECT y, x, CAST(floor(CAST(v AS DOUBLE) * 1000) AS BIGINT) AS d, CAST(floor({tap_sql('x', '64', 16)}) AS INTEGER) AS ix, CAST(floor({tap_sql('y', 'h', 16)}) AS INTEGER) AS iy FROM e, hh),
k AS (SELECT DISTINCT y, x, d, greatest(0, least(15, ix + a)) AS tx, greatest(0, least(15, iy + b)) AS ty FROM p, range(2) t(a), range(2) u(b))
SELECT CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, CAST(sum(d) AS BIGINT) AS total, count(*) AS n FROM k GROUP BY ty, tx"""
)
def footprint_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer values, so that sums are exact."""
    h = table(spark, sf_dir, "embeddings").count()
    pixels = plane_e(spark, sf_dir).withColumn("d", F.floor(F.col("v").cast("double") * 1000))
    return G.footprint_sums(pixels, "d", (64, h), (16, 16))


@query(f"WITH hh AS (SELECT count(*) AS h FROM embeddings) SELECT greatest(0, least(15, CAST(floor({U_SQL.format(p='vec_id', n='h')} * CAST(16 AS FLOAT)) AS INTEGER))) AS t, CAST(min(vec_id) AS INTEGER) AS first, CAST(max(vec_id) + 1 AS INTEGER) AS past FROM embeddings, hh GROUP BY 1")
def texel_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows of plane E each of 16 texels has."""
    return G.texel_ranges(spark, table(spark, sf_dir, "embeddings").count(), 16)


@query(f"WITH {E_SQL} SELECT y // 8 AS \"by\", x // 8 AS bx, count(*) AS n, min(v) AS low, max(v) AS high FROM e GROUP BY 1, 2")
def block_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5."""
    return G.block_sums(plane_e(spark, sf_dir))


# Transform and tokens

QUALITY, CODE, DC_STEP = 50, 6, 4
STEPS = T.step_tables(QUALITY, DC_STEP)[CODE]
BASIS_SQL = "[" + ", ".join(f"CAST({float(v)!r} AS FLOAT)" for v in T.BASIS.reshape(-1)) + "]"
STEP_SQL = "[" + ", ".join(map(str, STEPS)) + "]"
ZZ_SQL = "[" + ", ".join(map(str, T.ZIGZAG)) + "]"
PLANE_SQL = "CAST(CAST(CAST(greatest(CAST(-1 AS FLOAT), least(CAST(1 AS FLOAT), v)) AS FLOAT) + CAST(1 AS FLOAT) AS FLOAT) * CAST(32 AS FLOAT) AS FLOAT)"
FOLD = "list_reduce(list_prepend(CAST(0 AS FLOAT), list({x} ORDER BY {by})), lambda a, b: CAST(a + b AS FLOAT))"
#: Plane E padded to a multiple of 8 by repeating its last row; 64 columns need no padding.
PADDED_SQL = "pad AS (SELECT py AS y, e.x AS x, e.v AS v FROM (SELECT unnest(range((n + 7) // 8 * 8)) AS py, n FROM (SELECT count(*) AS n FROM embeddings)) p JOIN e ON e.y = least(p.py, p.n - 1))"
DCT_SQL = f"""WITH {E_SQL}, {PADDED_SQL}, w AS (SELECT y // 8 AS "by", x // 8 AS bx, y % 8 AS i, x % 8 AS j, {PLANE_SQL} AS w FROM pad),
bs AS (SELECT i // 8 AS u, i % 8 AS p, {BASIS_SQL}[i + 1] AS b FROM range(64) t(i)),
p1 AS (SELECT "by", bx, i, u AS v, {FOLD.format(x='CAST(w * b AS FLOAT)', by='j')} AS t FROM w JOIN bs ON p = j GROUP BY "by", bx, i, u),
f AS (SELECT "by", bx, bs.u AS u, v, {FOLD.format(x='CAST(t * b AS FLOAT)', by='i')} AS d FROM p1 JOIN bs ON p = i GROUP BY "by", bx, bs.u, v),
s AS (SELECT "by", bx, u * 8 + v AS i, d, {STEP_SQL}[u * 8 + v + 1] AS l FROM f),
qs AS (SELECT *, CASE WHEN i = 0 THEN CAST(round_even(d / {DC_STEP}, 0) AS INTEGER) WHEN i IN (1, 8) THEN CAST(round(CAST(CAST(d AS DOUBLE) / l AS FLOAT)) AS INTEGER)
 WHEN abs(d) <= l * 0.5 THEN 0 ELSE CAST(sign(d) * least(1024, floor((abs(d) - l * 0.5) / l + 0.5)) AS INTEGER) END AS q FROM s)"""


def blocks_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plane E's blocks, coded with a dead zone at one quality and code."""
    return X.snap_blocks(padded_e(spark, sf_dir), STEPS, DC_STEP, True)


@query(f"{DCT_SQL} SELECT \"by\", bx, i, d AS coef FROM s")
def dct_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit-equal in float32."""
    blocks = X.blocks_of(padded_e(spark, sf_dir).withColumn("p", X.to_plane(F.col("v"))), "p").withColumn("coef", X.dct(F.col("w")))
    return blocks.select(F.col("by").cast("long").alias("by"), F.col("bx").cast("long").alias("bx"), F.posexplode("coef").alias("i", "coef")).select("by", "bx", F.col("i").cast("long").alias("i"), "coef")


@query(f"{DCT_SQL} SELECT \"by\", bx, i, q FROM qs")
def dct_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E20, E21, I9."""
    return blocks_e(spark, sf_dir).select(F.col("by").cast("long").alias("by"), F.col("bx").cast("long").alias("bx"), F.posexplode("sym").alias("i", "q")).select("by", "bx", F.col("i").cast("long").alias("i"), "q")


def inverse_sql(source: str) -> str:
    """CTE out(by, bx, i, j, w): the inverse transform of source(by, bx, i natural index, d), rows first, in float32."""
    return f"""ct AS (SELECT "by", bx, i // 8 AS u, i % 8 AS v, d FROM {source}),
iv AS (SELECT "by", bx, v, p AS i, {FOLD.format(x='CAST(d * b AS FLOAT)', by='ct.u')} AS t FROM ct JOIN bs ON bs.u = ct.u GROUP BY "by", bx, v, p),
out AS (SELECT "by", bx, iv.i AS i, p AS j, {FOLD.format(x='CAST(t * b AS FLOAT)', by='iv.v')} AS w FROM iv JOIN bs ON bs.u = iv.v GROUP BY "by", bx, iv.i, p)"""


@query(f"{DCT_SQL}, {inverse_sql('s')} SELECT \"by\" * 8 + out.i AS y, bx * 8 + out.j AS x, w.w AS there, out.w AS back FROM out JOIN w USING (\"by\", bx, i, j)")
def dct_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward and back without quantising; both values, bit-equal in float32."""
    blocks = X.blocks_of(padded_e(spark, sf_dir).withColumn("p", X.to_plane(F.col("v"))), "p")
    there = blocks.withColumn("back", X.idct(X.dct(F.col("w")))).select("by", "bx", F.arrays_zip("w", "back").alias("z"))
    return X.pixels_of(there, "z").select("y", F.col("x").cast("long").alias("x"), F.col("v.w").alias("there"), F.col("v.back").alias("back"))


DEQUANT_SQL = f"""CASE WHEN i = 0 THEN CAST(q * {DC_STEP} AS FLOAT) WHEN i IN (1, 8) THEN CAST(q * l AS FLOAT) WHEN q = 0 THEN CAST(0 AS FLOAT) ELSE CAST(sign(q) * (l * 0.5 + abs(q) * l) AS FLOAT) END"""


@query(f'{DCT_SQL} SELECT "by", bx, i, {DEQUANT_SQL} AS val FROM qs')
def dct_dequantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the symbols of each block stand for."""
    blocks = blocks_e(spark, sf_dir).withColumn("val", X.dequantize(F.col("sym"), X.steps_literal(STEPS), DC_STEP, True))
    return blocks.select(F.col("by").cast("long").alias("by"), F.col("bx").cast("long").alias("bx"), F.posexplode("val").alias("i", "val")).select("by", "bx", F.col("i").cast("long").alias("i"), "val")


RECON_SQL = f"""{DCT_SQL}, dq AS (SELECT "by", bx, i, {DEQUANT_SQL} AS d FROM qs), {inverse_sql('dq')},
rec AS (SELECT "by", bx, "by" * 8 + i AS y, bx * 8 + j AS x, CAST(CAST(CAST(w AS DOUBLE) / 32 AS FLOAT) - CAST(1 AS FLOAT) AS FLOAT) AS raw FROM out)"""


@query(f"{RECON_SQL} SELECT y, x, raw, greatest(CAST(-1 AS FLOAT), least(CAST(1 AS FLOAT), raw)) AS zq FROM rec")
def dct_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plane that the symbols stand for, before and after the clamp."""
    both = blocks_e(spark, sf_dir).select("by", "bx", F.arrays_zip("raw", "zq").alias("z"))
    return X.pixels_of(both, "z").select("y", F.col("x").cast("long").alias("x"), "v.raw", "v.zq")


@query(
    f"""{RECON_SQL}, zp AS (SELECT "by", bx, CAST(list_position({ZZ_SQL}, i) - 1 AS INTEGER) AS p, q FROM qs),
b AS (SELECT "by", bx, count(*) FILTER (WHERE q <> 0 AND p > 0) AS nz, coalesce(max(p) FILTER (WHERE q <> 0 AND p > 0), 0) AS lnz FROM zp GROUP BY "by", bx)
SELECT count(*) AS blocks, CAST(sum(nz) AS BIGINT) AS nonzeros, count(*) FILTER (WHERE nz = 0) AS dc_only, (SELECT count(*) FROM rec WHERE raw < -1 OR raw > 1) AS clamped, count(*) FILTER (WHERE lnz < 63) AS ends, CAST(sum(lnz) FILTER (WHERE nz > 0) AS BIGINT) AS last_sum,
CAST(count(*) * {T.dc_raw_bits(DC_STEP)} + 16 * sum(nz) + 7 * count(*) FILTER (WHERE lnz < 63) + 4 * count(*) AS BIGINT) AS raw_bits FROM b"""
)
def recon_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a decoder counts while it rebuilds a level."""
    return X.recon_statistics(blocks_e(spark, sf_dir), T.dc_raw_bits(DC_STEP))


_SCALE_SQL = "[" + ", ".join(f"CAST({float(v)!r} AS FLOAT)" for v in T.SCALES) + "]"
_LUMA_SQL = "[" + ", ".join(str(v) for row in T.LUMA for v in row) + "]"


@query(
    f"""WITH q AS (SELECT unnest([10, 50, 80, 100]) AS q), s AS (SELECT q, CAST(CAST(CASE WHEN q < 50 THEN CAST(5000.0 / q AS FLOAT) ELSE CAST(200 - 2 * q AS FLOAT) END AS FLOAT) * CAST(0.01 AS FLOAT) AS FLOAT) AS s FROM q)
SELECT q, CAST(k AS INTEGER) AS k, CAST(i AS INTEGER) AS i, CASE WHEN i = 0 THEN 4 WHEN q >= 100 THEN 1 ELSE greatest(1, CAST(floor(CAST(CAST({_LUMA_SQL}[i + 1] * CAST(s * {_SCALE_SQL}[k + 1] AS FLOAT) AS FLOAT) + CAST(0.5 AS FLOAT) AS FLOAT)) AS INTEGER)) END AS step FROM s, range(16) a(k), range(64) b(i)"""
)
def dct_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E15, E16."""
    rows = [(q, k, steps) for q in (10, 50, 80, 100) for k, steps in enumerate(T.step_tables(q, 4))]
    return spark.createDataFrame(rows, "q int, k int, s array<int>").select("q", "k", F.posexplode("s").alias("i", "step"))


TOKEN_SQL = f"""{DCT_SQL}, zz AS (SELECT "by", bx, CAST(list_position({ZZ_SQL}, i) - 1 AS INTEGER) AS p, q FROM qs),
nzs AS (SELECT "by", bx, p, q, coalesce(lag(p) OVER (PARTITION BY "by", bx ORDER BY p), 0) AS prev FROM zz WHERE q <> 0 AND p > 0),
ends AS (SELECT "by", bx, coalesce(max(p) FILTER (WHERE q <> 0), 0) AS lnz FROM zz WHERE p > 0 GROUP BY "by", bx),
tok AS (SELECT "by", bx, p, prev, p - prev - 1 AS run, CAST(least(abs(q), 256) AS INTEGER) AS mag, q < 0 AS neg FROM nzs UNION ALL SELECT "by", bx, NULL, lnz, 64, NULL, NULL FROM ends WHERE lnz < 63)"""


def tokens_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.tokens(blocks_e(spark, sf_dir), ["by", "bx"])


@query(f"{TOKEN_SQL} SELECT * FROM tok")
def zigzag_rle_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3, F4, F5."""
    return tokens_e(spark, sf_dir)


COST_SQL = """cost AS (SELECT "by", bx, CASE WHEN run = 64 THEN 32 ELSE CASE WHEN p <= 2 THEN (16 * (2 * (length(bin(run + 1)) - 1) + 1) + 16 * (2 * (length(bin(mag)) - 1) + 1) + 16) * 4 + 8 >> 4 ELSE 16 * (2 * (length(bin(run + 1)) - 1) + 1) + 16 * (2 * (length(bin(mag)) - 1) + 1) + 16 END END AS b FROM tok),
bits AS (SELECT "by", bx, CAST(coalesce(sum(b), 0) AS BIGINT) AS bits16 FROM cost GROUP BY "by", bx)"""


@query(f"{TOKEN_SQL}, {COST_SQL} SELECT * FROM bits")
def expgolomb_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E24, E25, F8, with the first-order pair at a quarter of its cost."""
    return K.block_bits(blocks_e(spark, sf_dir), ["by", "bx"], 4)


@query(f"{TOKEN_SQL}, {COST_SQL} SELECT bx, CAST(sum(bits16) AS BIGINT) AS bits16, count(*) AS blocks FROM bits GROUP BY ROLLUP (bx)")
def proxy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D17."""
    return K.proxy_totals(K.block_bits(blocks_e(spark, sf_dir), ["by", "bx"], 4), "bx")


@query(f"{TOKEN_SQL}, sh AS (SELECT \"by\", bx, count(*) FILTER (WHERE q <> 0 AND p > 0) AS nz, coalesce(max(p) FILTER (WHERE q <> 0 AND p > 0), 0) AS lnz FROM zz GROUP BY \"by\", bx) SELECT CAST(CASE WHEN nz <= 2 THEN nz WHEN nz <= 4 THEN 3 WHEN nz <= 8 THEN 4 WHEN nz <= 16 THEN 5 WHEN nz <= 32 THEN 6 ELSE 7 END AS INTEGER) AS nz_bucket, CASE WHEN lnz = 0 THEN 0 WHEN lnz <= 2 THEN 1 WHEN lnz <= 5 THEN 2 WHEN lnz <= 9 THEN 3 WHEN lnz <= 20 THEN 4 WHEN lnz <= 35 THEN 5 ELSE 6 END AS lnz_bucket, count(*) AS n, CAST(sum(lnz - nz) AS BIGINT) AS interior, CAST(sum(63 - lnz) AS BIGINT) AS trailing FROM sh GROUP BY 1, 2")
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D20, F5."""
    shape = K.block_shape(blocks_e(spark, sf_dir), ["by", "bx"])
    return shape.groupBy(S.nonzero_bucket(F.col("nz")).alias("nz_bucket"), S.last_bucket(F.col("lnz")).alias("lnz_bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("interior").alias("interior"), F.sum("trailing").alias("trailing"))


CLASS_SQL = f"""{TOKEN_SQL}, dcs AS (SELECT "by", bx, q AS dc FROM qs WHERE i = 0), res AS (SELECT a.dc - coalesce(b.dc, 0) AS r FROM dcs a LEFT JOIN dcs b ON b."by" = CASE WHEN a.bx > 0 THEN a."by" ELSE a."by" - 1 END AND b.bx = CASE WHEN a.bx > 0 THEN a.bx - 1 ELSE a.bx END),
rc AS (SELECT *, sum(n) OVER () AS t FROM (SELECT r, count(*) AS n FROM res GROUP BY r)),
r0 AS (SELECT *, sum(n) OVER () AS t FROM (SELECT run, count(*) AS n FROM tok GROUP BY run)), r1 AS (SELECT *, sum(n) OVER (PARTITION BY prev) AS t FROM (SELECT prev, run, count(*) AS n FROM tok GROUP BY prev, run)),
m0 AS (SELECT *, sum(n) OVER () AS t FROM (SELECT mag, count(*) AS n FROM tok WHERE mag IS NOT NULL GROUP BY mag)), m1 AS (SELECT *, sum(n) OVER (PARTITION BY prev) AS t FROM (SELECT prev, mag, count(*) AS n FROM tok WHERE mag IS NOT NULL GROUP BY prev, mag)),
cnt AS (SELECT count(*) FILTER (WHERE run < 64) AS nz, count(*) FILTER (WHERE run = 64) AS ne FROM tok)
SELECT 'dc' AS class, CAST((SELECT sum(n) FROM rc) * 8 AS BIGINT) AS raw, round((SELECT -sum(n * log2(n / t)) FROM rc), 6) AS h0, round((SELECT -sum(n * log2(n / t)) FROM rc), 6) AS ctx
UNION ALL SELECT 'run', (SELECT nz * 7 FROM cnt), round((SELECT -sum(n * log2(n / t)) FROM r0 WHERE run < 64), 6), round((SELECT -sum(n * log2(n / t)) FROM r1 WHERE run < 64), 6)
UNION ALL SELECT 'mag', (SELECT nz * 8 FROM cnt), round((SELECT -sum(n * log2(n / t)) FROM m0), 6), round((SELECT -sum(n * log2(n / t)) FROM m1), 6)
UNION ALL SELECT 'sign', (SELECT nz FROM cnt), (SELECT CAST(nz AS DOUBLE) FROM cnt), (SELECT CAST(nz AS DOUBLE) FROM cnt)
UNION ALL SELECT 'eob', (SELECT ne * 7 FROM cnt), round((SELECT -sum(n * log2(n / t)) FROM r0 WHERE run = 64), 6), round((SELECT -sum(n * log2(n / t)) FROM r1 WHERE run = 64), 6)"""


@query(CLASS_SQL)
def token_bits_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D14, F2, G7."""
    out = K.bits_by_class(blocks_e(spark, sf_dir).select("by", "bx", "sym"), T.dc_raw_bits(DC_STEP))
    return out.select("class", "raw", r6(F.col("h0")).alias("h0"), r6(F.col("ctx")).alias("ctx"))


@query()
def truncate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbols left, and nonzeros dropped, of each block."""
    s = X.steps_literal(STEPS)
    blocks = blocks_e(spark, sf_dir).withColumn("val", X.dequantize(F.col("sym"), s, DC_STEP, True))
    lam = K.lambda_per_code(TR.rate_recipe([float(T.quality_scale(QUALITY))]), T.GAINS)[CODE]
    cut = blocks.withColumn("left", K.truncate_column(F.col("coef"), F.col("sym"), F.col("val"), lam, 4))
    count = lambda c: F.size(F.filter(c, lambda q: q != 0))
    return cut.select("by", "bx", F.col("left").alias("sym"), (count(F.col("sym")) - count(F.col("left"))).alias("dropped"))


# Noise, network, training

SEED = 7
MASK = "18446744073709551616::UHUGEINT"


def _mix_steps(source: str, out: str, name: str) -> str:
    """CTEs that add column ``out`` = mix64(``source``) to a table, a step at a time so that nothing is written out twice."""
    a = f"{name}a AS (SELECT *, CAST((CAST({source} AS UHUGEINT) + {B.GOLDEN}::UHUGEINT) % {MASK} AS UBIGINT) AS m0 FROM {name})"
    b = f"{name}b AS (SELECT *, CAST((CAST(xor(m0, m0 >> 30) AS UHUGEINT) * {B.MIX_1}::UHUGEINT) % {MASK} AS UBIGINT) AS m1 FROM {name}a)"
    c = f"{name}c AS (SELECT *, CAST((CAST(xor(m1, m1 >> 27) AS UHUGEINT) * {B.MIX_2}::UHUGEINT) % {MASK} AS UBIGINT) AS m2 FROM {name}b)"
    d = f"{out} AS (SELECT * EXCLUDE (m0, m1, m2), xor(m2, m2 >> 31) AS h FROM {name}c)"
    return ", ".join((a, b, c, d))


def key_sql(stream: int) -> str:
    """CTEs that give ky(event_id, h), the draw keyed by event id."""
    start = int(B.mix64(np.array([SEED ^ (stream << 56)], np.uint64))[0])
    return f"WITH i AS (SELECT event_id, CAST((({start}::UHUGEINT + CAST(event_id AS UHUGEINT) * {B.GOLDEN}::UHUGEINT) % {MASK}) AS UBIGINT) AS s FROM events), {_mix_steps('s', 'ky', 'i')}"


@query(f"{key_sql(1)} SELECT event_id, CAST(h >> 32 AS BIGINT) AS u FROM ky")
def hash_noise_u32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E33, E34."""
    return table(spark, sf_dir, "events").select("event_id", B.noise_u32(SEED, 1, 0, F.lit(0), F.col("event_id")).alias("u"))


@query(f"{key_sql(3)} SELECT event_id, CAST(((h >> 32) * 1000) >> 32 AS INTEGER) AS pixel FROM ky")
def hash_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E35, I2."""
    u = B.noise_u32(SEED, B.STREAMS["batch_pixel"], 0, F.lit(0), F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", S.uniform_below(u, 1000).alias("pixel"))


@query(f"{key_sql(2)} SELECT event_id, round(sqrt(-2 * ln((CAST(h >> 40 AS DOUBLE) + 1) / 16777216)) * cos(2 * pi() * CAST(h & 16777215 AS DOUBLE) / 16777216), 5) AS g FROM ky")
def hash_gauss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E36."""
    return table(spark, sf_dir, "events").select("event_id", F.round(B.noise_gauss(SEED, 2, 0, F.lit(0), F.col("event_id")), 5).alias("g"))


@query("SELECT user_id, event_type, CAST(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(octet_length(encode(event_type))), lambda i: CAST(ascii(substring(event_type, CAST(i + 1 AS BIGINT), 1)) AS BIGINT))), lambda h, b: CAST((xor(h, b) * 16777619) & 4294967295 AS BIGINT)) AS BIGINT) AS h FROM (SELECT DISTINCT user_id, event_type FROM events)")
def fnv1a_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold over short ASCII keys."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    return rows.select("user_id", "event_type", S.fnv1a32(F.col("event_type").cast("binary")).alias("h"))


@query("SELECT doc_id, CAST(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(octet_length(encode(coalesce(text, '')))), lambda i: CAST('0x' || substr(hex(encode(text)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))), lambda h, b: CAST((xor(h, b) * 16777619) & 4294967295 AS BIGINT)) AS BIGINT) AS h FROM documents")
def fnv1a_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24 over long inputs: the bytes of whole texts, in Arrow batches."""
    return table(spark, sf_dir, "documents").select("doc_id", B.fnv1a_column(F.coalesce("text", F.lit("")).cast("binary")).alias("h"))


NET = D.Network.drawn((64, 6, 3), SEED)
#: A network over the four channels of a texel.
TEXEL_NET = D.Network.drawn((4, 6, 3), SEED)


def network_sql(net: D.Network, source: str, name: str = "l") -> tuple[str, str]:
    """CTEs l0.. that put the network's layers on list column f of ``source``, and the last one's name; it has column f again."""
    parts, at = [], source
    for k, (w, b, last) in enumerate(net.layers()):
        sums = [" + ".join([f"({float(bias)!r})", *(f"({float(v)!r}) * f[{i + 1}]" for i, v in enumerate(row))]) for row, bias in zip(w, b, strict=True)]
        act = (lambda s: f"1 / (1 + exp(-({s})))") if last else (lambda s: f"CASE WHEN {s} > 0 THEN {s} ELSE {net.leak} * ({s}) END")
        parts.append(f"{name}{k} AS (SELECT * EXCLUDE (f), [{', '.join(map(act, sums))}] AS f FROM {at})")
        at = f"{name}{k}"
    return ", ".join(parts), at


_NET_CTES, _NET_LAST = network_sql(NET, "src")
NET_SQL = f"WITH src AS (SELECT vec_id, embedding, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS f FROM embeddings), {_NET_CTES}"


def net_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("f"), F.transform(F.slice("embedding", 5, 3), lambda v: v.cast("double") + 0.5).alias("target"))


@query(f"{NET_SQL} SELECT vec_id, [round(f[1], 6), round(f[2], 6), round(f[3], 6)] AS out FROM {_NET_LAST}")
def mlp_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network as a column expression."""
    return D.decode(net_inputs(spark, sf_dir), NET, native=True).select("vec_id", F.transform("out", lambda v: F.round(v, 6)).alias("out"))


@query(f"{NET_SQL} SELECT vec_id, [round(f[1], 6), round(f[2], 6), round(f[3], 6)] AS out FROM {_NET_LAST}")
def decode_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in Arrow batches."""
    return D.decode(net_inputs(spark, sf_dir), NET).select("vec_id", F.transform("out", lambda v: F.round(v, 6)).alias("out"))


@query(
    f"""{NET_SQL}, er AS (SELECT vec_id, 1.0 * (f[1] - (CAST(embedding[5] AS DOUBLE) + 0.5)) ** 2 + 0.5 * (f[2] - (CAST(embedding[6] AS DOUBLE) + 0.5)) ** 2 + 2.0 * (f[3] - (CAST(embedding[7] AS DOUBLE) + 0.5)) ** 2 AS e FROM {_NET_LAST}),
b AS (SELECT event_id % (SELECT count(*) FROM embeddings) AS vec_id FROM events) SELECT count(*) AS n, round(sum(e) / (count(*) * 3.5), 6) AS loss FROM b JOIN er USING (vec_id)"""
)
def weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with repeats."""
    n = table(spark, sf_dir, "embeddings").count()
    batch = table(spark, sf_dir, "events").select((F.col("event_id") % n).alias("vec_id"))
    out = D.weighted_loss(D.decode(net_inputs(spark, sf_dir), NET, native=True), [1.0, 0.5, 2.0], batch, ["vec_id"])
    return out.select("n", r6(F.col("loss")).alias("loss"))


@query(
    f"""WITH {E_SQL}, d AS (SELECT y, x, CAST(v AS DOUBLE) AS z, CAST(v AS DOUBLE) * 0.1 + 0.01 * x AS g FROM e), m AS (SELECT *, 0.9 * 0.01 + 0.1 * g AS m, 0.999 * 0.0001 + 0.001 * g * g AS v FROM d)
SELECT y, x, round(z - 0.02 * (m / (1 - 0.9 ** 3)) / (sqrt(v / (1 - 0.999 ** 3)) + 1e-8), 6) AS z, round(m, 6) AS m, round(v, 6) AS v FROM m"""
)
def adam_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third step."""
    d = plane_e(spark, sf_dir).select("y", F.col("x").cast("long").alias("x"), F.col("v").cast("double").alias("z"), (F.col("v").cast("double") * 0.1 + 0.01 * F.col("x")).alias("g"), F.lit(0.01).alias("m"), F.lit(0.0001).alias("v"))
    out = TR.adam(d, 3, 0.02)
    return out.select("y", "x", r6(F.col("z")).alias("z"), r6(F.col("m")).alias("m"), r6(F.col("v")).alias("v"))


def _minibatch(spark: SparkSession, sf_dir: str, size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A drawn batch of network inputs and targets; bounded by its size."""
    n = table(spark, sf_dir, "embeddings").count()
    rows = TR.draw_batch(spark, size, n, SEED, 1).join(net_inputs(spark, sf_dir), F.col("pixel") == F.col("vec_id")).orderBy("s").select("f", "target").collect()
    return np.array([r["f"] for r in rows]), np.array([r["target"] for r in rows])


@query()
def es_gradient_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient from 8 antithetic pairs, then Adam."""
    x, t = _minibatch(spark, sf_dir)
    g, _ = TR.es_gradient(spark, NET, x, t, np.ones(3), pairs=8, sigma=0.02, seed=SEED, step=1)
    w, _, _ = TR.adam_numpy(NET.weights.astype(np.float64), g, np.zeros(len(g)), np.zeros(len(g)), 1, 0.005)
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(g, w, strict=True))], "i int, g double, w double")


@query()
def fd_gradient_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4, D22."""
    x, t = _minibatch(spark, sf_dir)
    g, _ = TR.fd_gradient(spark, NET, x, t, np.ones(3), h=1e-3)
    return spark.createDataFrame([(i, float(a)) for i, a in enumerate(g)], "i int, g double")


def _cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """Pixels of plane E with a three-value target, and a nearest 16 x 16 texel grid of 4 channels."""
    h = table(spark, sf_dir, "embeddings").count()
    pixels = plane_e(spark, sf_dir).select("y", "x", F.array(*(F.col("v").cast("double") + 0.5 for _ in range(3))).alias("target"))
    cell = (F.floor(F.col("y") * 16 / h).cast("int").alias("y"), F.floor(F.col("x") / 4).cast("int").alias("x"), (F.col("x") % 4).alias("c"))
    texels = plane_e(spark, sf_dir).groupBy(*cell).agg(F.max("v").alias("v"))
    return pixels, texels, h


@query()
def latent_es_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a bilinear level, whose pixels read up to four texels."""
    pixels, texels, h = _cells(spark, sf_dir)
    return TR.latent_es_gradient(pixels, texels, TEXEL_NET, (64, h), (16, 16), pairs=4, sigma=0.05, seed=SEED, step=1, nearest=False)


@query()
def latent_es_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient of all texel values from 4 antithetic pairs."""
    pixels, texels, h = _cells(spark, sf_dir)
    return TR.latent_es_gradient(pixels, texels, TEXEL_NET, (64, h), (16, 16), pairs=4, sigma=0.05, seed=SEED, step=1)


@query(
    f"""WITH {E_SQL}, c AS (SELECT y // 4 AS ty, x // 4 AS tx, y, x, v FROM e), cur AS (SELECT ty, tx, CAST(greatest(0, least(7, CAST(round((v + 1) * 0.5 * 7) AS INTEGER))) AS INTEGER) AS cur FROM c WHERE y % 4 = 0 AND x % 4 = 0),
l AS (SELECT ty, tx, cur, CAST(k AS INTEGER) AS k, CAST(sum(CAST(round((CAST(v AS DOUBLE) - (-1 + 2 * k / 7.0::DOUBLE)) ** 2 * 1000000) AS BIGINT)) AS BIGINT) AS loss FROM c JOIN cur USING (ty, tx), range(8) t(k) GROUP BY ty, tx, cur, k)
SELECT ty, tx, arg_min(k, struct_pack(l := loss, o := k <> cur, k := k)) AS best, min(loss) AS loss FROM l GROUP BY ty, tx"""
)
def grid_argmin_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of 8 grid values the one with the least error over a 4 x 4 cell; integer losses, ties keep the current value."""
    e = plane_e(spark, sf_dir).select(F.floor(F.col("y") / 4).alias("ty"), F.floor(F.col("x") / 4).alias("tx"), "y", "x", "v")
    current = e.where((F.col("y") % 4 == 0) & (F.col("x") % 4 == 0)).select("ty", "tx", S.fixed_index(F.col("v"), 3).alias("cur"))
    d = F.col("v").cast("double") - (F.lit(-1.0) + 2 * F.col("k") / 7)
    losses = TR.candidates(e.join(current, ["ty", "tx"]), 3).groupBy("ty", "tx", "cur", "k").agg(F.sum(F.round(d * d * 1000000).cast("long")).alias("loss"))
    return TR.argmin_search(losses, ["ty", "tx"], "k", "loss", "cur")


def sensitivity_sql(net: D.Network, out: str) -> str:
    """CTEs, the last of them out(block, gain, code): the probe of input 1 over the vectors of src(vec_id, f)."""
    ctes, last = network_sql(net, f"{out}_in", f"{out}_l")
    return f"""{out}_in AS (SELECT vec_id, k, list_concat([CAST(k AS DOUBLE) / 2 - 1], list_slice(f, 2, len(f))) AS f FROM src, range(5) r(k)), {ctes},
{out}_g AS (SELECT a.vec_id, avg(((b.f[1] - a.f[1]) ** 2 + (b.f[2] - a.f[2]) ** 2 + (b.f[3] - a.f[3]) ** 2) / 3) * (255.0 / 16) ** 2 AS g2 FROM {last} a JOIN {last} b ON a.vec_id = b.vec_id AND b.k = a.k + 1 GROUP BY a.vec_id),
{out}_b AS (SELECT vec_id // 8 AS block, sqrt(avg(g2)) AS gain FROM {out}_g GROUP BY 1),
{out} AS (SELECT block, gain, greatest(0, least(15, CAST(round(log2(greatest(gain, {T.GAIN_FLOOR}) / {T.GAIN_FLOOR}) / 0.6) AS INTEGER))) AS code FROM {out}_b)"""


VECTORS_SQL = "WITH src AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS f FROM embeddings)"


def probe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net_inputs(spark, sf_dir).select(F.floor(F.col("vec_id") / 8).alias("block"), "f")


@query(f"{VECTORS_SQL}, {sensitivity_sql(NET, 'sens')} SELECT block, round(gain, 6) AS gain, code FROM sens")
def sensitivity_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scale code of each block of vectors."""
    out = TR.sensitivity_codes(probe_rows(spark, sf_dir), NET, 0, ["block"])
    return out.select("block", F.round("gain", 6).alias("gain"), "code")


@query(
    f"""WITH rows AS (SELECT label, vec_id AS y, unnest(range(64)) AS x, CAST(unnest(embedding) AS FLOAT) AS v FROM embeddings), rg AS (SELECT label, min(v) AS lo, max(v) AS hi, greatest(CAST(max(v) - min(v) AS FLOAT), CAST(1e-6 AS FLOAT)) AS width FROM rows GROUP BY label),
s AS (SELECT label, y, x, {index_sql(15)} AS k FROM rows JOIN rg USING (label))
SELECT label, dense_rank() OVER (PARTITION BY label ORDER BY y) - 1 AS row, x, CAST(k AS BIGINT) AS k, CAST(count(*) OVER (PARTITION BY label) * 4 + 16 * {D.Network.count((1, 6, 3))} AS BIGINT) AS content_bits FROM s"""
)
def container_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container per label, read back: every symbol, and the content bits."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "v"))
    symbols = Q.quantize_posthoc(rows.select("label", "y", "x", S.f32(F.col("v")).alias("v")), "label", "v", BITS)
    return C.unpack_planes(C.pack_planes(symbols, "label", BITS, D.Network.drawn((1, 6, 3), SEED)), "label")
