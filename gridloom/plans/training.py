"""Queries of fitting, refreshing and accounting, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import scalar as S
from ..operators import decode as D
from ..operators import grid as G
from ..operators import metrics as M
from ..operators import quant as Q
from ..operators import rate as R
from ..operators import train as TR
from ..operators import transform as X
from ..sources import container as C
from .codec import BITS, COST_SQL, DC_STEP, E_SQL, NET, PADDED_SQL, RECON_SQL, SEED, STEPS, SYM_SQL, TOKEN_SQL, VECTORS_SQL, ZZ_SQL, T, _coarse, index_sql, network_sql, padded_e, plane_e, probe_rows, query, sensitivity_sql, symbols_e, table, value_sql

OTHER_NET = D.Network.drawn((64, 6, 3), SEED + 1)


@query(f"{VECTORS_SQL}, {sensitivity_sql(NET, 'sens')} SELECT block % 4 AS channel, round(avg(gain), 6) AS gain FROM sens GROUP BY 1")
def mean_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean gain of the blocks of each of four channels."""
    codes = TR.sensitivity_codes(probe_rows(spark, sf_dir), NET, 0, ["block"]).withColumn("channel", F.col("block") % 4)
    return TR.mean_gain(codes, "channel", "gain").select("channel", F.round("gain", 6).alias("gain"))


@query(f"{VECTORS_SQL}, {sensitivity_sql(NET, 'sens')}, {sensitivity_sql(OTHER_NET, 'again')} SELECT block % 4 AS channel, count(*) FILTER (WHERE abs(again.code - sens.code) >= 1) AS moved1, count(*) FILTER (WHERE abs(again.code - sens.code) >= 2) AS moved2 FROM sens JOIN again USING (block) GROUP BY 1")
def refit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes from one network probed again with another, and how many moved in each channel."""
    rows = probe_rows(spark, sf_dir)
    held = TR.sensitivity_codes(rows, NET, 0, ["block"]).withColumn("channel", F.col("block") % 4)
    return TR.refit_codes(rows, OTHER_NET, 0, ["block"], held, ["channel"])[1]


@query("SELECT round(avg(value - event_id % 7), 6) AS mean, round(stddev_pop(value - event_id % 7), 6) AS sd, round(avg(value), 6) AS loss FROM events")
def pair_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and spread of pair differences, and the mean loss."""
    out = M.pair_moments(table(spark, sf_dir, "events").select((F.col("value") - F.col("event_id") % 7).alias("dl"), F.col("value").alias("lsum")))
    return out.select(*(F.round(c, 6).alias(c) for c in ("mean", "sd", "loss")))


@query(f"WITH {E_SQL} SELECT round(sqrt(avg(CAST(v AS DOUBLE) * CAST(v AS DOUBLE))), 6) AS rms FROM e")
def gradient_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D22."""
    return M.gradient_rms(plane_e(spark, sf_dir).withColumn("v", F.col("v").cast("double")), "v").select(F.round("rms", 6).alias("rms"))


@query(f"{SYM_SQL} SELECT count(*) FILTER (WHERE (k * 7 + x) % 16 > k) AS worse, count(*) FILTER (WHERE (k * 7 + x) % 16 < k) AS better, count(*) FILTER (WHERE (k * 7 + x) % 16 = k) AS ties FROM q")
def search_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two results of a search, texel by texel."""
    s = symbols_e(spark, sf_dir).select("y", "x", F.col("k").alias("loss"))
    return M.compare_losses(s, s.withColumn("loss", (F.col("loss") * 7 + F.col("x")) % 16), ["y", "x"])


@query(f"{SYM_SQL} SELECT y, x, CAST(v AS DOUBLE) + 0.25 * (CAST(q AS DOUBLE) - CAST(v AS DOUBLE)) AS z FROM q")
def shadow_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I16: a quarter of the way from the shadow to the snapped value."""
    rows = symbols_e(spark, sf_dir).select("y", F.col("x").cast("long").alias("x"), F.col("v").cast("double").alias("z"), F.col("q").cast("double").alias("zq"))
    return TR.pull_shadow(rows, 0.25).select("y", "x", "z")


FROZEN = {0: 8, 1: 4}


def frozen_sql(level: int, bits: int) -> str:
    n = (1 << bits) - 1
    return f"SELECT l, c, y, x, v AS z, {value_sql(n)} AS zq, {value_sql(n)} <> v AS moved FROM (SELECT *, {index_sql(n, 'even')} AS k FROM lv JOIN rg USING (l, c) WHERE l = {level})"


@query(
    f"""WITH lv AS (SELECT label AS l, vec_id AS y, i // 2 AS x, i % 2 AS c, v FROM (SELECT label, vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS FLOAT) AS v FROM embeddings)),
rg AS (SELECT l, c, min(v) AS lo, max(v) AS hi, greatest(CAST(max(v) - min(v) AS FLOAT), CAST(1e-6 AS FLOAT)) AS width FROM lv GROUP BY l, c)
{' UNION ALL '.join(frozen_sql(l, b) for l, b in FROZEN.items())} UNION ALL SELECT l, c, y, x, v, v, false FROM lv WHERE l NOT IN ({', '.join(map(str, FROZEN))})"""
)
def freeze_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of two levels frozen from what they hold, their decoded copies snapped, the other levels copied. A level is a label here."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("l"), F.col("vec_id").alias("y"), F.posexplode("embedding").alias("i", "v"))
    levels = rows.select("l", (F.col("i") % 2).cast("long").alias("c"), "y", F.floor(F.col("i") / 2).alias("x"), S.f32(F.col("v")).alias("v"))
    return Q.fit_all(levels, FROZEN)[1]


SIGMA, LAMBDA, PAIRS = 0.05, 0.5, 2
EPS_SQL = "CAST((x * 7 + y * 13) % 5 - 2 AS FLOAT)"


def moved_bits_sql(plane: str) -> str:
    """The proxy bits of another plane's blocks, as a query of its own."""
    return f"{TOKEN_SQL.replace('FROM pad)', f'FROM {plane})')}, {COST_SQL} SELECT * FROM bits"


@query(
    f"""WITH {E_SQL}, {PADDED_SQL}, ep AS (SELECT y, x, v, {EPS_SQL} AS eps FROM pad), mu AS (SELECT y, x, CAST(v + CAST(CAST({SIGMA} AS FLOAT) * eps AS FLOAT) AS FLOAT) AS v FROM ep), md AS (SELECT y, x, CAST(v - CAST(CAST({SIGMA} AS FLOAT) * eps AS FLOAT) AS FLOAT) AS v FROM ep),
up AS ({moved_bits_sql('mu')}), dn AS ({moved_bits_sql('md')}), db AS (SELECT up."by" AS yb, up.bx AS bx, up.bits16 - dn.bits16 AS d FROM up JOIN dn ON up."by" = dn."by" AND up.bx = dn.bx)
SELECT y, x, d AS dbits, round(d * ({LAMBDA} / (16 * 65025.0::DOUBLE * (SELECT count(*) FROM ep)) / (2 * {PAIRS} * {SIGMA})) * CAST(eps AS DOUBLE) * 1e9, 6) + 0.0 AS g FROM ep JOIN db ON yb = y // 8 AND bx = x // 8"""
)
def rate_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the bits of each block change with a perturbation, given to its texels; in units of 1e-9. The noise is a small whole number here."""
    plane = padded_e(spark, sf_dir).withColumn("eps", ((F.col("x") * 7 + F.col("y") * 13) % 5 - 2).cast("float"))
    out = TR.rate_pass(plane, SIGMA, STEPS, DC_STEP, True, LAMBDA, PAIRS, weight16=4)
    return out.select("y", F.col("x").cast("long").alias("x"), "dbits", F.round(F.col("g") * 1e9, 6).alias("g"))


SEARCH_NET = D.Network.drawn((3, 6, 3), SEED)
SEARCH_BITS = [2, 3]


def grid_sql(bits: int, k: str) -> str:
    n = (1 << bits) - 1
    return f"CAST(CAST(CAST(-1 AS FLOAT) + CAST(CAST(2 * {k} AS DOUBLE) / {n} AS FLOAT) AS FLOAT) AS DOUBLE)"


def fixed_sql(bits: int, v: str) -> str:
    n = (1 << bits) - 1
    return f"CAST(greatest(0, least({n}, CAST(round(CAST(CAST(CAST({v} + CAST(1 AS FLOAT) AS FLOAT) * CAST(0.5 AS FLOAT) AS FLOAT) * CAST({n} AS FLOAT) AS FLOAT)) AS INTEGER))) AS INTEGER)"


def search_sql(channel: int, first: str, second: str, name: str) -> str:
    """CTEs ending in name(ty, tx, best): the grid value of one channel with the least error; ``first`` and ``second`` are the indices of both."""
    ctes, last = network_sql(SEARCH_NET, f"{name}_in", f"{name}_l")
    cur = second if channel else first
    tried = [grid_sql(b, "j" if c == channel else i) for c, (b, i) in enumerate(zip(SEARCH_BITS, (first, second), strict=True))]
    return f"""{name}_in AS (SELECT ty, tx, CAST(j AS INTEGER) AS j, {cur} AS cur, t, [{', '.join(tried)}, CAST(x AS DOUBLE) / 64] AS f FROM px JOIN now_{channel} USING (ty, tx), range({1 << SEARCH_BITS[channel]}) r(j)), {ctes},
{name}_s AS (SELECT ty, tx, j, cur, sum((f[1] - t - 0.5) ** 2 + 0.5 * (f[2] - 0.5 + t) ** 2 + 2 * (f[3] - t / 2 - 0.5) ** 2) AS loss FROM {last} GROUP BY ty, tx, j, cur),
{name} AS (SELECT ty, tx, arg_min(j, struct_pack(l := loss, o := j <> cur, j := j)) AS best FROM {name}_s GROUP BY ty, tx)"""


def cell_sql(p: str, n: str) -> str:
    return f"greatest(0, least(15, CAST(floor(CAST(CAST(CAST(CAST({p} AS FLOAT) + CAST(0.5 AS FLOAT) AS FLOAT) AS DOUBLE) / {n} AS FLOAT) * CAST(16 AS FLOAT)) AS INTEGER)))"


@query(
    f"""WITH {E_SQL}, hh AS (SELECT count(*) AS h FROM embeddings), c AS (SELECT y * 16 // h AS ty, x // 4 AS tx, max(v) AS v FROM e, hh GROUP BY 1, 2),
px AS (SELECT y, x, CAST(v AS DOUBLE) AS t, {cell_sql('x', '64')} AS tx, {cell_sql('y', 'h')} AS ty FROM e, hh),
now_0 AS (SELECT ty, tx, {fixed_sql(2, 'v')} AS k0, {fixed_sql(3, '-v')} AS k1 FROM c), {search_sql(0, 'k0', 'k1', 'sa')},
now_1 AS (SELECT ty, tx, coalesce(best, k0) AS k0, k1 FROM now_0 LEFT JOIN sa USING (ty, tx)), {search_sql(1, 'k0', 'k1', 'sb')}
SELECT CAST(ty AS INTEGER) AS y, CAST(tx AS INTEGER) AS x, CAST(c AS INTEGER) AS c, CASE WHEN c = 0 THEN k0 ELSE coalesce(best, k1) END AS k FROM now_1 LEFT JOIN sb USING (ty, tx), range(2) r(c)"""
)
def search_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact coordinate descent on a level of two channels of 2 and 3 bits, with the network inside; the place is a third input."""
    h = table(spark, sf_dir, "embeddings").count()
    v = F.col("v").cast("double")
    pixels = plane_e(spark, sf_dir).select("y", "x", F.array(v + 0.5, 0.5 - v, v / 2 + 0.5).alias("target"), F.array(F.col("x") / 64.0).alias("rest"))
    texels = _coarse(spark, sf_dir).select("y", "x", F.explode(F.array(F.struct(F.lit(0).alias("c"), S.fixed_index(F.col("v"), 2).alias("k")), F.struct(F.lit(1).alias("c"), S.fixed_index(-F.col("v"), 3).alias("k")))).alias("s")).select("y", "x", "s.*")
    return TR.search_level(pixels, texels, SEARCH_NET, (64, h), (16, 16), SEARCH_BITS, [1.0, 0.5, 2.0], write=lambda df: df)


@query(
    f"""{RECON_SQL}, zp AS (SELECT "by", bx, CAST(list_position({ZZ_SQL}, i) - 1 AS INTEGER) AS p, q FROM qs),
b AS (SELECT "by", bx, count(*) FILTER (WHERE q <> 0 AND p > 0) AS nz, coalesce(max(p) FILTER (WHERE q <> 0 AND p > 0), 0) AS lnz FROM zp GROUP BY "by", bx), cl AS (SELECT bx // 4 AS c, count(*) FILTER (WHERE raw < -1 OR raw > 1) AS clamped FROM rec GROUP BY 1)
SELECT bx // 4 AS c, count(*) AS blocks, CAST(sum(nz) AS BIGINT) AS nonzeros, count(*) FILTER (WHERE nz = 0) AS dc_only, max(cl.clamped) AS clamped, count(*) FILTER (WHERE lnz < 63) AS ends, CAST(sum(lnz) FILTER (WHERE nz > 0) AS BIGINT) AS last_sum,
CAST(count(*) * {T.dc_raw_bits(DC_STEP)} + 16 * sum(nz) + 7 * count(*) FILTER (WHERE lnz < 63) + 4 * count(*) AS BIGINT) AS raw_bits FROM b JOIN cl ON cl.c = bx // 4 GROUP BY bx // 4"""
)
def channel_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of each channel alone; the halves of plane E are two channels."""
    plane = padded_e(spark, sf_dir).select(F.floor(F.col("x") / 32).alias("c"), "y", "x", "v")
    return X.recon_statistics(X.snap_blocks(plane, STEPS, DC_STEP, True, keys=["c"]), T.dc_raw_bits(DC_STEP), ["c"])


LEVELS_SQL = "WITH lv AS (SELECT label AS l, 64 AS w, count(*) AS h, 1 AS c, 4 AS bits FROM embeddings GROUP BY label)"


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("l")).agg(F.count(F.lit(1)).alias("h")).select("l", F.lit(64).alias("w"), "h", F.lit(1).alias("c"), F.lit(4).alias("bits"))


@query(f"{LEVELS_SQL} SELECT l, w, h, c, bits, w * h * c AS size, CAST(coalesce(sum(w * h * c) OVER (ORDER BY l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM lv")
def level_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each level begins in one flat vector."""
    return G.level_offsets(_levels(spark, sf_dir))


@query(f"{LEVELS_SQL} SELECT CAST(sum(w * h * c * bits) AS BIGINT) AS latent_bits, CAST(sum(c * 64) AS BIGINT) AS header_bits, CAST({16 * len(NET.weights)} AS BIGINT) AS network_bits, CAST({NET.multiplications} AS BIGINT) AS macs, CAST(sum(1 << bits) AS BIGINT) AS decodes FROM lv")
def level_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw bits, multiplications of a sample, and decodes of a search over every level's grid."""
    levels = _levels(spark, sf_dir)
    decodes = levels.agg(F.sum(Q.candidate_decodes(F.array("bits"))).alias("decodes"))
    return R.raw_accounting(levels, len(NET.weights)).select("*", F.lit(NET.multiplications).cast("long").alias("macs")).join(decodes)


@query(f"{LEVELS_SQL} SELECT l, (l = 0 AND (l % 2 = 0 OR l % 3 = 1)) OR (l // 4) > 0 AS discrete, NOT (l = 0) AS active FROM lv")
def level_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which levels are on a grid of their own, and which take part in random search when level 0 is searched."""
    levels = _levels(spark, sf_dir).select("l", (F.col("l") % 2 == 0).alias("fixed"), F.floor(F.col("l") / 4).alias("frozen_bits"), (F.col("l") % 3 == 1).alias("dct"))
    active = Q.active_levels(levels, True).select("l", F.lit(True).alias("on"))
    return Q.already_discrete(levels).join(active, "l", "left").select("l", "discrete", F.coalesce("on", F.lit(False)).alias("active"))


HALF_SQL = "CAST(round_even(CAST(v AS DOUBLE) / pow(2, greatest(floor(log2(abs(CAST(v AS DOUBLE)))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(CAST(v AS DOUBLE)))), -14) - 10) AS FLOAT)"


@query(f"WITH {E_SQL} SELECT y, x, CASE WHEN v = 0 THEN v ELSE {HALF_SQL} END AS half FROM e")
def half_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plane E through half floats."""
    return plane_e(spark, sf_dir).select("y", F.col("x").cast("long").alias("x"), B.half_column(F.col("v")).alias("half"))


@query("SELECT DISTINCT label AS level, vec_id % 4 AS channel, CAST((43 + label * 13 + (vec_id % 4) * 7) & 63 AS BIGINT) AS sync FROM embeddings")
def sync_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marker of each level and channel."""
    at = table(spark, sf_dir, "embeddings").select(F.col("label").alias("level"), (F.col("vec_id") % 4).alias("channel")).distinct()
    return at.select("level", "channel", S.sync_value(C.SYNC["level"], F.col("level"), F.col("channel")).cast("long").alias("sync"))


@query("SELECT event_id, isfinite(CASE WHEN event_id % 3 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 3 = 1 THEN CAST('NaN' AS DOUBLE) ELSE value END) AS finite FROM events")
def finite_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9."""
    v = F.when(F.col("event_id") % 3 == 0, F.lit(float("inf"))).when(F.col("event_id") % 3 == 1, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", S.finite(v).alias("finite"))


@query("SELECT label, array_to_string(list_transform(range(1, 1 + CAST(count(*) AS BIGINT)), lambda i: CAST(i AS VARCHAR)), ',') AS spec FROM embeddings GROUP BY label")
def list_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list option as text, and back."""
    n = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.sequence(F.lit(1).cast("long"), F.count(F.lit(1))).alias("v"))
    text = n.select("label", S.list_text(F.col("v")).alias("spec"))
    return text.select("label", S.list_text(F.transform(F.split("spec", ","), lambda p: p.cast("int"))).alias("spec"))


@query(f"SELECT label, CAST(count(*) * 64 * {BITS} + {16 * D.Network.count((1, 6, 3))} AS BIGINT) AS a_bits, CAST(count(*) * 64 * {BITS} + {16 * D.Network.count((1, 6, 3))} AS BIGINT) AS b_bits, true AS equal FROM embeddings GROUP BY label")
def rate_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content bits as the containers have them, against those of the symbols."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "v"))
    symbols = Q.quantize_posthoc(rows.select("label", "y", "x", S.f32(F.col("v")).alias("v")), "label", "v", BITS)
    network = D.Network.drawn((1, 6, 3), SEED)
    stored = C.pack_planes(symbols, "label", BITS, network).select("label", F.col("content_bits").alias("bits"))
    counted = symbols.groupBy("label").agg((F.count(F.lit(1)) * BITS + 16 * len(network.weights)).alias("bits"))
    return R.reconcile(stored, counted, ["label"])
