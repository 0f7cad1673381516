"""Gradient-free fitting: evolution strategies, finite differences, exact search, and the probe that sets scale codes.

The network and one minibatch are small and bounded by their options; they go to the tasks, which return one number per
perturbation. Planes stay distributed: their perturbations are regenerated from keys wherever they are needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import STREAMS, gauss, noise_gauss, noise_key, noise_u32
from ..functions.scalar import f32, gain_code, uniform_below
from ..functions.tables import N, fixed_grid
from .decode import Network, forward_batch, squared_error
from .filtering import pack_texels, sample_arrays
from .grid import taps
from .metrics import churn
from .tokens import block_bits, truncate_column
from .transform import dequantize, snap_blocks, steps_literal

B1, B2, EPS = 0.9, 0.999, 1e-8


def adam(df: DataFrame, t: int, rate: float, value: str = "z", gradient: str = "g") -> DataFrame:
    """df(value, gradient, m, v) after step ``t`` (from 1) of Adam: column expressions with the bias corrections as literals."""
    g = F.col(gradient)
    m, v = B1 * F.col("m") + (1 - B1) * g, B2 * F.col("v") + (1 - B2) * g * g
    stepped = F.col(value) - rate * (m / (1 - B1**t)) / (F.sqrt(v / (1 - B2**t)) + EPS)
    return df.select(*(c for c in df.columns if c not in (value, "m", "v")), stepped.alias(value), m.alias("m"), v.alias("v"))


def adam_numpy(theta: np.ndarray, g: np.ndarray, m: np.ndarray, v: np.ndarray, t: int, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m, v = B1 * m + (1 - B1) * g, B2 * v + (1 - B2) * g * g
    return theta - rate * (m / (1 - B1**t)) / (np.sqrt(v / (1 - B2**t)) + EPS), m, v


def draw_batch(spark: SparkSession, size: int, pixels: int, seed: int, step: int) -> DataFrame:
    """(s, pixel): pixels drawn with replacement."""
    u = noise_u32(seed, STREAMS["batch_pixel"], step, F.lit(0), F.col("id"))
    return spark.range(size).select(F.col("id").alias("s"), uniform_below(u, pixels).alias("pixel"))


def batch_loss(network: Network, features: np.ndarray, target: np.ndarray, weights: np.ndarray) -> float:
    d = network.run(features) - target
    return float((d * d * weights).sum() / (len(features) * weights.sum()))


def _evaluate(spark: SparkSession, n: int, losses) -> np.ndarray:
    """losses(i) -> (loss up, loss down) for i < n, spread over tasks; n pairs of numbers come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            up, down = zip(*map(losses, ids), strict=True) if ids else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(up, pa.float64()), pa.array(down, pa.float64())], names=["i", "up", "down"])

    rows = spark.range(n).mapInArrow(run, "i long, up double, down double").collect()
    return np.array([(r["up"], r["down"]) for r in sorted(rows)])


def es_gradient(spark: SparkSession, network: Network, features: np.ndarray, target: np.ndarray, weights: np.ndarray, *, pairs: int, sigma: float, seed: int, step: int) -> tuple[np.ndarray, dict]:
    """Gradient of the network's weights from antithetic pairs on one minibatch, and the pairs' statistics."""
    index = np.arange(len(network.weights))

    def losses(i: int) -> tuple[float, float]:
        e = gauss(noise_key(seed, STREAMS["network"], step, i, index))
        return tuple(batch_loss(network.with_weights(network.weights + s * sigma * e), features, target, weights) for s in (1, -1))

    both = _evaluate(spark, pairs, losses)
    dl = both[:, 0] - both[:, 1]
    noise = np.stack([gauss(noise_key(seed, STREAMS["network"], step, i, index)) for i in range(pairs)])
    return dl @ noise / (2 * pairs * sigma), {"loss": float(both.mean()), "spread": float(dl.std())}


def fd_gradient(spark: SparkSession, network: Network, features: np.ndarray, target: np.ndarray, weights: np.ndarray, *, h: float) -> tuple[np.ndarray, dict]:
    """Central differences, one weight at a time, over the step that float32 really takes."""
    w = network.weights.astype(np.float32)

    def moved(i: int, s: float) -> np.ndarray:
        out = w.copy()
        out[i] = np.float32(w[i] + np.float32(s * h))
        return out

    def losses(i: int) -> tuple[float, float]:
        return tuple(batch_loss(network.with_weights(moved(i, s)), features, target, weights) for s in (1, -1))

    both = _evaluate(spark, len(w), losses)
    width = np.array([float(moved(i, 1)[i]) - float(moved(i, -1)[i]) for i in range(len(w))])
    dl = both[:, 0] - both[:, 1]
    return dl / width, {"rms": float(np.sqrt((dl * dl).mean()))}


def latent_es_gradient(pixels: DataFrame, texels: DataFrame, network: Network, image: tuple[int, int], size: tuple[int, int], *, pairs: int, sigma: float, seed: int, step: int, nearest: bool = True) -> DataFrame:
    """(y, x, c, g): gradient of every texel value of a level from perturbing all of them at once, ``pairs`` times.

    pixels(y, x, target array<double>), texels(y, x, c, v). A pixel's loss difference goes to each of the different texels it reads - one, or up to four of a
    bilinear level; texels that no pixel reads get 0. Only samples and differences move: noise is drawn again from its key on either side.
    """
    channels = network.widths[0]
    flat = (F.col("y") * size[0] + F.col("x")) * channels + F.col("c")
    noise = [noise_gauss(seed, STREAMS["latent"], step, F.lit(k), flat) for k in range(pairs)]
    drawn = texels.withColumn("eps", F.array(*noise))
    # Values and noise of a texel as one array, channel by channel: sampling is linear, so the noise is sampled like the value.
    packed = drawn.groupBy("y", "x").agg(F.array_sort(F.collect_list(F.struct("c", "v", "eps"))).alias("s"))
    packed = packed.select("y", "x", F.concat(F.transform("s", lambda s: s["v"].cast("double")), F.flatten(F.transform("s", lambda s: s["eps"]))).alias("v"))

    @F.arrow_udf("array<double>")
    def differences(sampled: pa.Array, target: pa.Array) -> pa.Array:
        both = sampled.flatten().to_numpy(zero_copy_only=False).reshape(-1, channels * (1 + pairs))
        z0, e0 = both[:, :channels], both[:, channels:].reshape(len(both), channels, pairs)
        t0 = target.flatten().to_numpy(zero_copy_only=False).reshape(len(z0), -1)
        out = np.empty((len(z0), pairs))
        for k in range(pairs):
            up, down = (((network.run(z0 + s * sigma * e0[:, :, k]) - t0) ** 2).sum(axis=1) for s in (1, -1))
            out[:, k] = up - down
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, pairs), pa.int32()), pa.array(out.reshape(-1)))

    per_pixel = sample_arrays(pixels, packed, image, size, nearest).select("y", "x", differences("s", "target").alias("d"))
    tx, ty = taps(F.col("x"), image[0], size[0], nearest), taps(F.col("y"), image[1], size[1], nearest)
    read = F.array_distinct(F.array(*(F.struct(b.cast("long").alias("ty"), a.cast("long").alias("tx")) for a in (tx["lo"], tx["hi"]) for b in (ty["lo"], ty["hi"]))))
    summed = per_pixel.select(F.explode(read).alias("t"), "d").groupBy("t.ty", "t.tx").agg(*(F.sum(F.get("d", F.lit(k))).alias(f"d{k}") for k in range(pairs)))
    n_out = network.widths[-1]
    scale = 1.0 / (2 * pairs * sigma * n_out * image[0] * image[1])
    joined = drawn.join(summed, (drawn["y"] == summed["ty"]) & (drawn["x"] == summed["tx"]), "left")
    g = sum((F.coalesce(F.col(f"d{k}"), F.lit(0.0)) * F.get("eps", F.lit(k)) for k in range(pairs)), F.lit(0.0)) * scale
    return joined.select(drawn["y"], drawn["x"], drawn["c"], g.alias("g"))


def perturbed_bits(plane: DataFrame, sign: int, sigma: float, steps: list[int], dc_step: int, deadzone: bool, lam16: float = 0.0, weight16: int = 16) -> DataFrame:
    """(by, bx, bits16) of the blocks of plane(y, x, v, eps): proxy bits of the shadow v moved by sign x sigma x eps, snapped and truncated."""
    moved = plane.withColumn("m", f32(F.col("v") + sign * f32(f32(sigma) * f32(F.col("eps")))))
    blocks = snap_blocks(moved, steps, dc_step, deadzone, "m")
    if lam16:
        value = dequantize(F.col("sym"), steps_literal(steps), dc_step, deadzone)
        blocks = blocks.withColumn("sym", truncate_column(F.col("coef"), F.col("sym"), value, lam16, weight16))
    return block_bits(blocks, ["by", "bx"], weight16)


def rate_pass(plane: DataFrame, sigma: float, steps: list[int], dc_step: int, deadzone: bool, lam: float, pairs: int, lam16: float = 0.0, weight16: int = 16) -> DataFrame:
    """(y, x, dbits, g): the rate's share of one pair in the gradient of plane(y, x, v, eps), whole blocks.

    How the proxy bits of a block differ between the two sides of the pair goes to its 64 texels, each times its own noise; dbits is in 1/16 bit.
    """
    up, down = (perturbed_bits(plane, s, sigma, steps, dc_step, deadzone, lam16, weight16).withColumnRenamed("bits16", n) for s, n in ((1, "up"), (-1, "down")))
    both = up.join(down, ["by", "bx"]).select("by", "bx", (F.col("up") - F.col("down")).alias("dbits"))
    n = plane.count()
    scale = lam / (16 * 65025.0 * n) / (2 * pairs * sigma)
    at = plane.select("y", "x", "eps", F.floor(F.col("y") / N).cast("int").alias("by"), F.floor(F.col("x") / N).cast("int").alias("bx"))
    return at.join(both, ["by", "bx"]).select("y", "x", "dbits", (F.col("dbits") * F.lit(scale) * F.col("eps")).alias("g"))


def _with(values: Column, place: int, value: Column) -> Column:
    """An array with one of its values changed."""
    return F.transform(values, lambda v, i: F.when(i == place, value).otherwise(v))


def search_level(pixels: DataFrame, texels: DataFrame, network: Network, image: tuple[int, int], size: tuple[int, int], bits: list[int], weights: list[float], write=None) -> DataFrame:
    """texels(y, x, c, k) after exact coordinate descent: channel by channel, each texel takes the grid value of least weighted error over its pixels.

    pixels(y, x, target array<double>) read their texel by the nearest tap; inputs of the network beyond the level's channels follow as ``rest`` (array), if there is such a
    column. Ties keep the current value, texels without pixels stay. A channel is one explode, one partial sum and one argmin; texels are independent, so nothing is
    collected. ``write`` stores a DataFrame and reads it back between channels.
    """
    write = write or (lambda df: df.checkpoint())
    rest = F.col("rest") if "rest" in pixels.columns else F.array().cast("array<double>")
    tx, ty = taps(F.col("x"), image[0], size[0], True)["lo"], taps(F.col("y"), image[1], size[1], True)["lo"]
    asked = pixels.select(tx.alias("tx"), ty.alias("ty"), "target", rest.alias("rest"))
    now = pack_texels(texels.select("y", "x", "c", F.col("k").alias("v"))).select(F.col("x").cast("int").alias("tx"), F.col("y").cast("int").alias("ty"), F.col("v").alias("ks"))
    values = F.array(*(F.array(*(F.lit(float(v)) for v in fixed_grid(b))) for b in bits))
    for c in range(len(bits)):
        tried = candidates(asked.join(now, ["tx", "ty"]), bits[c])
        inputs = F.transform(_with(F.col("ks"), c, F.col("k")), lambda k, i: F.get(F.get(values, i), k))
        out = forward_batch(network, F.concat(inputs, F.col("rest")))
        losses = tried.select("ty", "tx", "k", F.get("ks", F.lit(c)).alias("cur"), squared_error(out, F.col("target"), weights).alias("e")).groupBy("ty", "tx", "k", "cur").agg(F.sum("e").alias("loss"))
        best = argmin_search(losses, ["ty", "tx"], "k", "loss", "cur").select("ty", "tx", "best")
        patched = _with(F.col("ks"), c, F.coalesce("best", F.get("ks", F.lit(c))))
        now = write(now.join(best, ["ty", "tx"], "left").select("tx", "ty", patched.alias("ks")))
    return now.select(F.col("ty").alias("y"), F.col("tx").alias("x"), F.posexplode("ks").alias("c", "k"))


def argmin_search(losses: DataFrame, keys: list[str], candidate: str, loss: str, current: str) -> DataFrame:
    """(keys.., best, loss): the candidate of least loss; a tie keeps the current one, then takes the smallest."""
    pick = F.min(F.struct(F.col(loss).alias("loss"), (F.col(candidate) != F.col(current)).alias("other"), F.col(candidate).alias("k")))
    return losses.groupBy(*keys).agg(pick.alias("p")).select(*keys, F.col("p.k").alias("best"), F.col("p.loss").alias("loss"))


def candidates(df: DataFrame, bits: int) -> DataFrame:
    """df with each grid index k: at most 256 rows for one."""
    return df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit((1 << bits) - 1))))


def sensitivity_codes(samples: DataFrame, network: Network, channel: int, keys: list[str]) -> DataFrame:
    """(keys.., gain, code) from samples(keys.., f array<double>): how much the output moves when one input is swept over -1..1.

    The input takes 5 values; the root mean square over the 4 steps and all samples of a block is its gain in 8-bit units, and its
    logarithm the code.
    """
    values = [-1.0, -0.5, 0.0, 0.5, 1.0]

    @F.arrow_udf("double")
    def squared_gain(f: pa.Array) -> pa.Array:
        x = f.flatten().to_numpy(zero_copy_only=False).reshape(-1, network.widths[0]).astype(np.float64)
        outs = []
        for v in values:
            x[:, channel] = v
            outs.append(network.run(x))
        steps = np.diff(np.stack(outs), axis=0)
        return pa.array((255 / 16) ** 2 * (steps**2).mean(axis=2).mean(axis=0))

    gain = F.sqrt(F.avg("g2"))
    return samples.select(*keys, squared_gain(F.col("f")).alias("g2")).groupBy(*keys).agg(gain.alias("gain")).withColumn("code", gain_code(F.col("gain")))


def refit_codes(samples: DataFrame, network: Network, channel: int, keys: list[str], held: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """The probe again, against the codes held(keys.., group.., code): (new codes, how many moved by one or more and by two or more in each group)."""
    fresh = sensitivity_codes(samples, network, channel, keys)
    return fresh, churn(held.select(*keys, *group, "code"), fresh.select(*keys, "code"), keys, group)


def refit_due(step: int, steps: int, start: int, every: int, until: int, live: bool = True) -> bool:
    """Whether scale codes are fitted again before this step: at multiples of the interval, from after the start up to the end of refitting."""
    return live and every > 0 and 0 < step < steps and step != start and step <= until and step % every == 0


def anneal(step: int, steps: int, start: float, final: float) -> float:
    """Rate multiplier: 1 up to a fraction ``start`` of the run, then linear down to ``final`` at its end."""
    t = step / steps
    if t <= start or start >= 1:
        return 1.0
    return 1 + (final - 1) * min(1.0, (t - start) / (1 - start))


def rate_recipe(quality_scales: list[float]) -> float:
    """The truncation weight that goes with the least compressed channel, at most 0.5."""
    return min(0.5, 7.5 * min(s * s for s in quality_scales))


def pull_shadow(df: DataFrame, share: float, shadow: str = "z", snapped: str = "zq") -> DataFrame:
    """The shadow moved by a share of its way to the snapped value; all of it with 1."""
    return df.withColumn(shadow, F.col(shadow) + share * (F.col(snapped) - F.col(shadow)))


def fit_plane(pixels: DataFrame, texels: DataFrame, network: Network, image: tuple[int, int], size: tuple[int, int], *, steps: int, rate: float, pairs: int = 4, sigma: float = 0.05, seed: int = 1, write=None) -> DataFrame:
    """texels (y, x, c, v) after some steps of latent evolution strategy and Adam.

    ``write`` stores a DataFrame and reads it back (as the shared folder's tables do); it cuts the lineage after every step.
    """
    write = write or (lambda df: df.checkpoint())
    state = texels.select("y", "x", "c", F.col("v").cast("double").alias("v"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))
    for t in range(1, steps + 1):
        g = latent_es_gradient(pixels, state.select("y", "x", "c", "v"), network, image, size, pairs=pairs, sigma=sigma, seed=seed, step=t)
        moved = adam(state.join(g, ["y", "x", "c"]).select("y", "x", "c", F.col("v").alias("z"), "g", "m", F.col("s").alias("v")), t, rate)
        state = write(moved.select("y", "x", "c", F.col("z").alias("v"), "m", F.col("v").alias("s")))
    return state.select("y", "x", "c", "v")


def mean_gain(df: DataFrame, channel: str, gain: str) -> DataFrame:
    return df.groupBy(channel).agg(F.avg(gain).alias("gain"))


