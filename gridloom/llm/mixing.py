"""Mixing sources to target weights with soft membership, in DataFrame functions only.

A classifier learnt from a labelled table gives each document a posterior over domains: hashed-word likelihoods per domain,
averaged over the document's words and sharpened, times the domain's prior. The expected tokens of a domain are then
sum(rate x tokens x posterior), and document rates >= 0 (how often a document is to be used) are fitted so that the expected
totals match the targets: projected gradient on the weighted least squares

    1/2 (T - target)' G^-1 (T - target),  G = sum_i tokens_i p_i p_i',     in the norm sum_i tokens_i dr_i^2,

which makes a step r_i <- max(0, r_i - p_i' G^-1 (T - target)) with no step length to choose: with G (one small matrix, summed
once over all documents) as weights the gradient's Lipschitz constant is 1, and the first step would already solve the problem
without the bound at 0. An iteration is one distributed sum per domain over a narrow table; the driver holds the residuals (one number per domain) and the rates are an expression over their history, so
nothing is rewritten and a lost executor recomputes its part.

A step shrinks that norm, not always the largest gap, and many small ones may be needed. So where steps stop paying the fit goes on by
Newton steps on the same problem's dual, one multiplier per domain: r_i = max(0, base_i - p_i' m), the rates nearest to a base that is
moved now and then (the proximal point method). It ends when the totals are met, or when the duality gap proves that they are within the
tolerance of the nearest totals that rates >= 0 can reach; what is then missing is reported by a warning.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, table

BUCKETS = 1 << 16
SHARPNESS = 12.0
#: Rates are written out after so many steps, which bounds the size of their expression.
STEPS_AT_ONCE = 16
#: Plain steps before Newton steps, and Newton steps after which rounding, not the problem, must be what is in the way; invented hard cases took 31.
PLAIN_STEPS, NEWTON_STEPS = 64, 200


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _labelled_sample(labelled: DataFrame, domains: list[str], max_labelled: int) -> DataFrame:
    """At most ``max_labelled`` rows (id, domain), those whose ids hash lowest; all if there are no more."""
    usable = labelled.where(F.col("domain").isin(domains) & F.col("id").isNotNull()).withColumn("h", F.shiftrightunsigned(F.xxhash64("id"), 34))
    n = usable.count()
    near = 1 << 30 if n <= max_labelled else min(1 << 30, int((1 << 30) * 1.2 * max_labelled / n) + 1)
    return materialize(usable.where(F.col("h") < near).orderBy("h", "id", "domain").limit(max_labelled).select("id", "domain"), "labelled")


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], *, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 20_000) -> DataFrame:
    """(id, hash long, n_tokens long, p_0 .. p_k doubles): words and domain posteriors of each document; ``labelled`` has columns id and domain."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    sample = _labelled_sample(labelled, domains, max_labelled)
    # The sample has at most max_labelled narrow rows, so it may be broadcast.
    seen = rows.join(F.broadcast(sample.withColumnRenamed("id", "of")), F.col("id") == F.col("of")).select("domain", F.explode(_words(F.col("text"))).alias("w")).select("domain", _bucket(F.col("w")).alias("b"))
    counted = materialize(seen.groupBy("b").agg(*(F.count_if(F.col("domain") == d).alias(f"c_{k}") for k, d in enumerate(domains))), "word-counts")
    totals = counted.agg(*(F.coalesce(F.sum(f"c_{k}"), F.lit(0)).alias(f"t_{k}") for k in range(len(domains)))).first()
    priors = sample.agg(*(F.count_if(F.col("domain") == d).alias(f"n_{k}") for k, d in enumerate(domains))).first()
    n_labelled = sum(priors) + len(domains)
    model = counted.select("b", *(F.log((F.col(f"c_{k}") + 1) / F.lit(float(totals[k] + BUCKETS))).alias(f"l_{k}") for k in range(len(domains))))  # BUCKETS rows at most
    unseen = [F.log(F.lit(1.0 / (totals[k] + BUCKETS))) for k in range(len(domains))]
    words = rows.select("id", "hash", F.explode(_words(F.col("text"))).alias("w")).select("id", "hash", _bucket(F.col("w")).alias("b"))
    told = words.join(F.broadcast(model), "b", "left").groupBy("id", "hash").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.coalesce(f"l_{k}", unseen[k])).alias(f"s_{k}") for k in range(len(domains))))
    told = materialize(told.select(F.col("id").alias("i"), F.col("hash").alias("h"), "n", *(f"s_{k}" for k in range(len(domains)))), "likelihoods")
    base = rows.select("id", "hash")
    # Rows that repeat an id and text were summed together; the average is the same, the count is shared out.
    same = materialize(base.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select(F.col("id").alias("ci"), F.col("hash").alias("ch"), "copies"), "repeated-rows")
    joined = base.join(told, F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")), "left").join(same, F.col("id").eqNullSafe(F.col("ci")) & (F.col("hash") == F.col("ch")), "left")
    z = [F.log(F.lit(float(priors[k] + 1) / n_labelled)) + F.coalesce(SHARPNESS * F.col(f"s_{k}") / F.col("n"), F.lit(0.0)) for k in range(len(domains))]
    top = F.greatest(*z) if len(z) > 1 else z[0]
    e = [F.exp(x - top) for x in z]
    total = reduce(lambda a, b: a + b, e)
    out = joined.select("id", "hash", F.coalesce(F.round(F.col("n") / F.coalesce("copies", F.lit(1))).cast("long"), F.lit(0).cast("long")).alias("n_tokens"), *(F.round(x / total, 6).alias(f"p_{k}") for k, x in enumerate(e)))
    return materialize(out, "posteriors")


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """A small symmetric system, by elimination."""
    rows = [[*r, b] for r, b in zip(matrix, right, strict=True)]
    n = len(rows)
    for i in range(n):
        top = max(range(i, n), key=lambda j: abs(rows[j][i]))
        rows[i], rows[top] = rows[top], rows[i]
        for j in range(n):
            if j != i:
                f = rows[j][i] / rows[i][i]
                rows[j] = [x - f * y for x, y in zip(rows[j], rows[i], strict=True)]
    return [r[n] / r[i] for i, r in enumerate(rows)]


def _dot(a: list[float], b: list[float]) -> float:
    return sum(x * y for x, y in zip(a, b, strict=True))


def _newton(now: DataFrame, gram: list[list[float]], target: list[float], near: float, most: int) -> tuple[DataFrame, list[float]]:
    """(rates, totals) from the rates of ``now`` on, until totals are within ``near`` of the target, or proved to be of the nearest ones in reach."""
    k = len(target)
    p, n = [F.col(f"p_{i}") for i in range(k)], F.col("n_tokens")
    times = lambda v: [_dot(row, v) for row in gram]
    along = lambda v: reduce(lambda a, b: a + b, (p[i] * F.lit(v[i]) for i in range(k)))
    above = lambda v: F.greatest(F.lit(0.0), F.col("rate") - along(v))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    base, m, weight, steps = materialize(now, "rates"), [0.0] * k, 1e-2, 0
    while True:
        r = above(m)
        sums = base.agg(*(total(n * p[i] * r) for i in range(k)), *(total(F.when(r > 0, n * p[i] * p[j]).otherwise(0.0)) for i in range(k) for j in range(k))).first()
        have, free = list(sums[:k]), sums[k:]
        miss = [h - t for h, t in zip(have, target, strict=True)]
        y = _solve(gram, miss)
        # d: what no document pulls against, so that d'T >= 0 for all totals T in reach, and the dual value at its best multiple bounds the optimum.
        least = base.where(n > 0).agg(F.min(along(y) / reduce(lambda a, b: a + b, p))).first()[0]
        d = [v - least for v in y]
        slope = min(0.0, _dot(target, d))
        dual = slope * slope / (2 * _dot(d, times(d))) if slope else 0.0
        off = (max(0.0, 2 * (_dot(miss, y) / 2 - dual)) * max(gram[i][i] for i in range(k))) ** 0.5
        if max(map(abs, miss)) <= near or off <= near or steps >= most:
            return base.withColumn("rate", r), have
        left = [x - weight * g for x, g in zip(miss, times(m), strict=True)]
        if _dot(left, _solve(gram, left)) <= 0.25 * weight * weight * _dot(m, times(m)):
            base, m, weight, left = materialize(base.withColumn("rate", r), "rates"), [0.0] * k, max(weight / 10, 1e-9), miss
        step = _solve([[free[i * k + j] + weight * gram[i][j] for j in range(k)] for i in range(k)], left)
        tries = [[x + 4.0**-e * z for x, z in zip(m, step, strict=True)] for e in range(8)]
        halves = base.agg(*(total(n * above(v) * above(v)) / 2 for v in tries)).first()
        m = min(zip(halves, tries, strict=True), key=lambda c: c[0] + _dot(target, c[1]) + weight / 2 * _dot(c[1], times(c[1])))[1]
        steps += 1


def fit_rates(soft: DataFrame, weights: list[float], *, tolerance: float = 1e-3, max_steps: int | None = None) -> DataFrame:
    """``soft`` (n_tokens, p_0 .. p_k) with a column rate >= 0; expected domain totals come within ``tolerance`` x all tokens of the targets where they can be met.

    Where they cannot, they come within as much of the nearest totals that can, and a warning gives the gap that is left; so it does
    where the caller's ``max_steps`` ends the fit.
    """
    k = len(weights)
    p = [F.col(f"p_{i}") for i in range(k)]
    sums = [F.coalesce(F.sum(F.col("n_tokens") * p[i] * F.col("rate")), F.lit(0.0)).alias(f"t_{i}") for i in range(k)]
    now = soft.withColumn("rate", F.lit(1.0))
    start = now.agg(*sums, *(F.coalesce(F.sum(F.col("n_tokens") * p[i] * p[j]), F.lit(0.0)) for i in range(k) for j in range(k))).first()
    have, flat = list(start[:k]), start[k:]
    tokens = sum(have)
    if not tokens:
        return now
    ridge = 1e-9 * tokens  # for a domain that no document belongs to
    gram = [[flat[i * k + j] + (ridge if i == j else 0.0) for j in range(k)] for i in range(k)]
    target = [w / sum(weights) * tokens for w in weights]
    gap = lambda: max(abs(h - t) for h, t in zip(have, target, strict=True))
    steps, last = 0, float("inf")
    plain = PLAIN_STEPS if max_steps is None else min(PLAIN_STEPS, max_steps)
    while steps < plain and tolerance * tokens < gap() < 0.98 * last:  # then Newton steps pay more
        last = gap()
        if steps and steps % STEPS_AT_ONCE == 0:
            now = materialize(now, "rates")
        pull = _solve(gram, [h - t for h, t in zip(have, target, strict=True)])
        change = reduce(lambda a, b: a + b, (p[i] * F.lit(pull[i]) for i in range(k)))
        now = now.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - change))
        have = list(now.agg(*sums).first())
        steps += 1
    most = NEWTON_STEPS if max_steps is None else max_steps - steps
    if gap() > tolerance * tokens and most > 0:
        now, have = _newton(now, gram, target, tolerance * tokens, most)
    if gap() > tolerance * tokens:
        warnings.warn(f"expected totals stay {gap() / tokens:.6f} of all tokens from the target of a domain: shares {[round(h / tokens, 6) for h in have]} for weights {list(weights)}", stacklevel=2)
    return now


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], *, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 20_000, tolerance: float = 1e-3) -> DataFrame:
    """One row per input row: (id_col, n_tokens long, p_<domain> double for each domain of ``weights``, rate double).

    The share of a domain among all expected tokens, sum(rate x n_tokens x p_domain), comes within ``tolerance`` of its weight where
    rates >= 0 can reach it, and the total stays what it was; where they cannot, a warning gives the gap that is left. A token is a run of characters other than blanks. A null text or one
    without words has no tokens, the priors as posteriors, and counts for nothing. Labelled rows with a null id or domain, or of a
    domain without a weight, are left out; ids labelled twice count for both. Without labels posteriors are even. Repeated rows and null ids
    are rows like others. Other columns are not read. An empty table gives no rows.
    """
    domains = sorted(weights)
    soft = posteriors(docs, labelled, domains, id_col=id_col, text_col=text_col, max_labelled=max_labelled)
    fitted = fit_rates(soft, [weights[d] for d in domains], tolerance=tolerance)
    return fitted.select(F.col("id").alias(id_col), "n_tokens", *(F.col(f"p_{k}").alias(f"p_{d}") for k, d in enumerate(domains)), F.round("rate", 6).alias("rate"))


#: Token shares that the queries aim at.
WEIGHTS = {"high": 0.9, "low": 0.07, "toxic": 0.03}
#: The same for what a quality filter has passed.
FILTERED_WEIGHTS = {"high": 0.97, "toxic": 0.03}


def label_domains(labels: DataFrame) -> DataFrame:
    """Domains of the labels table: toxic, else low or high quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "high")
    return labels.select(F.col("doc_id").alias("id"), domain.alias("domain"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), WEIGHTS)
