"""Closed-form fixtures of the codec: tables, transform, quantiser, costs, truncation, half floats, container. IDs are those of the inventory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import bits as B
from gridloom.functions import scalar as S
from gridloom.functions import tables as T
from gridloom.operators import decode as D
from gridloom.operators import grid as G
from gridloom.operators import metrics as M
from gridloom.operators import quant as Q
from gridloom.operators import rate as R
from gridloom.operators import tokens as K
from gridloom.operators import train as TR
from gridloom.operators import transform as X


def one(spark, **columns):
    """A row of column expressions, collected."""
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


# Tables and transform: E14 to E18, J3


def test_zigzag_is_the_jpeg_order():
    assert T.ZIGZAG[:16] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5] and T.ZIGZAG[-4:] == [47, 55, 62, 63][-4:]
    assert sorted(T.ZIGZAG) == list(range(64))


def test_steps_at_quality_50_are_the_table():
    assert T.quality_scale(50) == 1
    assert T.steps(50, 1.0, 4) == [4, *[v for row in T.LUMA for v in row][1:]]
    assert T.steps(100, 1.0, 4) == [4] + [1] * 63
    assert [T.dc_raw_bits(s) for s in (4, 1, 64)] == [8, 10, 4]


def test_basis_bits():
    assert [hex(v) for v in T.BASIS.view(np.uint32)[1]] == ["0x3efb14be", "0x3ed4db31", "0x3e8e39da", "0x3dc7c5c2", "0xbdc7c5c2", "0xbe8e39da", "0xbed4db31", "0xbefb14be"]
    assert [hex(v) for v in T.SCALES.view(np.uint32)[:3]] == ["0x40924925", "0x40410671", "0x3ffeb2bf"]


def test_transform_round_trip():
    blocks = np.random.default_rng(12345).random((1000, 8, 8)).astype(np.float32) * 64
    assert np.abs(X.inverse(X.forward(blocks)) - blocks).max() < 1e-4
    flat = X.forward(np.full((1, 8, 8), 32, np.float32))
    assert flat[0, 0, 0] == pytest.approx(256) and np.abs(flat.reshape(-1)[1:]).max() < 1e-4


def test_scale_codes(spark):
    got = one(spark, k=F.array(*(S.gain_code(F.lit(g)) for g in T.GAINS)), low=S.gain_code(F.lit(0.001)), high=S.gain_code(F.lit(1e6)))
    assert got["k"] == list(range(16)) and (got["low"], got["high"]) == (0, 15)


def ac(value, i, zone):
    return S.quant_ac(S.f32(F.lit(value)), F.lit(10), F.lit(i), zone)


def test_quantiser(spark):
    zone = [(4.0, 8, 0), (6.0, 8, 1), (9.9, 16, 0), (10.0, 16, 1), (11.0, 16, 1), (-15.0, 2, -1)]
    plain = [(14.9, 16, 1), (15.0, 16, 2), (-15.0, 2, -2), (20000.0, 16, 1024), (-20000.0, 16, -1024)]
    got = one(spark, a=F.array(*(ac(v, i, True) for v, i, _ in zone)), b=F.array(*(ac(v, i, False) for v, i, _ in plain)), dc=F.array(*(S.quant_dc(S.f32(F.lit(v)), 4) for v in (2.0, 6.0, 10.0))))
    assert got["a"] == [w for *_, w in zone] and got["b"] == [w for *_, w in plain] and got["dc"] == [0, 2, 2]


def test_dequantiser(spark):
    got = one(spark, a=F.array(*(S.dequant_ac(F.lit(q), F.lit(10), F.lit(i), z) for q, i, z in ((1, 16, True), (-2, 16, True), (0, 16, True), (3, 8, True), (3, 16, False)))), b=S.dequant_dc(F.lit(7), 4))
    assert got["a"] == [15.0, -25.0, 0.0, 30.0, 30.0] and got["b"] == 28.0


def test_nan_clamps_to_the_lower_end(spark):
    got = one(spark, a=S.clamp(F.lit(float("nan")), -1.0, 1.0), b=S.clamp(F.lit(5.0), -1.0, 1.0), c=S.finite(F.lit(float("inf"))), d=S.finite(F.lit(1.0)))
    assert tuple(got) == (-1.0, 1.0, False, True)


# Tokens: F3 to F10, E24, E25, D14


def blocks(spark, *sparse):
    rows = []
    for k, cells in enumerate(sparse):
        sym = [0] * 64
        for p, v in cells.items():
            sym[T.ZIGZAG[p]] = v
        rows.append((k, 0, sym))
    return spark.createDataFrame(rows, "by int, bx int, sym array<int>")


def test_cost_table(spark):
    got = one(spark, run=F.array(*(S.run_cost(F.lit(r)) / 16 for r in range(8))), mag=F.array(*(S.magnitude_cost(F.lit(m)) / 16 for m in range(1, 9))), far=S.run_cost(F.lit(62)) / 16, big=S.magnitude_cost(F.lit(256)) / 16)
    assert got["run"] == [1, 3, 3, 5, 5, 5, 5, 7] and got["mag"] == [1, 3, 3, 5, 5, 5, 5, 7] and (got["far"], got["big"]) == (11, 17)


def test_tokens(spark):
    got = [tuple(r)[1:] for r in K.tokens(blocks(spark, {1: 3, 4: -300}, {63: 1}, {}), ["by"]).collect()]
    assert got == [(1, 0, 0, 3, False), (4, 1, 2, 256, True), (None, 4, 64, None, None), (63, 0, 62, 1, False), (None, 0, 64, None, None)]
    shape = [tuple(r)[1:] for r in K.block_shape(blocks(spark, {1: 3, 4: -3}, {63: 1}, {}), ["by"]).collect()]
    assert shape == [(2, 4, 2, 59), (1, 63, 62, 0), (0, 0, 0, 63)]


def test_block_bits(spark):
    got = {r["by"]: r["bits16"] / 16 for r in K.block_bits(blocks(spark, {1: 1}, {}, {5: 2, 63: -1}), ["by"]).collect()}
    assert got == {0: 5.0, 1: 2.0, 2: (5 + 3 + 1) + (11 + 1 + 1)}
    total = {r["by"]: r["bits16"] for r in K.proxy_totals(K.block_bits(blocks(spark, {1: 1}, {}), ["by"]), "by").collect()}
    assert total == {0: 80, 1: 32, None: 112}


def slow_truncate(c, q, v, lam, w16):
    """One block, position by position."""
    cost = lambda x: 16 * (2 * (int(x).bit_length() - 1) + 1)
    q, after, dropped = list(q), 64, 0
    for p in range(63, 0, -1):
        k = T.ZIGZAG[p]
        if not q[k]:
            continue
        before = max([j for j in range(1, p) if q[T.ZIGZAG[j]]], default=0)
        run = p - before - 1
        token = cost(run + 1) + cost(min(256, abs(q[k]))) + 16
        token = (token * w16 + 8) >> 4 if p <= 2 else token
        saved = token - (32 if p == 63 else 0) if after == 64 else token + cost(after - p) - cost(after - p + run + 1)
        lost = np.float32(c[k] * c[k]) - np.float32((c[k] - v[k]) * (c[k] - v[k]))
        if lost < np.float32(lam) * np.float32(saved):
            q[k], dropped = 0, dropped + 1
        else:
            after = p
    return q


def test_truncation_equals_the_step_by_step_form(spark):
    rng = np.random.default_rng(6)
    c = (rng.normal(size=(60, 64)) * 12).astype(np.float32)
    q = np.round(c / 10).astype(np.int64) * (rng.random((60, 64)) < 0.4)
    v = (q * 10).astype(np.float32)
    for lam in (0.0, 0.5, 2.0, 50.0):
        got = K.truncate(c, q, v, lam, 4)
        assert got.tolist() == [slow_truncate(*x, lam, 4) for x in zip(c, q, v, strict=True)]
        if lam == 0:
            assert (got == q)[(c * c - (c - v) ** 2) >= 0].all()
    df = spark.createDataFrame([(r[0].tolist(), r[1].tolist(), r[2].tolist()) for r in zip(c, q, v, strict=True)], "c array<float>, q array<int>, v array<float>")
    rows = df.select(K.truncate_column(F.col("c"), F.col("q"), F.col("v"), 2.0, 4).alias("t")).collect()
    assert [r["t"] for r in rows] == K.truncate(c, q, v, 2.0, 4).tolist()


def test_truncation_ties_stay(spark):
    c, q, v = np.zeros((1, 64), np.float32), np.zeros((1, 64), np.int64), np.zeros((1, 64), np.float32)
    k = T.ZIGZAG[5]
    c[0, k], q[0, k], v[0, k] = 10, 1, 10
    cost = 16 * (5 + 1 + 1)
    assert K.truncate(c, q, v, 100 / cost)[0, k] == 1 and K.truncate(c, q, v, 100.01 / cost)[0, k] == 0


def test_dc_prediction(spark):
    df = spark.createDataFrame([(y, x, [10 * y + x + 1] + [0] * 63) for y in range(2) for x in range(2)], "by int, bx int, sym array<int>")
    assert {(r["by"], r["bx"]): r["r"] for r in K.dc_residuals(df).collect()} == {(0, 0): 1, (0, 1): 1, (1, 0): 10, (1, 1): 1}


# Bits: A19 to A25, E27 to E29, E32 to E36


def test_half_floats():
    cases = {1.0: 0x3C00, -2.0: 0xC000, 65504.0: 0x7BFF, 5.9604645e-8: 1, 2.9802322e-8: 0, 1.00048828: 0x3C00, 1.00073242: 0x3C01}
    assert [int(x) for x in B.to_half(np.array(list(cases)))[0]] == list(cases.values())
    assert B.to_half(np.array([65520.0]))[1][0] and B.to_half(np.array([np.nan]))[1][0]
    every = np.arange(65536).astype(np.uint16)
    every = every[(every >> 10 & 31) != 31]
    assert len(every) == 63488 and (B.to_half(B.from_half(every))[0] == every).all()
    with pytest.raises(ValueError, match="65504"):
        B.round_half(np.array([1e6]))


def test_hashes(spark):
    assert int(B.mix64(np.array([5], np.uint64))[0]) == 7134611160154358618
    assert B.fnv1a(b"") == 2166136261 and B.fnv1a(b"a") == 0xE40C292C and B.fnv1a(b"a", 64) == 0xAF63DC4C8601EC8C
    df = spark.createDataFrame([(bytearray(b),) for b in (b"", b"a", b"foobar", bytes(range(256)))], "b binary")
    rows = df.select("b", S.fnv1a32(F.col("b")).alias("n"), B.fnv1a_column(F.col("b")).alias("f")).collect()
    assert all(r["n"] == r["f"] == B.fnv1a(bytes(r["b"])) for r in rows)


def test_draws():
    g = B.gauss(B.noise_key(1, 1, 0, 0, np.arange(100000)))
    assert abs(g.mean()) < 0.02 and abs(g.std() - 1) < 0.02
    assert (B.noise_key(1, 1, 0, 0, np.arange(9)) == B.noise_key(1, 1, 0, 0, np.arange(9))).all() and (B.noise_key(1, 2, 0, 0, np.arange(9)) != B.noise_key(1, 1, 0, 0, np.arange(9))).all()


def test_ulp():
    a = np.array([1.0, -1.0, 0.0, 1.0], np.float32)
    b = np.array([np.nextafter(np.float32(1), np.float32(2)), -1.0, -0.0, -1.0], np.float32)
    assert B.ulp_distance(a, b)[:3].tolist() == [1, 0, 0] and B.ulp_distance(a, b)[3] == 2 * 0x3F800000


def test_bit_stream():
    values, widths = np.array([5, 1, 300, 0, 7]), np.array([3, 1, 9, 2, 3])
    data = np.packbits(B.pack_bits(values, widths), bitorder="little").tobytes()
    r = B.BitReader(data)
    assert [int(r.take(1, w)[0]) for w in widths] == values.tolist()
    with pytest.raises(ValueError, match="ends at bit"):
        r.take(9, 8)


# Network and training: E1 to E5, D3, I1 to I5, I12, H2

NET = D.Network.drawn((4, 6, 3), 7)


def test_network_native_and_batch_agree(spark):
    x = np.random.default_rng(2).normal(size=(50, 4))
    for net in (NET, D.Network(NET.widths, NET.weights, 0.2, True)):
        df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, f array<double>")
        for native in (True, False):
            got = np.array([r["out"] for r in D.decode(df, net, native).orderBy("i").collect()])
            assert np.allclose(got, net.run(x), atol=1e-12)
    assert NET.multiplications == 4 * 6 + 6 * 3 and NET.describe() == "4-6-3"


def test_gradients(spark):
    rng = np.random.default_rng(5)
    x, t = rng.normal(size=(64, 4)), rng.random((64, 3))
    fd, _ = TR.fd_gradient(spark, NET, x, t, np.ones(3), h=1e-3)
    exact = np.array([(TR.batch_loss(NET.with_weights(NET.weights + 1e-5 * e), x, t, np.ones(3)) - TR.batch_loss(NET.with_weights(NET.weights - 1e-5 * e), x, t, np.ones(3))) / 2e-5 for e in np.eye(len(NET.weights))])
    assert np.allclose(fd, exact, atol=5e-4)  # a step may cross a kink
    es, told = TR.es_gradient(spark, NET, x, t, np.ones(3), pairs=200, sigma=0.02, seed=1, step=1)
    assert np.corrcoef(es, exact)[0, 1] > 0.7 and told["loss"] > 0


def test_adam(spark):
    df = spark.createDataFrame([(i, float(i), 0.1 * i - 0.2, 0.0, 0.0) for i in range(5)], "i int, z double, g double, m double, v double")
    got = TR.adam(df, 1, 0.02).orderBy("i").collect()
    z, m, v = TR.adam_numpy(np.arange(5.0), np.array([0.1 * i - 0.2 for i in range(5)]), np.zeros(5), np.zeros(5), 1, 0.02)
    assert np.allclose([(r["z"], r["m"], r["v"]) for r in got], np.stack([z, m, v], axis=1))


def planes(spark, size=16, cells=4):
    rng = np.random.default_rng(1)
    net = D.Network.drawn((2, 6, 1), 3)
    goal = rng.normal(size=(cells, cells, 2)) * 0.5
    target = net.run(np.repeat(np.repeat(goal, size // cells, 0), size // cells, 1).reshape(-1, 2)).reshape(size, size)
    pixels = spark.createDataFrame([(y, x, [float(target[y, x])]) for y in range(size) for x in range(size)], "y long, x int, target array<double>")
    texels = spark.createDataFrame([(y, x, c, 0.0) for y in range(cells) for x in range(cells) for c in range(2)], "y long, x int, c int, v double")
    return net, target, pixels, texels


def test_latent_gradient_equals_numpy(spark):
    net, target, pixels, texels = planes(spark)
    got = {(r["y"], r["x"], r["c"]): r["g"] for r in TR.latent_es_gradient(pixels, texels, net, (16, 16), (4, 4), pairs=3, sigma=0.05, seed=1, step=2).collect()}
    want = np.zeros((4, 4, 2))
    for k in range(3):
        e = B.gauss(B.noise_key(1, B.STREAMS["latent"], 2, k, np.arange(32))).reshape(4, 4, 2)
        err = [(net.run(np.repeat(np.repeat(s * 0.05 * e, 4, 0), 4, 1).reshape(-1, 2)).reshape(16, 16) - target) ** 2 for s in (1, -1)]
        d = (err[0] - err[1]).reshape(4, 4, 4, 4).sum(axis=(1, 3))
        want += d[:, :, None] * e / (2 * 3 * 0.05 * 256)
    assert np.allclose([got[y, x, c] for y in range(4) for x in range(4) for c in range(2)], want.reshape(-1), atol=1e-12)


def test_training_lowers_the_loss(spark, tmp_path):
    net, target, pixels, texels = planes(spark)
    kept = []

    def write(df):
        path = str(tmp_path / str(len(kept)))
        df.write.parquet(path)
        kept.append(path)
        return spark.read.parquet(path)

    out = TR.fit_plane(pixels, texels, net, (16, 16), (4, 4), steps=6, rate=0.1, write=write).collect()
    z = np.zeros((4, 4, 2))
    for r in out:
        z[r["y"], r["x"], r["c"]] = r["v"]
    loss = lambda z: ((net.run(np.repeat(np.repeat(z, 4, 0), 4, 1).reshape(-1, 2)).reshape(16, 16) - target) ** 2).mean()
    assert loss(z) < loss(np.zeros((4, 4, 2)))


def test_search_keeps_the_current_value_on_ties(spark):
    df = spark.createDataFrame([(0, k, 5, 2) for k in range(4)] + [(1, 0, 3, 3), (1, 1, 2, 3), (1, 3, 2, 3), (2, 0, 1, 3), (2, 1, 1, 3), (2, 3, 4, 3)], "t int, k int, loss long, cur int")
    got = {r["t"]: r["best"] for r in TR.argmin_search(df, ["t"], "k", "loss", "cur").collect()}
    assert got == {0: 2, 1: 3, 2: 0}


def test_anneal_and_recipe():
    assert [TR.anneal(t, 10, 0.5, 0.1) for t in (1, 5, 10)] == [1, 1, pytest.approx(0.1)] and TR.anneal(9, 10, 1.0, 0.1) == 1
    assert TR.rate_recipe([1.0]) == 0.5 and TR.rate_recipe([0.1, 1.0]) == pytest.approx(0.075)


# Grids, quantisation, rate, metrics


def test_pad_crop_and_side_by_side(spark):
    p = spark.createDataFrame([(y, x, float(10 * y + x)) for y in range(3) for x in range(4)], "y long, x int, v float")
    got = {(r["y"], r["x"]): r["v"] for r in G.pad_replicate(p, 4, 3, 6, 5).collect()}
    assert len(got) == 30 and got[4, 5] == 23 and got[0, 5] == 3 and got[4, 0] == 20
    crop = {(r["y"], r["x"]): r["v"] for r in G.centre_crop(p, 4, 3, 2).collect()}
    assert crop == {(0, 0): 1, (0, 1): 2, (1, 0): 11, (1, 1): 12}
    assert G.side_by_side(p, p, 4).where("x >= 4").count() == 12


def test_bilinear_sampling(spark):
    z = np.random.default_rng(3).random((3, 4)).astype(np.float32)
    texels = spark.createDataFrame([(y, x, float(z[y, x])) for y in range(3) for x in range(4)], "y long, x int, v float")
    pixels = spark.createDataFrame([(y, x) for y in range(6) for x in range(7)], "y long, x int")
    got = {(r["y"], r["x"]): r["s"] for r in G.sample(pixels, texels, (7, 6), (4, 3)).collect()}
    for (y, x), s in got.items():
        u, v = (x + 0.5) / 7 * 4 - 0.5, (y + 0.5) / 6 * 3 - 0.5
        ix, iy = int(np.floor(u)), int(np.floor(v))
        at = lambda a, b: z[min(2, max(0, b)), min(3, max(0, a))]
        fx, fy = u - ix, v - iy
        want = (1 - fx) * (1 - fy) * at(ix, iy) + fx * (1 - fy) * at(ix + 1, iy) + (1 - fx) * fy * at(ix, iy + 1) + fx * fy * at(ix + 1, iy + 1)
        assert s == pytest.approx(want, abs=1e-5)
    assert len(got) == 42


def test_footprints(spark):
    pixels = spark.createDataFrame([(y, x, 1) for y in range(4) for x in range(4)], "y long, x int, d long")
    got = {(r["ty"], r["tx"]): r["n"] for r in G.footprint_sums(pixels, "d", (4, 4), (2, 2)).collect()}
    assert got == {(0, 0): 9, (0, 1): 9, (1, 0): 9, (1, 1): 9}  # clamped taps count once


def test_level_offsets_and_maps(spark):
    lv = spark.createDataFrame([(0, 4, 4, 2), (1, 2, 2, 3)], "l int, w int, h int, c int")
    assert [(r["size"], r["off"]) for r in G.level_offsets(lv).orderBy("l").collect()] == [(32, 0), (12, 32)]
    assert Q.active_levels(lv, True).count() == 1
    b = spark.createDataFrame([(1, 2, 7)], "by int, bx int, m int")
    px = G.expand_blocks(b, "m").collect()
    assert len(px) == 64 and {(r["y"] // 8, r["x"] // 8) for r in px} == {(1, 2)}


def test_positions():
    assert G.parse_positions("none") == [] and G.parse_positions("uv,lv1local") == ["uv", "lv1local"]
    with pytest.raises(ValueError, match="unknown"):
        G.parse_positions("xyz")


def test_half_rounding_modes(spark):
    got = one(spark, away=S.minmax_index(S.f32(F.lit(0.5)), S.f32(0.0), S.f32(1.0), 5), even=S.halfeven_index(S.f32(F.lit(0.5)), S.f32(0.0), S.f32(1.0), 5), fixed=S.fixed_index(S.f32(F.lit(0.0)), 1))
    assert tuple(got) == (3, 2, 1)


def test_context_entropy_by_hand(spark):
    k = np.random.default_rng(4).integers(0, 3, (6, 5))
    df = spark.createDataFrame([(0, y, x, int(k[y, x])) for y in range(6) for x in range(5)], "c int, y long, x int, k int")
    from collections import Counter
    from math import log2

    up = lambda y, x: int(k[y - 1, x]) if y else 0
    left = lambda y, x: int(k[y, x - 1]) if x else 0
    at = [(y, x) for y in range(6) for x in range(5)]
    h = lambda c: -sum(n * log2(n / 30) for n in c.values())
    want = h(Counter((up(*p), left(*p), int(k[p])) for p in at)) - h(Counter((up(*p), left(*p)) for p in at))
    assert R.context_entropy(df, ["c"], "k").first()["bits"] == pytest.approx(want)
    assert R.order0(df, ["c"], "k").first()["bits"] == pytest.approx(h(Counter(k.reshape(-1).tolist())))


def test_psnr_and_weights(spark):
    assert one(spark, a=S.psnr(F.lit(0.0)), b=S.psnr(F.lit(65025.0)), c=S.psnr(F.lit(1e-9)))[0:3] == (100.0, 0.0, 100.0)
    t = spark.createDataFrame([(0, 2.0), (1, 8.0)], "texture int, mse double")
    assert M.weighted_mse(t, {0: 1.0, 1: 0.0}).first()["mse"] == 2.0 and M.weighted_mse(t, {0: 1.0, 1: 1.0}).first()["mse"] == 5.0


def test_raw_accounting(spark):
    lv = spark.createDataFrame([(0, 64, 64, 4, 8)], "l int, w long, h long, c long, bits long")
    assert tuple(R.raw_accounting(lv, 100).first()) == (64 * 64 * 4 * 8, 256, 1600)


def test_all_channels_hold_every_vector_once(spark, small):
    from gridloom.plans import codec

    want = sorted((r["label"], x, np.float32(v)) for r in codec.table(spark, small, "embeddings").collect() for x, v in enumerate(r["embedding"]))
    got = sorted((k, r["x"], np.float32(v)) for r in codec.QUERIES["pack_all_channels"](spark, small).collect() for k, v in enumerate(r["v"]) if v is not None)
    assert got == want


def test_rank_in_key(spark):
    rows = [(k, i) for k in (0, 1) for i in range(k, 50, 3)] + [(0, 3)]
    for chunk in (4, 4096):
        got = G.rank_in_key(spark.createDataFrame(rows, "k int, i long"), "k", "i", chunk).collect()
        assert sorted((r["k"], r["y"], r["i"]) for r in got) == [(k, y, i) for k in (0, 1) for y, i in enumerate(sorted(j for q, j in rows if q == k))]


def test_command_line():
    from gridloom.plans.options import Options, parse, validated

    got = parse(["--level0", "32x32x2", "--quality=80", "--hidden", "16,16", "--nearest=nearest", "--deadzone", "--low-weight", "0.5", "--weights=2"])
    assert got == validated(Options(level0=(32, 32, 2), quality=(80,), hidden=(16, 16), nearest=(True,), deadzone=True, low_weight=0.5, weights=(2.0,)))
    for bad, problem in ((["--nothing"], "unknown"), (["x"], "unknown"), (["--seed"], "needs a value"), (["--seed", "x"], "understood"), (["--dc-step", "65"], "1..64")):
        with pytest.raises(ValueError, match=problem):
            parse(bad)


def test_refits_fall_due():
    assert [t for t in range(0, 41) if TR.refit_due(t, 40, 10, 5, 30)] == [5, 15, 20, 25, 30]
    assert not any(TR.refit_due(t, 40, 10, 5, 30, live=False) or TR.refit_due(t, 40, 10, 0, 30) for t in range(41))


def test_a_block_that_is_not_whole_is_an_error(spark):
    plane = spark.range(60).selectExpr("id div 8 AS y", "cast(id % 8 AS int) AS x", "1f AS v")
    with pytest.raises(Exception, match="isn't whole"):
        X.blocks_of(plane).collect()
    rows = spark.range(50).selectExpr("id div 5 AS y", "cast(id % 5 AS int) AS x", "cast(id AS float) AS v")
    got = {(r["by"], r["bx"]): r["w"] for r in X.blocks_of(G.pad_blocks(rows, 5, 10)).collect()}
    want = np.pad(np.arange(50).reshape(10, 5), ((0, 6), (0, 3)), mode="edge").astype(float)
    assert set(got) == {(0, 0), (1, 0)} and got[1, 0] == want[8:].reshape(-1).tolist() and got[0, 0] == want[:8].reshape(-1).tolist()


def test_median_and_running_best_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(k % 3, float(v)) for k, v in enumerate(np.concatenate([rng.normal(size=200), [5.0] * 60, rng.integers(0, 3, 41)]))] + [(7, 4.0), (8, None), (9, 1.0), (9, 2.0)]
    df = spark.createDataFrame(rows, "c int, v double")
    got = {r["c"]: r["median"] for r in M.median(df, "v", ["c"]).collect()}
    want = {c: float(np.median([v for k, v in rows if k == c])) for c in (0, 1, 2, 7, 9)}
    assert got == pytest.approx(want)
    steps = spark.createDataFrame([(int(k), float(v)) for k, v in enumerate(rng.normal(size=100))], "i long, v double")
    best = [r["best"] for r in R.running_best(steps, "i", "v", chunk=7).orderBy("i").collect()]
    assert best == np.maximum.accumulate([r["v"] for r in steps.orderBy("i").collect()]).tolist()


@pytest.mark.parametrize("nearest", [True, False])
def test_latent_gradient_against_loops(spark, nearest):
    """Samples, differences and footprints pixel by pixel."""
    w, h, n, channels, pairs, sigma = 12, 8, (4, 3), 2, 3, 0.05
    rng = np.random.default_rng(2)
    net = D.Network.drawn((channels, 5, 3), 4)
    z, target = rng.normal(size=(n[1], n[0], channels)).astype(np.float32), rng.random((h, w, 3))
    texels = spark.createDataFrame([(y, x, c, float(z[y, x, c])) for y in range(n[1]) for x in range(n[0]) for c in range(channels)], "y long, x int, c int, v float")
    pixels = spark.createDataFrame([(y, x, target[y, x].tolist()) for y in range(h) for x in range(w)], "y long, x int, target array<double>")
    got = {(r["y"], r["x"], r["c"]): r["g"] for r in TR.latent_es_gradient(pixels, texels, net, (w, h), n, pairs=pairs, sigma=sigma, seed=5, step=2, nearest=nearest).collect()}
    flat = (np.arange(n[1])[:, None, None] * n[0] + np.arange(n[0])[None, :, None]) * channels + np.arange(channels)
    grad = np.zeros(z.shape)

    def taps(p, size, m):
        t = (p + 0.5) / size * m - (0 if nearest else 0.5)
        i = int(np.floor(t))
        held = lambda k: max(0, min(m - 1, k))
        return (held(i), held(i), 0.0) if nearest else (held(i), held(i + 1), t - i)

    for k in range(pairs):
        eps = B.gauss(B.noise_key(5, B.STREAMS["latent"], 2, k, flat.reshape(-1))).reshape(z.shape)
        for y in range(h):
            for x in range(w):
                (x0, x1, fx), (y0, y1, fy) = taps(x, w, n[0]), taps(y, h, n[1])
                blend = lambda a: (1 - fx) * (1 - fy) * a[y0, x0] + fx * (1 - fy) * a[y0, x1] + (1 - fx) * fy * a[y1, x0] + fx * fy * a[y1, x1]  # noqa: E731,B023
                d = [((net.run((blend(z.astype(float)) + s * sigma * blend(eps))[None])[0] - target[y, x]) ** 2).sum() for s in (1, -1)]
                for ty, tx in {(y0, x0), (y0, x1), (y1, x0), (y1, x1)}:
                    grad[ty, tx] += (d[0] - d[1]) * eps[ty, tx] / (2 * pairs * sigma * 3 * w * h)
    assert all(got[y, x, c] == pytest.approx(grad[y, x, c], rel=1e-4, abs=1e-9) for y, x, c in got) and len(got) == grad.size
