"""Containers, model files, pictures, options."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.tables import ZIGZAG
from gridloom.operators.decode import Network
from gridloom.plans.options import Options, padded, validated
from gridloom.sources import container as C
from gridloom.sources import images, modelfile

RNG = np.random.default_rng(0)


def model(mode, n_levels=2):
    h, w = 16, 24
    first = {"w": w, "h": h, "c": 2, "nearest": True, "mode": C.MODES[mode], "bits": [4, 4]}
    if mode == "dct":
        sym = RNG.integers(-3, 4, (2, 6, 64)) * (RNG.random((2, 6, 64)) < 0.2)
        sym[:, :, 0] = RNG.integers(0, 120, (2, 6))
        sym[0, 0, ZIGZAG[63]] = -256
        first |= {"bits": [0, 0], "dc_step": 4, "deadzone": True, "q": [50, 80], "code": list(RNG.integers(0, 16, (2, 6))), "sym": list(sym)}
    elif mode == "fixed":
        first |= {"bits": [2, 3], "palette": [np.linspace(-1, 1, 1 << b).astype(np.float32) for b in (2, 3)], "k": [RNG.integers(0, 1 << b, h * w) for b in (2, 3)]}
    else:
        first |= {"lo": np.array([-1, 0], np.float32), "hi": np.array([1, 2], np.float32), "k": list(RNG.integers(0, 16, (2, h * w)))}
    second = {"w": 5, "h": 3, "c": 3, "nearest": False, "mode": 0, "bits": [8] * 3, "lo": np.zeros(3, np.float32), "hi": np.ones(3, np.float32), "k": list(RNG.integers(0, 256, (3, 15)))}
    levels = [first, second][:n_levels]
    widths = (sum(lv["c"] for lv in levels) + 2, 7, 3)
    return {"image": {"w": w, "h": h, "src_w": 20, "src_h": 15}, "textures": 1, "clamp": False, "leak": 0.01, "hidden": (7,), "pos": "uv", "weights": RNG.normal(size=Network.count(widths)).astype(np.float32), "levels": levels}


@pytest.mark.parametrize("mode", list(C.MODES))
def test_container_round_trip(mode):
    m = model(mode)
    data, account = C.pack(m)
    back, told = C.unpack(data)
    assert told == account and C.same(back, m) and account["bytes"] == len(data)
    first = m["levels"][0]
    if mode == "dct":
        nz = [int((s[:, 1:] != 0).sum()) for s in first["sym"]]
        ends = [int((s[:, ZIGZAG[63]] == 0).sum()) for s in first["sym"]]
        bits = sum(4 * 6 + 8 * 6 + 16 * a + 7 * b for a, b in zip(nz, ends, strict=True))
    else:
        bits = 16 * 24 * sum(first["bits"])
    assert account["content_bits"] == bits + 15 * 24 + 16 * len(m["weights"])  # exact, without tolerance


def refixed(data, at, form, value):
    """data with a field changed and the file hash made right again."""
    out = bytearray(data)
    struct.pack_into("<" + form, out, at, value)
    struct.pack_into("<I", out, 28, C.file_hash(bytes(out)))
    return bytes(out)


def test_damaged_containers_are_refused_by_name():
    data, _ = C.pack(model("posthoc"))
    flipped = bytearray(data)
    flipped[-3] ^= 4
    cases = [(data[:4], "shorter than 8"), (b"xxxx" + data[4:], "bad magic"), (refixed(data, 4, "H", 9), "version 9"), (refixed(data, 6, "H", 60000), "exceeds the file size"), (data[:-1], "file_bytes"), (data + b"\0", "file_bytes"), (bytes(flipped), "hash mismatch")]
    cases += [(refixed(data, at, f, v), text) for at, f, v, text in ((8, "I", 0, "image size"), (34, "B", 9, "out of range"), (36, "B", 1, "out of range"), (39, "B", 1, "out of range"), (40, "f", float("nan"), "leak"), (44, "I", 9, "nin"), (48, "I", 4, "nout"), (52, "B", 2, "3 channels"), (53, "H", 0, "hidden width"))]
    record = data.index(b"uv") + 2
    cases += [(refixed(data, record + at, f, v), text) for at, f, v, text in ((0, "I", 0, "bad dims"), (10, "B", 2, "bad dims"), (11, "B", 7, "bad dims"), (12, "B", 13, "bit depth"), (14, "f", float("inf"), "grid range"))]
    length = struct.unpack_from("<H", data, 6)[0]
    cases += [(refixed(data, length, "B", 3), "section 0: unexpected"), (refixed(data, length + 8, "B", data[length + 8] ^ 1), "sync marker"), (refixed(data, length + 4, "I", 10**6), "truncated section body")]
    for bad, text in cases:
        with pytest.raises(C.Refused, match=text):
            C.unpack(bad)


def test_markers_tell_places_apart():
    assert C.marker("level", 0) == 0x2B and C.marker("channel", 0, 0) == 0x16
    assert len({C.marker("channel", lv, c) for lv in range(3) for c in range(4)}) == 12


def test_container_reader_reports_each_file(spark, tmp_path):
    data, account = C.pack(model("dct"))
    (tmp_path / "a.bin").write_bytes(data)
    (tmp_path / "b.bin").write_bytes(data[:-9])
    got = {r["path"][-5:]: r for r in C.read_containers(spark, str(tmp_path)).collect()}
    assert got["a.bin"]["ok"] and f'"content_bits": {account["content_bits"]}' in got["a.bin"]["header"] and "file_bytes" in got["b.bin"]["problem"]


@pytest.mark.parametrize("dct", [False, True])
def test_model_file(dct):
    m = model("dct" if dct else "posthoc")
    for lv in m["levels"]:
        lv["z"] = RNG.normal(size=(lv["h"], lv["w"], lv["c"])).astype(np.float32)
    if dct:
        del m["levels"][0]["z"]
    else:
        m["levels"][1] |= {"frozen_bits": 6}
    data = modelfile.write(m)
    back = modelfile.read(data)
    assert np.array_equal(back["weights"], m["weights"]) and back["pos"] == "uv" and back["image"] == m["image"]
    for a, b in zip(back["levels"], m["levels"], strict=True):
        assert all(np.array_equal(a[k], b[k]) for k in ("z", "sym", "code") if k in b and (k == "z" or dct and "sym" in b))
    for bad in (data[:-1], data + b"\0", b"\0" * 40):
        with pytest.raises(C.Refused):
            modelfile.read(bad)


def test_old_model_files():
    """Versions 9 to 11 lack fields that the later ones have."""
    weights = np.arange(Network.count((3, 2, 3)), dtype="<f4")
    for version in (9, 10, 11):
        head = struct.pack("<10i", modelfile.BASE + version, 2, 2, 1, 3, 2, 0, 1, 1, 1) + struct.pack("<iiff", 0, 0, 1.0, 0.1) + struct.pack("<i", 3)
        head += (struct.pack("<i", 3) if version >= 10 else b"") + (struct.pack("<5i", 8, 8, 7, 7, 1) if version >= 11 else b"")
        back = modelfile.read(head + struct.pack("<i", 2) + b"uv" + np.arange(4, dtype="<f4").tobytes() + weights.tobytes())
        assert back["levels"][0]["fixed_bits"] == [3] and back["levels"][0]["z"].reshape(-1).tolist() == [0, 1, 2, 3] and back["clamp"] == (version == 11)


def test_pictures(spark, tmp_path):
    rgb = RNG.integers(0, 256, (5, 7, 3)).astype(np.uint8)
    grey = RNG.integers(0, 256, (4, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(images.png(rgb))
    (tmp_path / "b.png").write_bytes(images.png(grey))
    rows = images.read_images(spark, str(tmp_path)).collect()
    assert len(rows) == 35 + 12
    for r in rows:
        want = rgb[r["y"], r["x"]] if r["img"].endswith("a.png") else [grey[r["y"], r["x"]]] * 3
        assert np.allclose(r["v"], np.array(want) / 255, atol=1e-6)
    plane = images.to_8bit_rgb(images.read_images(spark, str(tmp_path / "a.png")))
    assert bytes(images.planes_to_png(plane, "img", 3).first()["png"]) == images.png(rgb)
    single = spark.createDataFrame([(0, y, x, int(grey[y, x])) for y in range(4) for x in range(3)], "k int, y long, x int, v int")
    assert bytes(images.planes_to_png(single, "k", 1).first()["png"]) == images.png(grey)
    assert images.to_8bit_rgb(images.read_images(spark, str(tmp_path / "a.png")), extent=(3, 2)).count() == 6


def test_options():
    o = validated(Options(quality=(50,), nearest=(True,), dct_refit=0))
    assert o.quality == (50,) * 4 and o.rate_weight == 0.5 and o.weights == (1.0,)
    assert validated(Options(level1=(32, 32, 2), frozen_bits=(6,))).frozen_bits == (6, 6)
    assert validated(Options(level1=(32, 32, 2), frozen_bits=(6,), fixed_bits=(2,))).frozen_bits == (0, 6)
    assert padded(Options(cell=4), 10, 9) == (12, 12) and padded(Options(cell=6, quality=(50,)), 10, 9) == (24, 24)
    assert validated(Options(search_every=2)).notes
    for bad in ({"textures": 5}, {"weights": (1.0, 1.0)}, {"weights": (0.0,)}, {"hidden": ()}, {"hidden": (200,)}, {"level0": (0, 8, 1)}, {"level2": (4, 4, 1)}, {"fixed_bits": (9,)}, {"fixed_bits": (2, 2)}, {"frozen_bits": (1,)}, {"quality": (101,)}, {"quality": (50,)}, {"dc_step": 0}, {"map_kind": "x"}, {"rate_weight": -1.0}, {"rate_parts": "x"}, {"low_weight": 2.0}, {"pos": "lv1local"}, {"report_bits": 1}, {"fixed_bits": (2,), "quality": (50,), "nearest": (True,)}):
        with pytest.raises(ValueError):
            validated(Options(**bad))


def test_rgb_values_round_half_up(spark):
    df = spark.createDataFrame([(0, 0, [0.5, 2.0, -1.0])], "y long, x int, v array<float>")
    assert images.to_8bit_rgb(df).select(F.col("v")).first()["v"] == [128, 255, 0]


def test_metrics(spark, tmp_path):
    from gridloom.sources import metrics as ME

    sink = ME.MetricsSink(spark, str(tmp_path / "m"), "r1")
    for k, s in enumerate((3.0, 1.0, 2.0)):
        sink.append(k, {"seconds": s, "psnr": 30 + k})
    sink.append_table(9, spark.createDataFrame([(5, 2.5, "x")], "n long, bpp double, t string"), "file_")
    rows = ME.read_metrics(spark, sink.path)
    assert rows.count() == 8 and [tuple(r) for r in ME.timings(rows, "seconds").collect()] == [("r1", 3, 1.0, 2.0)]
    assert {(r["iter"], r["psnr"], r["file_n"]) for r in ME.wide(rows, ["psnr", "file_n"]).collect()} == {(0, 30, None), (1, 31, None), (2, 32, None), (9, None, 5)}


def test_find(spark, tmp_path):
    from gridloom.sources.images import find

    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "pic.png").write_bytes(b"x")
    assert find(spark, "pic.png", str(tmp_path / "a" / "b")).endswith("a/b/../../pic.png")
    with pytest.raises(FileNotFoundError):
        find(spark, "none.png", str(tmp_path))
