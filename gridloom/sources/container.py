"""The bit-packed model container, versions 1 and 2: writing, reading with named refusals, exact bit accounting.

A model is a dict: image (w, h, src_w, src_h), textures, clamp, leak, hidden, pos, weights (float array), levels. A level is a dict:
w, h, c, nearest, mode and, by mode, bits (per channel), lo/hi or palette with k (c x h*w indices), or q, dc_step, deadzone with code
(c x blocks) and sym (c x blocks x 64). Packing one container is sequential by nature; many containers are packed by groups.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bits import BitReader, fnv1a, from_half, pack_bits, to_half
from ..functions.tables import N, NN, ZIGZAG, dc_raw_bits
from ..operators.decode import Network
from ..operators.grid import parse_positions

# Fixed values of the format.
MAGIC = 0x6263746E
VERSION = 2
FIXED_HEADER = 52
SYNC = {"level": 0x2B, "channel": 0x16, "network": 0x31, "end": 0x0C}
SYNC_BITS = 6
MODES = {"posthoc": 0, "frozen": 1, "fixed": 2, "dct": 3}
MAX_SIDE, MAX_WIDTH, MAX_HIDDEN, MAX_DCT_CHANNELS = 16384, 128, 8, 4
HASH_AT = slice(28, 32)


class Refused(ValueError):
    """A container that isn't one, or is damaged; the message names the first problem."""


def marker(kind: str, level: int, channel: int = 0) -> int:
    return (SYNC[kind] + 13 * level + 7 * channel) & 63


def file_hash(data: bytes) -> int:
    return fnv1a(data[: HASH_AT.start] + b"\0\0\0\0" + data[HASH_AT.stop :])


def widths_of(model: dict) -> tuple[int, ...]:
    inputs = sum(lv["c"] for lv in model["levels"]) + 2 * len(parse_positions(model["pos"]))
    return (inputs, *model["hidden"], 3 * model["textures"])


def header(model: dict) -> bytes:
    img, widths, pos = model["image"], widths_of(model), model["pos"].encode()
    dct = model["levels"][0]["mode"] == MODES["dct"]
    fixed = struct.pack("<8B", model.get("cell", 0), N if dct else 0, model["textures"], len(model["levels"]), 0, int(model["clamp"]), len(model["hidden"]), 0)
    parts = [struct.pack("<IHH4III", MAGIC, VERSION, 0, img["w"], img["h"], img["src_w"], img["src_h"], 0, 0), fixed, struct.pack("<fII", model["leak"], widths[0], widths[-1]), bytes([3] * model["textures"])]
    parts += [struct.pack(f"<{len(model['hidden'])}H", *model["hidden"]), struct.pack("<H", len(pos)), pos]
    for lv in model["levels"]:
        grid = lv["mode"] != MODES["dct"]
        parts += [struct.pack("<IIHBB", lv["w"], lv["h"], lv["c"], int(lv["nearest"]), lv["mode"]), bytes(lv["bits"] if grid else [0] * lv["c"])]
        if not grid:
            parts.append(bytes([lv["dc_step"], int(lv["deadzone"]), *lv["q"]]))
        elif lv["mode"] == MODES["fixed"]:
            parts += [np.asarray(p, "<f4").tobytes() for p in lv["palette"]]
        else:
            parts.append(np.stack([lv["lo"], lv["hi"]], axis=1).astype("<f4").tobytes())
    out = bytearray(b"".join(parts))
    if len(out) > 65535:
        raise ValueError("the header is longer than its length field can say")
    out[6:8] = struct.pack("<H", len(out))
    return bytes(out)


def _dct_channel(code: np.ndarray, sym: np.ndarray, dc_bits: int) -> np.ndarray:
    """Bits of one channel: codes, then DC and tokens of each block."""
    z = sym[:, ZIGZAG].astype(np.int64)
    values, widths, place = [z[:, 0]], [np.full(len(z), dc_bits)], [np.arange(len(z)) * 256]
    block, p = np.nonzero(z[:, 1:])
    p = p + 1
    first = np.concatenate([[True], block[1:] != block[:-1]]) if len(block) else np.zeros(0, bool)
    run = np.where(first, p, p - np.concatenate([[0], p[:-1]])) - 1
    q = z[block, p]
    if np.abs(q).max(initial=0) > 256:
        raise ValueError("a magnitude beyond 256 has no token")
    values.append(run + ((np.abs(q) - 1) << 7) + ((q < 0).astype(np.int64) << 15))
    widths.append(np.full(len(q), 16))
    place.append(block * 256 + p)
    open_end = np.flatnonzero(z[:, NN - 1] == 0)
    values.append(np.full(len(open_end), 64))
    widths.append(np.full(len(open_end), 7))
    place.append(open_end * 256 + NN)
    order = np.argsort(np.concatenate(place), kind="stable")
    return np.concatenate([pack_bits(code, 4), pack_bits(np.concatenate(values)[order], np.concatenate(widths)[order])])


def _body(parts: list[np.ndarray]) -> bytes:
    return np.packbits(np.concatenate(parts), bitorder="little").tobytes()


def _level_bits(lv: dict, level: int) -> tuple[list[np.ndarray], int]:
    """A level's bit stream, and the number of its sync bits."""
    parts, sync = [pack_bits([marker("level", level)], SYNC_BITS)], 2 * SYNC_BITS
    for c in range(lv["c"]):
        if lv["mode"] == MODES["dct"]:
            parts += [pack_bits([marker("channel", level, c)], SYNC_BITS), _dct_channel(np.asarray(lv["code"][c]), np.asarray(lv["sym"][c]), dc_raw_bits(lv["dc_step"]))]
            sync += SYNC_BITS
        else:
            parts.append(pack_bits(np.asarray(lv["k"][c]).reshape(-1), lv["bits"][c]))
    return [*parts, pack_bits([marker("end", level)], SYNC_BITS)], sync


def pack(model: dict) -> tuple[bytes, dict]:
    """A container, and its account: content, sync and padding bits. It is read again before it is returned."""
    sections, content, sync = [], 0, 0
    n = len(model["levels"])
    streams = [(1, level, *_level_bits(lv, level)) for level, lv in enumerate(model["levels"])]
    half, bad = to_half(model["weights"])
    if bad.any():
        raise ValueError("a weight is not finite or beyond 65504")
    streams.append((2, 0, [pack_bits([marker("network", n)], SYNC_BITS), pack_bits(half, 16), pack_bits([marker("end", n)], SYNC_BITS)], 2 * SYNC_BITS))
    pad = 0
    for kind, level, parts, marks in streams:
        bits = sum(map(len, parts))
        body = _body(parts)
        sections.append(struct.pack("<BBBBI", kind, 0, level, 0, len(body)) + body)
        content, sync, pad = content + bits - marks, sync + marks, pad + 8 * len(body) - bits
    out = bytearray(header(model) + b"".join(sections))
    out[24:28] = struct.pack("<I", len(out))
    out[HASH_AT] = struct.pack("<I", file_hash(bytes(out)))
    account = {"bytes": len(out), "content_bits": content, "sync_bits": sync, "pad_bits": pad}
    again, told = unpack(bytes(out))
    if told != account or not same(again, model):
        raise AssertionError("the container reads back differently")
    return bytes(out), account


def same(a: dict, b: dict) -> bool:
    """Whether two models have the same symbols, and the same weights after rounding to half floats."""
    keys = ("k", "code", "sym")
    levels = all(np.array_equal(np.asarray(x[k]).reshape(-1), np.asarray(y[k]).reshape(-1)) for x, y in zip(a["levels"], b["levels"], strict=True) for k in keys if k in y)
    return levels and np.array_equal(to_half(a["weights"])[0], to_half(b["weights"])[0])


class _Fields:
    """Little-endian fields, with a refusal where they end too early."""

    def __init__(self, data: bytes, end: int):
        self.data, self.at, self.end = data, 0, end

    def take(self, form: str, what: str) -> tuple:
        size = struct.calcsize("<" + form)
        if self.at + size > self.end:
            raise Refused(f"truncated {what}")
        out = struct.unpack_from("<" + form, self.data, self.at)
        self.at += size
        return out


def _require(ok: bool, problem: str) -> None:
    if not ok:
        raise Refused(problem)


def _read_level(f: _Fields, level: int, version: int, img: dict) -> dict:
    where = f"level {level}: "
    w, h, c, nearest, mode = f.take("IIHBB", where + "level record")
    _require(1 <= w <= 1 << 20 and 1 <= h <= 1 << 20 and 1 <= c <= MAX_WIDTH and nearest in (0, 1) and mode in MODES.values(), where + f"bad dims or mode ({w}x{h}x{c}, mode {mode})")
    _require(level == 0 or mode <= MODES["frozen"], where + f"mode {mode} is only defined on level 0")
    bits = list(f.take(f"{c}B", where + "level record"))
    lowest, highest = {MODES["dct"]: (0, 0), MODES["fixed"]: (1, 8)}.get(mode, (2, 12))
    for b in bits:
        _require(lowest <= b <= highest, where + f"bit depth {b} out of range for mode {mode}")
        _require(mode > MODES["frozen"] or b == bits[0], where + "bit depths differ between channels of a grid level")
    lv = {"w": w, "h": h, "c": c, "nearest": bool(nearest), "mode": mode, "bits": bits}
    if mode == MODES["dct"]:
        (lv["dc_step"],) = f.take("B", where + "level record")
        flags = f.take("B", where + "level record")[0] if version >= 2 else 1
        lv["q"] = list(f.take(f"{c}B", where + "level record"))
        _require(1 <= lv["dc_step"] <= 64, where + f"dc_step {lv['dc_step']} out of range (1..64)")
        _require(flags < 2, where + f"dct_flags {flags} has reserved bits set")
        _require(all(1 <= q <= 100 for q in lv["q"]), where + "dct quality out of range (1..100)")
        _require(bool(nearest) and (w, h) == (img["w"], img["h"]) and w % N == 0 and h % N == 0 and c <= MAX_DCT_CHANNELS, where + "a dct level must be nearest, at full resolution, a multiple of 8 and of 4 channels at most")
        lv["deadzone"] = bool(flags)
    elif mode == MODES["fixed"]:
        _require(bool(nearest), where + "a fixed-grid level must be nearest")
        lv["palette"] = [np.array(f.take(f"{1 << b}f", where + "palette"), np.float32) for b in bits]
        _require(all(np.isfinite(p).all() for p in lv["palette"]), where + "non-finite palette value")
    else:
        both = np.array(f.take(f"{2 * c}f", where + "grid ranges"), np.float32).reshape(c, 2)
        _require(bool(np.isfinite(both).all() and (both[:, 0] <= both[:, 1]).all()), where + "bad grid range")
        lv["lo"], lv["hi"] = both[:, 0], both[:, 1]
    return lv


def least_section_bytes(model: dict) -> int:
    """The fewest bytes that the sections of a header can take."""
    total = 0
    for lv in model["levels"]:
        texels = lv["w"] * lv["h"]
        body = lv["c"] * (SYNC_BITS + texels // NN * (4 + dc_raw_bits(lv["dc_step"]) + 7)) if lv["mode"] == MODES["dct"] else texels * sum(lv["bits"])
        total += 8 + (body + 2 * SYNC_BITS + 7) // 8
    return total + 8 + (16 * Network.count(widths_of(model)) + 2 * SYNC_BITS + 7) // 8


def read_header(data: bytes) -> tuple[dict, int]:
    """The model that a header describes (without payload) and the header's length."""
    n = len(data)
    _require(n >= 8, "not a container (shorter than 8 bytes)")
    magic, version, length = struct.unpack_from("<IHH", data)
    _require(magic == MAGIC, "not a container (bad magic)")
    _require(version in (1, VERSION), f"container version {version} is not known")
    _require(FIXED_HEADER <= length <= n, f"header length {length} exceeds the file size {n}")
    f = _Fields(data, length)
    f.at = 8
    w, h, src_w, src_h, size, told = f.take("6I", "header")
    _require(size == n, f"file_bytes {size} differs from the actual size {n}")
    _require(told == file_hash(data), "file hash mismatch")
    cell, block, textures, n_levels, act, clamp, n_hidden, reserved = f.take("8B", "header")
    leak, n_in, n_out = f.take("fII", "header")
    _require(1 <= src_w <= w <= MAX_SIDE and 1 <= src_h <= h <= MAX_SIDE, "bad image size fields")
    _require(1 <= textures <= 4 and 1 <= n_levels <= 3 and act == 0 and clamp in (0, 1) and 1 <= n_hidden <= MAX_HIDDEN and reserved == 0, "header field out of range")
    _require(bool(np.isfinite(leak)) and 1 <= n_in <= MAX_WIDTH and 1 <= n_out <= MAX_WIDTH, "bad leak, nin or nout")
    channels = f.take(f"{textures}B", "channel counts")
    _require(all(c == 3 for c in channels), "a texture must have 3 channels")
    _require(sum(channels) == n_out, f"nout {n_out} differs from the sum of the channel counts")
    hidden = f.take(f"{n_hidden}H", "hidden widths")
    _require(all(1 <= x <= MAX_WIDTH for x in hidden), "bad hidden width")
    (pos_length,) = f.take("H", "positional spec")
    _require(pos_length < 4096, "bad positional spec length")
    (pos,) = f.take(f"{pos_length}s", "positional spec")
    img = {"w": w, "h": h, "src_w": src_w, "src_h": src_h}
    levels = [_read_level(f, k, version, img) for k in range(n_levels)]
    dct = levels[0]["mode"] == MODES["dct"]
    _require(block == (N if dct else 0), "dct_block and level 0 disagree")
    _require(f.at == length, f"header length {length} disagrees with its fields ({f.at} bytes)")
    model = {"image": img, "cell": cell, "textures": textures, "clamp": bool(clamp), "leak": leak, "hidden": hidden, "pos": pos.decode("latin-1"), "levels": levels}
    try:
        widths = widths_of(model)
    except ValueError as e:
        raise Refused(str(e)) from None
    _require(widths[0] == n_in, f"nin {n_in} differs from {widths[0]}, the latent channels and positional inputs")
    need = least_section_bytes(model)
    _require(need <= n - length, f"the sections need at least {need} bytes but {n - length} follow the header")
    return model, length


def _read_dct_channel(bits: BitReader, blocks: int, dc_bits: int) -> tuple[np.ndarray, np.ndarray]:
    code = bits.take(blocks, 4)
    z = np.zeros((blocks, NN), np.int64)
    for b in range(blocks):
        z[b, 0] = bits.take(1, dc_bits)[0]
        p = 0
        while p < NN - 1:
            run = int(bits.take(1, 7)[0])
            if run == 64:
                break
            p += run + 1
            _require(p < NN, f"a run of {run} leaves block {b}")
            mag, sign = int(bits.take(1, 8)[0]) + 1, int(bits.take(1, 1)[0])
            z[b, p] = -mag if sign else mag
    sym = np.zeros_like(z)
    sym[:, ZIGZAG] = z
    return code, sym


def unpack(data: bytes) -> tuple[dict, dict]:
    """A container's model and account; every section, marker and length is checked."""
    model, at = read_header(data)
    content, sync, pad = 0, 0, 0
    n = len(model["levels"])
    for k in range(n + 1):
        _require(at + 8 <= len(data), f"section {k}: truncated section header")
        kind, coding, level, reserved, size = struct.unpack_from("<BBBBI", data, at)
        _require((kind, coding, level, reserved) == ((1, 0, k, 0) if k < n else (2, 0, 0, 0)), f"section {k}: unexpected kind, coding or level")
        _require(at + 8 + size <= len(data), f"section {k}: truncated section body")
        bits = BitReader(data[at + 8 : at + 8 + size])
        try:
            if k < n:
                lv = model["levels"][k]
                bits.marker(marker("level", k))
                if lv["mode"] == MODES["dct"]:
                    both = []
                    for c in range(lv["c"]):
                        bits.marker(marker("channel", k, c))
                        both.append(_read_dct_channel(bits, lv["w"] * lv["h"] // NN, dc_raw_bits(lv["dc_step"])))
                    lv["code"], lv["sym"] = [b[0] for b in both], [b[1] for b in both]
                else:
                    lv["k"] = [bits.take(lv["w"] * lv["h"], b) for b in lv["bits"]]
            else:
                bits.marker(marker("network", n))
                model["weights"] = from_half(bits.take(Network.count(widths_of(model)), 16).astype(np.uint16))
            bits.marker(marker("end", k))
        except Refused:
            raise
        except ValueError as e:
            raise Refused(f"section {k}: {e}") from None
        left = 8 * size - bits.at
        _require(left < 8, f"section {k}: {left} bits are left over")
        content, sync, pad = content + bits.at - bits.sync, sync + bits.sync, pad + left
        at += 8 + size
    _require(at == len(data), "bytes follow the last section")
    return model, {"bytes": len(data), "content_bits": content, "sync_bits": sync, "pad_bits": pad}


def grid_model(k: np.ndarray, bits: int, lo: float, hi: float, network: Network) -> dict:
    """A one-level model of one channel: post-hoc indices k (h x w) and a network without positional inputs."""
    h, w = k.shape
    level = {"w": w, "h": h, "c": 1, "nearest": True, "mode": MODES["posthoc"], "bits": [bits], "lo": np.array([lo], np.float32), "hi": np.array([hi], np.float32), "k": [k.reshape(-1)]}
    return {"image": {"w": w, "h": h, "src_w": w, "src_h": h}, "textures": network.widths[-1] // 3, "clamp": network.clamp_output, "leak": network.leak, "hidden": network.widths[1:-1], "pos": "", "weights": network.weights, "levels": [level]}


def pack_planes(symbols: DataFrame, key: str, bits: int, network: Network) -> DataFrame:
    """(key, container binary, bytes, content_bits, sync_bits, pad_bits) of each plane in symbols(key, y, x, k, lo, hi): one group, one container."""
    kind = symbols.schema[key].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        y, x, k = (rows[c].to_numpy() for c in ("y", "x", "k"))
        lines = np.unique(y)
        plane = np.zeros((len(lines), int(x.max()) + 1), np.int64)
        plane[np.searchsorted(lines, y), x] = k
        data, account = pack(grid_model(plane, bits, rows["lo"][0].as_py(), rows["hi"][0].as_py(), network))
        return pa.table({key: rows[key].slice(0, 1), "container": pa.array([data]), **{c: pa.array([account[c]], pa.int64()) for c in ("bytes", "content_bits", "sync_bits", "pad_bits")}})

    return symbols.select(key, "y", "x", "k", "lo", "hi").groupBy(key).applyInArrow(run, f"{key} {kind}, container binary, bytes long, content_bits long, sync_bits long, pad_bits long")


def unpack_planes(containers: DataFrame, key: str) -> DataFrame:
    """(key, row, x, k, content_bits): the symbols of each container's level 0, rows counted from 0."""
    kind = containers.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                model, account = unpack(data.as_py())
                lv = model["levels"][0]
                k = lv["k"][0]
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(k), batch.schema.field(0).type), pa.array(np.arange(len(k)) // lv["w"]), pa.array(np.arange(len(k)) % lv["w"]), pa.array(k), pa.array([account["content_bits"]] * len(k), pa.int64())], names=[key, "row", "x", "k", "content_bits"])

    return containers.select(key, "container").mapInArrow(run, f"{key} {kind}, row long, x long, k long, content_bits long")


def read_containers(spark, path: str) -> DataFrame:
    """(path, ok, problem, header json) of container files, by Spark's binary reader."""
    import json

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(1):
                try:
                    model, account = unpack(data.as_py())
                    told = {"image": model["image"], "textures": model["textures"], "hidden": list(model["hidden"]), "pos": model["pos"], "levels": [{k: lv[k] for k in ("w", "h", "c", "mode")} for lv in model["levels"]]} | account
                    rows.append((True, None, json.dumps(told)))
                except Refused as e:
                    rows.append((False, str(e), None))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.bool_(), pa.string(), pa.string()), strict=True))], names=["path", "ok", "problem", "header"])

    files = spark.read.format("binaryFile").load(path).select(F.col("path"), F.col("content"))
    return files.mapInArrow(run, "path string, ok boolean, problem string, header string")
