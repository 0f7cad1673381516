"""The plain model file: little-endian header fields and float payloads, versions 9 to 14.

Each version added fields to the one before; ``LAYOUT`` says from which version on a field is there. Models are the dicts of the container
module, with float values instead of indices: a level has z (h x w x c floats), level 0 of a DCT model has code and sym instead.
"""

from __future__ import annotations

import struct

import numpy as np

from ..functions.tables import NN
from ..operators.decode import Network
from .container import Refused, _Fields, _require, widths_of

#: The magic number of version v is BASE + v.
BASE = 0x4E544330
FIRST, PLAIN, DCT = 9, 12, 14


def write(model: dict) -> bytes:
    """Version 12, or 14 where level 0 is DCT-coded."""
    levels, first = model["levels"], model["levels"][0]
    dct = "sym" in first
    widths, pos, img = widths_of(model), model["pos"].encode(), model["image"]
    fixed = first.get("fixed_bits") or [0] * first["c"]
    ints = lambda *x: struct.pack(f"<{len(x)}i", *x)
    out = [ints(BASE + (DCT if dct else PLAIN), first["w"], first["h"], first["c"], widths[0], len(pos), 0, len(model["hidden"]), len(levels), model["textures"])]
    out += [ints(*(int(lv["nearest"]) for lv in levels)), struct.pack("<iff", 0, 1.0, model["leak"]), ints(max(fixed), *fixed)]
    out.append(ints(img["w"], img["h"], img["src_w"], img["src_h"], int(model["clamp"])))
    out += [ints(lv["w"], lv["h"], lv["c"]) for lv in levels[1:]]
    for lv in levels:
        none = np.zeros(lv["c"])
        out += [ints(lv.get("frozen_bits", 0)), np.concatenate([lv.get("lo", none), lv.get("hi", none)]).astype("<f4").tobytes()]
    if dct:
        out.append(ints(8, first["dc_step"], first["c"], int(first["deadzone"]), *first["q"]))
    out += [ints(*model["hidden"]), pos]
    if dct:
        out += [np.stack(first["sym"], axis=1).astype("<i2").tobytes(), np.stack(first["code"], axis=1).astype("u1").tobytes()]
    out += [np.asarray(lv["z"], "<f4").tobytes() for lv in levels if "z" in lv]
    return b"".join([*out, np.asarray(model["weights"], "<f4").tobytes()])


def read(data: bytes) -> dict:
    """A model of any version; refuses other files, bad fields, and bytes left over."""
    f = _Fields(data, len(data))
    magic, w, h, c, n_in, pos_length, act, n_hidden, n_levels, textures = f.take("10i", "header")
    version = magic - BASE
    _require(FIRST <= version <= DCT, f"not a model file of version {FIRST} to {DCT}")
    _require(act == 0 and 1 <= n_hidden <= 8 and 1 <= n_levels <= 3 and 1 <= textures <= 4 and 0 <= pos_length < 4096 and min(w, h, c) >= 1, "header field out of range")
    nearest = f.take(f"{n_levels}i", "filters")
    deblock, _, leak = f.take("iff", "header")
    _require(deblock == 0, "deblocking is not supported")
    (most,) = f.take("i", "header")
    fixed = list(f.take(f"{c}i", "bit depths")) if version >= 10 else [most] * c
    img = f.take("5i", "image size") if version >= 11 else (w, h, w, h, 0)
    sizes = [(w, h, c), *(f.take("3i", "level size") for _ in range(n_levels - 1))]
    levels = [{"w": a, "h": b, "c": k, "nearest": bool(near)} for (a, b, k), near in zip(sizes, nearest, strict=True)]
    if most:
        levels[0]["fixed_bits"] = fixed
    if version >= 12:
        for lv in levels:
            (bits,) = f.take("i", "grid")
            both = np.array(f.take(f"{2 * lv['c']}f", "grid"), np.float32)
            if bits:
                lv |= {"frozen_bits": bits, "lo": both[: lv["c"]], "hi": both[lv["c"] :]}
    dct = version >= 13
    if dct:
        block, step, channels = f.take("3i", "dct fields")
        zone = f.take("i", "dct fields")[0] if version >= 14 else 1
        _require(block == 8 and 1 <= step <= 64 and channels == c and zone in (0, 1), "bad dct fields")
        levels[0] |= {"dc_step": step, "deadzone": bool(zone), "q": list(f.take(f"{c}i", "dct qualities"))}
    hidden = f.take(f"{n_hidden}i", "hidden widths")
    (pos,) = f.take(f"{pos_length}s", "positional spec")
    model = {"image": dict(zip(("w", "h", "src_w", "src_h"), img, strict=False)), "textures": textures, "clamp": bool(img[4]), "leak": leak, "hidden": hidden, "pos": pos.decode("latin-1"), "levels": levels}
    _require(widths_of(model)[0] == n_in, "nin differs from the latent channels and positional inputs")

    def array(kind: str, *shape: int) -> np.ndarray:
        size = int(np.prod(shape)) * np.dtype(kind).itemsize
        if f.at + size > len(data):
            raise Refused("truncated payload")
        f.at += size
        return np.frombuffer(data, kind, int(np.prod(shape)), f.at - size).reshape(shape)

    if dct:
        blocks = (w // 8) * (h // 8)
        levels[0]["sym"] = list(np.moveaxis(array("<i2", blocks, c, NN), 1, 0))
        levels[0]["code"] = list(np.moveaxis(array("u1", blocks, c), 1, 0))
    for lv in levels[1:] if dct else levels:
        lv["z"] = array("<f4", lv["h"], lv["w"], lv["c"])
    model["weights"] = array("<f4", Network.count(widths_of(model)))
    _require(f.at == len(data), "bytes follow the weights")
    return model
