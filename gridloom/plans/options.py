"""Options of a codec run, and the rules between them."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields, replace

from ..functions.tables import quality_scale
from ..operators.grid import padded_size, parse_positions
from ..operators.train import rate_recipe

MAP_KINDS = ("nz", "code", "bits", "lnz", "dconly", "all")


@dataclass(frozen=True)
class Options:
    textures: int = 1
    weights: tuple[float, ...] = ()
    crop: int = 0
    cell: int = 0
    level0: tuple[int, int, int] = (64, 64, 4)
    level1: tuple[int, int, int] = (0, 0, 0)
    level2: tuple[int, int, int] = (0, 0, 0)
    nearest: tuple[bool, ...] = (False,)
    hidden: tuple[int, ...] = (24, 24)
    leak: float = 0.01
    pos: str = "uv"
    clamp_output: bool = False
    iterations: int = 3000
    seed: int = 1
    network_pairs: int = 256
    batch: int = 4096
    fd_step: float = 1e-3
    latent_pairs: int = 4
    report_bits: int = 8
    fixed_bits: tuple[int, ...] = ()
    search_every: int = 1
    frozen_bits: tuple[int, ...] = ()
    frozen_start: float = 0.5
    quality: tuple[int, ...] = ()
    dct_start: float = 0.5
    dct_refit: int = 500
    dct_refit_until: float = 1.0
    dc_step: int = 4
    deadzone: bool = False
    map_kind: str = "nz"
    rate_weight: float | None = None
    rate_parts: str = "both"
    low_weight: float = 0.25
    notes: tuple[str, ...] = field(default=(), compare=False)

    def levels(self) -> list[tuple[int, int, int]]:
        return [lv for lv in (self.level0, self.level1, self.level2) if lv[2] > 0]


def _spread(values: tuple[int, ...], n: int, what: str) -> tuple[int, ...]:
    """One value for all, or one for each of n."""
    if not values or not any(values):
        return ()
    if len(values) not in (1, n):
        raise ValueError(f"{what}: {len(values)} values for {n}")
    return values * n if len(values) == 1 else values


def validated(o: Options) -> Options:
    """The options with lists spread out and defaults resolved; ValueError names the first rule that is broken."""
    rules = [
        (1 <= o.textures <= 4, "1 to 4 textures per material"),
        (len(o.weights) in (0, o.textures), "one weight per texture"),
        (all(w >= 0 for w in o.weights), "weights must be >= 0"),
        (not o.weights or sum(o.weights) > 0, "weights must not all be zero"),
        (1 <= len(o.hidden) <= 8, "1 to 8 hidden layers"),
        (all(1 <= h <= 128 for h in o.hidden), "hidden widths must be 1..128"),
        (o.fd_step > 0, "the finite-difference step must be > 0"),
        (o.cell >= 0, "the cell must be >= 0"),
        (o.level0[2] >= 1 and all(0 <= lv[2] <= 128 for lv in (o.level0, o.level1, o.level2)), "levels need 1..128 channels"),
        (all(min(lv[:2]) >= (0 if o.cell else 1) for lv in o.levels()), "levels need a width and height >= 1 (0 only with a cell)"),
        (o.level1[2] > 0 or not any(o.level1[:2]), "level 1 needs channels"),
        (o.level2[2] == 0 or o.level1[2] > 0, "level 2 needs level 1"),
        (all(0 <= b <= 8 for b in o.fixed_bits), "fixed grids need 1..8 bits per channel (0: off)"),
        (o.search_every >= 1, "the search interval must be >= 1"),
        (all(b == 0 or 2 <= b <= 12 for b in o.frozen_bits), "frozen grids need 2..12 bits per level (0: continuous)"),
        (0 <= o.frozen_start <= 1 and 0 <= o.dct_start <= 1 and 0 <= o.dct_refit_until <= 1, "starts are fractions of the run"),
        (all(0 <= q <= 100 for q in o.quality), "qualities must be 1..100 (0: off)"),
        (1 <= o.dc_step <= 64, "the DC step must be 1..64"),
        (o.dct_refit >= 0, "the refit interval must be >= 0"),
        (o.map_kind in MAP_KINDS, f"maps are {', '.join(MAP_KINDS)}"),
        (o.rate_weight is None or (o.rate_weight >= 0 and math.isfinite(o.rate_weight)), "the rate weight must be finite and >= 0"),
        (o.rate_parts in ("es", "trunc", "both"), "rate parts are es, trunc or both"),
        (0 <= o.low_weight <= 1, "the first-order weight must be in [0, 1]"),
        (o.network_pairs >= 1 and o.latent_pairs >= 1, "pair counts must be >= 1"),
        (2 <= o.report_bits <= 12, "report bits must be 2..12"),
    ]
    for ok, problem in rules:
        if not ok:
            raise ValueError(problem)
    if "lv1local" in parse_positions(o.pos) and o.level1[2] == 0:
        raise ValueError("lv1local needs level 1")
    n, c = len(o.levels()), o.level0[2]
    fixed, quality = _spread(o.fixed_bits, c, "fixed bits"), _spread(o.quality, c, "qualities")
    if fixed and 0 in fixed:
        raise ValueError("every channel needs 1..8 bits when the fixed grid is on")
    if quality and 0 in quality:
        raise ValueError("every channel needs a quality when the DCT plane is on")
    frozen = _spread(o.frozen_bits, n, "frozen bits")
    if frozen and len(o.frozen_bits) == 1 and (fixed or quality):
        frozen = (0, *frozen[1:])
    if frozen and frozen[0] and (fixed or quality):
        raise ValueError("level 0 cannot be on a frozen grid and fixed or DCT-coded")
    near = o.nearest * n if len(o.nearest) == 1 else o.nearest
    if len(near) != n:
        raise ValueError("one filter, or one per level")
    if quality and (fixed or not near[0] or c > 4):
        raise ValueError("a DCT plane is a nearest level of at most 4 channels without a fixed grid")
    notes = [text for when, text in ((not fixed and o.search_every != 1, "the search interval is ignored without a fixed grid"), (not frozen and o.frozen_start != 0.5, "the frozen start is ignored without frozen bits"), (bool(quality) and o.dct_refit > 0 and o.dct_refit_until <= o.dct_start, "no refit can happen before the start")) if when]
    rate = o.rate_weight if o.rate_weight is not None else (rate_recipe([float(quality_scale(q)) for q in quality]) if quality else 0.0)
    return replace(o, weights=o.weights or (1.0,) * o.textures, fixed_bits=fixed, quality=quality, frozen_bits=frozen if any(frozen) else (), nearest=near, rate_weight=rate, notes=tuple(notes))


def padding_multiple(o: Options) -> int:
    """What an image's sides are padded to: the cell, twice that with a level 2 of automatic size, and whole blocks with a DCT plane."""
    m = o.cell or 1
    if o.cell and o.level2[2] > 0 and o.level2[:2] == (0, 0):
        m *= 2
    return math.lcm(m, 8) if any(o.quality) else m


def padded(o: Options, width: int, height: int) -> tuple[int, int]:
    m = padding_multiple(o)
    return padded_size(width, m), padded_size(height, m)


def parse(arguments: list[str]) -> Options:
    """Options from a command line: each field is a flag of its name, lists are separated by commas, sizes are written 64x64x4, switches take no value."""
    given: dict = {}
    known = {f.name: f for f in fields(Options) if f.name != "notes"}
    rest = list(arguments)
    while rest:
        flag = rest.pop(0)
        name, _, value = flag.removeprefix("--").partition("=")
        name = name.replace("-", "_")
        if not flag.startswith("--") or name not in known:
            raise ValueError(f"unknown option: {flag}")
        default = known[name].default
        if isinstance(default, bool):
            given[name] = value != "false"
            continue
        if not value:
            if not rest:
                raise ValueError(f"{flag} needs a value")
            value = rest.pop(0)
        try:
            given[name] = _parsed(name, value, default)
        except ValueError:
            raise ValueError(f"{flag}: {value!r} isn't understood") from None
    return validated(Options(**given))


def _parsed(name: str, value: str, default):
    if name.startswith("level"):
        return tuple(int(v) for v in value.split("x"))
    if name == "nearest":
        return tuple(v == "nearest" for v in value.split(","))
    if isinstance(default, tuple):
        kind = float if name == "weights" else int
        return tuple(kind(v) for v in value.split(",") if v)
    if name == "rate_weight":
        return float(value)
    return type(default)(value)
