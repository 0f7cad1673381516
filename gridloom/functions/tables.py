"""Constant tables of the block codec."""

from __future__ import annotations

import math

import numpy as np

N = 8
NN = N * N
#: Run symbol of the end-of-block token.
EOB = 64

# The luma quantisation table of the JPEG standard (Annex K), row = vertical frequency, with a DC entry of 4.
LUMA = [
    [4, 11, 10, 16, 24, 40, 51, 61],
    [12, 12, 14, 19, 26, 58, 60, 55],
    [14, 13, 16, 24, 40, 57, 69, 56],
    [14, 17, 22, 29, 51, 87, 80, 62],
    [18, 22, 37, 56, 68, 109, 103, 77],
    [24, 35, 55, 64, 81, 104, 113, 92],
    [49, 64, 78, 87, 103, 121, 120, 101],
    [72, 92, 95, 98, 112, 100, 103, 99],
]

#: Natural index (row * 8 + column) at each zigzag position: by anti-diagonal, walked upwards on even ones.
ZIGZAG = sorted(range(NN), key=lambda i: (i // N + i % N, i % N if (i // N + i % N) % 2 == 0 else i // N))

#: Orthonormal cosine basis [frequency][position], rounded once to float32.
BASIS = np.array([[math.sqrt((1 if u == 0 else 2) / N) * math.cos(math.pi * (2 * x + 1) * u / (2 * N)) for x in range(N)] for u in range(N)], np.float32)

#: Gain of scale code k in 8-bit steps per unit of the [0, 64] plane, and the step scale that undoes it.
GAIN_FLOOR = 14 / 64
GAINS = [GAIN_FLOOR * 2 ** (0.6 * k) for k in range(16)]
SCALES = np.array([1 / g for g in GAINS], np.float32)


def quality_scale(q: int) -> np.float32:
    """The usual JPEG quality curve over 100, in float32."""
    q = max(1, min(100, q))
    s = np.float32(5000) / np.float32(q) if q < 50 else np.float32(200) - np.float32(2) * np.float32(q)
    return np.float32(s * np.float32(0.01))


def steps(q: int, scale: float, dc_step: int) -> list[int]:
    """64 integer steps in natural order for a step scale; all AC steps are 1 from quality 100 on."""
    base = np.array(LUMA, np.float32).reshape(-1)
    out = np.ones(NN, np.int64) if q >= 100 else np.clip(base * np.float32(scale) + np.float32(0.5), 1, 1 << 20).astype(np.int64)
    out[0] = dc_step
    return out.tolist()


def step_tables(q: int, dc_step: int = 4) -> list[list[int]]:
    """The step table of each of the 16 scale codes."""
    return [steps(q, np.float32(quality_scale(q) * a), dc_step) for a in SCALES]


def dc_raw_bits(dc_step: int) -> int:
    """Fixed-length bits of a DC symbol of the [0, 64] plane."""
    return (512 // dc_step).bit_length()


def fixed_grid(bits: int) -> list[float]:
    """-1 + 2k/(2^bits - 1) in float32."""
    levels = (1 << bits) - 1
    return [float(np.float32(-1) + np.float32(2) * np.float32(k) / np.float32(levels)) for k in range(levels + 1)]
