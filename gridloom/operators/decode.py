"""The small network that turns sampled features into outputs, and losses over pixels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import STREAMS, gauss, noise_key
from ..functions.scalar import leaky, squash


@dataclass(frozen=True)
class Network:
    """Dense layers: widths from inputs to outputs; weights layer by layer, each row-major [out][in] and then its biases."""

    widths: tuple[int, ...]
    weights: np.ndarray
    leak: float = 0.01
    clamp_output: bool = False

    def __post_init__(self) -> None:
        if len(self.weights) != self.count(self.widths):
            raise ValueError(f"{len(self.weights)} weights for widths {self.widths}")

    @staticmethod
    def count(widths: tuple[int, ...]) -> int:
        return sum(b * (a + 1) for a, b in zip(widths, widths[1:], strict=False))

    @property
    def multiplications(self) -> int:
        return sum(a * b for a, b in zip(self.widths, self.widths[1:], strict=False))

    @classmethod
    def drawn(cls, widths: tuple[int, ...], seed: int, **options) -> Network:
        """Hidden layers by He's rule, the output layer with variance 1/n, biases 0; draws are keyed by weight index."""
        draws = gauss(noise_key(seed, STREAMS["network"], 0, 0, np.arange(cls.count(widths))))
        at = 0
        for k, (a, b) in enumerate(zip(widths, widths[1:], strict=False)):
            last = k == len(widths) - 2
            draws[at : at + a * b] *= np.sqrt((1.0 if last else 2.0) / a)
            draws[at + a * b : at + b * (a + 1)] = 0
            at += b * (a + 1)
        return cls(tuple(widths), draws.astype(np.float32), **options)

    def layers(self) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        at = 0
        for k, (a, b) in enumerate(zip(self.widths, self.widths[1:], strict=False)):
            yield self.weights[at : at + a * b].reshape(b, a), self.weights[at + a * b : at + b * (a + 1)], k == len(self.widths) - 2
            at += b * (a + 1)

    def with_weights(self, weights: np.ndarray) -> Network:
        return Network(self.widths, weights, self.leak, self.clamp_output)

    def run(self, features: np.ndarray) -> np.ndarray:
        """Outputs of many rows, one matrix product a layer, in double."""
        x = np.asarray(features, np.float64)
        for w, b, last in self.layers():
            x = x @ w.astype(np.float64).T + b
            if not last:
                x = np.where(x > 0, x, self.leak * x)
        return np.clip(x + 0.5, 0, 1) if self.clamp_output else 1 / (1 + np.exp(-x))

    def describe(self) -> str:
        return "-".join(map(str, self.widths))


def forward_native(network: Network, features: Column) -> Column:
    """The network as a column expression: sums start at the bias and go through the inputs in order."""
    x = features
    for w, b, last in network.layers():
        rows = F.array(*(F.struct(F.lit(float(bias)).alias("b"), F.array(*(F.lit(float(v)) for v in row)).alias("w")) for row, bias in zip(w, b, strict=True)))
        act = (lambda s: squash(s, network.clamp_output)) if last else (lambda s: leaky(s, network.leak))
        x = F.transform(F.transform(rows, _unit(x)), act)
    return x


def _unit(inputs: Column):
    """A unit's sum: its bias, then the products in order."""
    return lambda r: F.aggregate(F.zip_with(r["w"], inputs, lambda a, c: a * c), r["b"], lambda s, t: s + t)


def forward_batch(network: Network, features: Column) -> Column:
    """The network over Arrow batches, for wide networks and many rows."""

    @F.arrow_udf("array<double>")
    def run(values: pa.Array) -> pa.Array:
        out = network.run(values.flatten().to_numpy(zero_copy_only=False).reshape(-1, network.widths[0]))
        n = network.widths[-1]
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, n), pa.int32()), pa.array(out.reshape(-1)))

    return run(features)


def decode(features: DataFrame, network: Network, native: bool = False) -> DataFrame:
    """features(.., f array) with ``out``, one output array per row."""
    return features.withColumn("out", forward_native(network, F.col("f")) if native else forward_batch(network, F.col("f")))


def squared_error(out: Column, target: Column, weights: list[float]) -> Column:
    """Weighted squared error of a row, summed over outputs in order."""
    both = F.zip_with(F.zip_with(out, target, lambda a, b: (a - b) * (a - b)), F.array(*map(F.lit, weights)), lambda d, w: d * w)
    return F.aggregate(both, F.lit(0.0), lambda s, d: s + d)


def weighted_loss(rows: DataFrame, weights: list[float], batch: DataFrame | None = None, key: list[str] | None = None) -> DataFrame:
    """(n, loss): mean weighted squared error of rows(out, target) over a batch of keys, where a key counts as often as it is drawn."""
    used = rows if batch is None else batch.join(rows, key or [])
    total = sum(weights)
    return used.agg(F.count(F.lit(1)).alias("n"), (F.sum(squared_error(F.col("out"), F.col("target"), weights)) / (F.count(F.lit(1)) * F.lit(float(total)))).alias("loss"))
