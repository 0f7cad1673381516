"""Pictures in and out: Spark's image reader to planes, planes to PNG files."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit grey (h x w) or RGB (h x w x 3) PNG."""
    h, w = pixels.shape[:2]
    colour = 2 if pixels.ndim == 3 else 0
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(pixels, np.uint8).reshape(h, -1)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def find(spark: SparkSession, path: str, base: str, parents: int = 4) -> str:
    """``path`` if it exists, else under ``base`` or one of the folders above it, in any store."""
    there = lambda p: (q := spark._jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(q)
    tried = [path, *(f"{base.rstrip('/')}/{'../' * k}{path}" for k in range(parents + 1))]
    for p in tried:
        if there(p):
            return p
    raise FileNotFoundError(f"none of {', '.join(tried)}")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(img, y long, x int, v array<float>) of JPEG, PNG, BMP and GIF files: three channels in [0, 1], whatever the file has.

    Other formats are left out by Spark's reader, which drops what it cannot decode.
    """
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches):
        for batch in batches:
            for origin, h, w, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = np.frombuffer(data, np.uint8).reshape(h * w, n)
                rgb = np.repeat(raw[:, :1], 3, axis=1) if n == 1 else raw[:, 2::-1]  # blue comes first
                for s in range(0, h * w, 1 << 16):
                    part = np.arange(s, min(h * w, s + (1 << 16)))
                    v = (rgb[part].astype(np.float32) / np.float32(255)).reshape(-1)
                    yield pa.RecordBatch.from_arrays([pa.array([origin] * len(part)), pa.array(part // w), pa.array((part % w).astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(0, len(v) + 1, 3), pa.int32()), pa.array(v))], names=["img", "y", "x", "v"])

    return rows.mapInArrow(run, "img string, y long, x int, v array<float>")


def planes_to_png(plane: DataFrame, key: str, channels: int) -> DataFrame:
    """(key, png binary) from (key, y, x, v): v an 8-bit grey value, or an array of three; one picture a group."""
    kind = plane.schema[key].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
        out = np.zeros((int(y.max()) + 1, int(x.max()) + 1, channels), np.uint8)
        v = rows["v"].combine_chunks()
        out[y, x] = (v.flatten() if channels > 1 else v).to_numpy(zero_copy_only=False).reshape(-1, channels)
        return pa.table({key: rows[key].slice(0, 1), "png": pa.array([png(out if channels > 1 else out[:, :, 0])])})

    return plane.select(key, "y", "x", "v").groupBy(key).applyInArrow(run, f"{key} {kind}, png binary")


def to_8bit_rgb(plane: DataFrame, first: int = 0, extent: tuple[int, int] | None = None) -> DataFrame:
    """plane with v as three 8-bit values from channel ``first`` on, cut to ``extent`` (width, height) to leave padding out."""
    inside = plane.where((F.col("x") < extent[0]) & (F.col("y") < extent[1])) if extent else plane
    return inside.withColumn("v", F.transform(F.slice("v", first + 1, 3), lambda c: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)) * 255, 0).cast("int")))
