"""What the operators of this subpackage share: scratch tables, reading, sizes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: bytes.translate table that lower-cases A-Z and nothing else.
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())

_scratch: dict[str, SparkSession] = {}


#: Bytes of text that a Python function of this subpackage takes apart at once.
PART_BYTES = 4 << 20


def _cuts(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, upto
        at = upto


def parts_of(texts: pa.Array, most: int = PART_BYTES) -> Iterator[pa.Array]:
    """An array of texts cut into parts of about ``most`` bytes, or one text."""
    for at, upto in _cuts(texts, most):
        yield texts.slice(at, upto - at)


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``column`` (text or bytes) holds about ``most`` bytes of each, or one row: what is taken apart in Python stays small, however
    many rows of whatever length Spark puts into a batch."""
    for batch in batches:
        for at, upto in _cuts(batch.column(column), most):
            yield batch.slice(at, upto - at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by Spark's reader, so that any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and Spark runs on this machine alone (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone
        pass


@atexit.register
def _drop_all() -> None:
    for path, spark in _scratch.items():
        _drop(spark, path)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch[path] = spark
    return path


def forget_path(spark: SparkSession, path: str | None) -> None:
    if path and _scratch.pop(path, None):
        _drop(spark, path)


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that materialize() wrote, once nothing will read them any more."""
    for df in tables:
        forget_path(spark, getattr(df, "_gridloom_path", None))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    return out


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. An all-ASCII text takes the fast built-in; in others only A-Z may change."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
