"""Exact dedup by two-pass Bloom filtering.

Texts are hashed once (SHA-256 of the normalised text) into a narrow table in the shared folder. Pass one
enters every hash into a filter of saturating cells and keeps the plane of cells that were entered at
least twice. Pass two tests each hash: only rows all of whose cells were entered twice are possibly
repeated; they alone shuffle, are grouped by the full hash, and get their verdict. All other rows pass
straight through. A repeated hash enters each of its cells at least twice, so none is missed; a false
alarm ends up as a group of one.

The filter is broadcast, so its size is bounded: at most ``max_filter_bytes``. Where the row count calls
for more cells, nothing is broadcast: hashes that a batch holds twice are repeated for sure, one of each other hash and batch goes to the task of
its slice of the hash space (32 bytes; texts never move), and that task makes and asks a filter of its own slice. All slices run
at once, each with ``slice_rows`` hashes at a time on average, and a group of copies of any size brings its slice one row a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ASCII_LOWER, by_bytes, materialize, shuffle_width, table

PROBES = 4
CELLS_PER_ROW = 16
BLOCK = 1 << 16


def _cells(sha: list[bytes], n_cells: int) -> np.ndarray:
    """PROBES cells of each digest, from its own 32-bit words: an array of shape (rows, PROBES)."""
    words = np.frombuffer(b"".join(sha), dtype="<u4").reshape(-1, 8)[:, :PROBES].astype(np.uint64)
    return ((words * np.uint64(n_cells)) >> np.uint64(32)).astype(np.int64)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, 1):
        sha = [hashlib.sha256((v.as_py() or b"").translate(ASCII_LOWER)).digest() for v in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sha, pa.binary())], names=["id", "sha"])


def _enter(n_cells: int):
    """Pass one, per task: cells as (block, offsets entered once, offsets entered more often)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, n = np.unique(_cells(batch.column(0).to_pylist(), n_cells), return_counts=True)
            block, start = np.unique(cell // BLOCK, return_index=True)
            ends = np.append(start[1:], len(cell))
            inside = (cell % BLOCK).astype("<u2")
            rows = [(int(b), inside[s:e][n[s:e] == 1].tobytes(), inside[s:e][n[s:e] > 1].tobytes()) for b, s, e in zip(block, start, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["block", "once", "more"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Saturating addition by block; what stays is the plane of cells entered at least twice."""
    seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for block, once, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            one, two = seen.setdefault(block, (np.zeros(BLOCK, bool), np.zeros(BLOCK, bool)))
            once, more = np.frombuffer(once, "<u2"), np.frombuffer(more, "<u2")
            two[once[one[once]]] = True
            two[more] = True
            one[once] = True
            one[more] = True
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([np.packbits(t, bitorder="little").tobytes() for _, t in seen.values()])], names=["block", "twice"])


def _marked(names: list[str], at: int):
    """Rows plus ``surely`` (the batch holds the hash twice) and ``enters`` (the first of its hash in the batch). Hashes count as equal by 8 bytes here: a false
    ``surely`` only sends a row to the exact grouping."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word = np.frombuffer(b"".join(batch.column(at).to_pylist()), "<u8")[::4]
            _, first, which, n = np.unique(word, return_index=True, return_inverse=True, return_counts=True)
            enters = np.zeros(len(word), bool)
            enters[first] = True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n[which] > 1), pa.array(enters)], names=[*names, "surely", "enters"])

    return run


def _in_slice(at: int, surely: int):
    """Both passes over one slice, whose narrow rows a task holds; ``surely`` becomes ``maybe``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        n_cells = max(1, sum(b.num_rows for b in held)) * CELLS_PER_ROW
        one, two = np.zeros(n_cells, bool), np.zeros(n_cells, bool)
        for batch in held:
            cell, n = np.unique(_cells(batch.column(at).to_pylist(), n_cells), return_counts=True)
            two[cell[one[cell] | (n > 1)]] = True
            one[cell] = True
        for batch in held:
            hit = two[_cells(batch.column(at).to_pylist(), n_cells)].all(axis=1)
            columns = list(batch.columns)
            columns[surely] = pa.array(hit | columns[surely].to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def possibly_repeated(hashes: DataFrame, *, max_filter_bytes: int = 16 << 20, slice_rows: int = 2_000_000) -> DataFrame:
    """Rows of ``hashes`` (with a binary column sha of 32 bytes) plus ``maybe``: false where the hash is surely unique."""
    spark = hashes.sparkSession
    n_rows = hashes.count()
    most = max_filter_bytes * 8
    names, at = hashes.columns, hashes.columns.index("sha")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hashes.schema)
    if n_rows * CELLS_PER_ROW > most:
        marked = materialize(hashes.mapInArrow(_marked(names, at), f"{schema}, surely boolean, enters boolean"), "marked-hashes")
        # A hash that one batch holds twice is known; its row enters twice, for the single ones in other batches.
        twice = marked.where("enters and surely")
        entering = marked.where("enters").unionByName(twice).drop("enters").withColumn("told", F.col("surely"))
        width = -(-n_rows // min(slice_rows, most // CELLS_PER_ROW))
        tested = entering.repartition(width, "sha").mapInArrow(_in_slice(at, len(names)), f"{schema}, surely boolean, told boolean")
        alone = tested.where("not told").select(*names, F.col("surely").alias("maybe"))
        return alone.unionByName(marked.where("surely").select(*names, F.lit(True).alias("maybe")))
    n_cells = max(BLOCK, -(-n_rows * CELLS_PER_ROW // BLOCK) * BLOCK)
    width = min(shuffle_width(spark), n_cells // BLOCK)
    planes = hashes.select("sha").mapInArrow(_enter(n_cells), "block long, once binary, more binary").repartition(width, "block").mapInArrow(_merge, "block long, twice binary")
    twice = np.zeros(n_cells // 8, np.uint8)
    for row in planes.toLocalIterator():  # at most max_filter_bytes in all
        twice[row["block"] * (BLOCK // 8) : (row["block"] + 1) * (BLOCK // 8)] = np.frombuffer(row["twice"], np.uint8)
    shared = spark.sparkContext.broadcast(twice.tobytes())

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            cell = _cells(batch.column(at).to_pylist(), n_cells)
            hit = ((bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1).all(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], names=[*names, "maybe"])

    return hashes.mapInArrow(test, f"{schema}, maybe boolean")


def exact_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = 16 << 20) -> DataFrame:
    """One row per input row: (id_col, keep_id, group_size long, kept boolean, text_sha256 string).

    Texts are equal when identical after lower-casing A-Z; a null text is empty. Of equal texts the row
    with the largest id stays. Rows that repeat an id with the same text are one document given twice:
    they share the verdict, and each counts in group_size. A null id never wins against another; in a group
    with null ids only, keep_id is null and the rows are kept. No other column is read, so names cannot clash.
    An empty table gives no rows. Texts of any length are hashed whole.
    """
    kind = df.schema[id_col].dataType.simpleString()
    hashed = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(_digests, f"id {kind}, sha binary")
    tested = materialize(possibly_repeated(materialize(hashed, "hashes"), max_filter_bytes=max_filter_bytes), "tested")
    maybe = tested.where("maybe").select("id", "sha")
    # Written first, so that its size is known when the join is planned: small, it is broadcast by Spark's own check and
    # the rows of a hot group stay where they are; large, Spark's skewed join splits them.
    groups = materialize(maybe.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    judged = maybe.join(groups, "sha").select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha")
    straight = tested.where(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return straight.unionByName(judged).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""
