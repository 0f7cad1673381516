"""Line dedup that can be undone: sharded cuckoo filters backed by exact reference-count tables.

The state is a table (key -> number of documents that hold the line) and, per shard of the key space, a
cuckoo filter over the keys at or above the threshold. Inserting documents adds to the counts, deleting
documents subtracts; keys that cross the threshold enter or leave their shard's filter, which a cuckoo
filter can do and a Bloom filter cannot. delete(insert(x)) restores counts and verdicts exactly.

Applying the state reads each text once: lines that a filter knows are dropped at once, and their keys are
noted. The noted keys are checked against the exact table; documents in which a filter gave a false alarm
(about 1 line in 8000) are done again without it. Filters are read and broadcast in rounds of at most
``max_filter_bytes`` (or one shard); each round drops the lines of its own shards and is written before the next one's filters
are read, so more state means more rounds, not more memory. Counts are partially summed per part of a batch and per task, so one line in
a third of all documents is cheap. Texts are taken apart a few megabytes at a time.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .prefilter import Filter
from .shared import ASCII_LOWER, by_bytes, forget, materialize, shuffle_width, table

BLANKS = b" \t\n\x0b\x0c\r"
SLOTS = 4
KEY = 16


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).translate(ASCII_LOWER)


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars < 2 or len(key.decode("utf-8", "replace")) >= min_chars)


def _parts(digests: np.ndarray, n_shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, bucket seed and nonzero 16-bit fingerprint of digests of shape (n, 2) uint64."""
    shard = (digests[:, 0] % np.uint64(n_shards)).astype(np.int64)
    prints = (digests[:, 1] & np.uint64(0xFFFF)).astype(np.int64)
    return shard, (digests[:, 1] >> np.uint64(16)).astype(np.int64), np.where(prints == 0, 1, prints)


def _other(bucket, fingerprint, mask):
    """The partner bucket; applied twice it gives the first one back."""
    return (bucket ^ (fingerprint * 0x5BD1E995)) & mask


class CuckooFilter:
    """Partial-key cuckoo filter: power-of-two buckets of four 16-bit fingerprints, 0 meaning free."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots
        self.mask = len(slots) - 1

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        buckets = 1 << max(2, (int(n / (SLOTS * 0.8)) or 1).bit_length())
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def loads(cls, blob: bytes) -> CuckooFilter:
        return cls(np.frombuffer(blob, "<u2").reshape(-1, SLOTS).copy())

    def dumps(self) -> bytes:
        return self.slots.astype("<u2").tobytes()

    def _put(self, bucket: int, fingerprint: int) -> bool:
        free = np.flatnonzero(self.slots[bucket] == 0)
        if len(free):
            self.slots[bucket, free[0]] = fingerprint
        return bool(len(free))

    def fill(self, seeds: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Enter keys wherever their first bucket, then their second, has a free slot; the indices of those for which neither had."""
        left = np.arange(len(seeds))
        for second in (False, True):
            bucket = seeds[left] & self.mask
            bucket = _other(bucket, prints[left], self.mask) if second else bucket
            order = np.argsort(bucket, kind="stable")
            sorted_buckets = bucket[order]
            new = np.flatnonzero(np.concatenate([[True], sorted_buckets[1:] != sorted_buckets[:-1]])) if len(order) else np.zeros(0, np.int64)
            rank = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
            slot = (self.slots[sorted_buckets] != 0).sum(axis=1) + rank  # slots are taken from the first on
            fits = slot < SLOTS
            self.slots[sorted_buckets[fits], slot[fits]] = prints[left[order[fits]]]
            left = left[order[~fits]]
        return left

    def insert(self, seed: int, fingerprint: int) -> bool:
        """False where the filter is too full; its content is then no longer complete and it must be rebuilt."""
        bucket = seed & self.mask
        if self._put(bucket, fingerprint) or self._put(bucket := _other(bucket, fingerprint, self.mask), fingerprint):
            return True
        for kick in range(500):
            slot = kick % SLOTS
            fingerprint, self.slots[bucket, slot] = int(self.slots[bucket, slot]), fingerprint
            if self._put(bucket := _other(bucket, fingerprint, self.mask), fingerprint):
                return True
        return False

    def delete(self, seed: int, fingerprint: int) -> bool:
        for bucket in (seed & self.mask, _other(seed & self.mask, fingerprint, self.mask)):
            found = np.flatnonzero(self.slots[bucket] == fingerprint)
            if len(found):
                self.slots[bucket, found[0]] = 0
                return True
        return False


def _as_words(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)


def _filled(keys: list[bytes], n_shards: int) -> bytes:
    """A filter of these keys of one shard; doubled until all fit.

    Keys that find room in one of their buckets are entered all at once; only those that meet full buckets are entered one by one.
    """
    _, seeds, prints = _parts(_as_words(keys), n_shards)
    n = len(keys)
    while True:
        built = CuckooFilter.sized(n)
        left = built.fill(seeds, prints)
        if all(built.insert(s, p) for s, p in zip(seeds[left].tolist(), prints[left].tolist(), strict=True)):
            return built.dumps()
        n *= 2


def _count_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 0):
            n: Counter = Counter()
            for value in batch.column(0):
                n.update({xxhash.xxh3_128_digest(k) for k in {line_key(x) for x in (value.as_py() or b"").split(b"\n")} if long_enough(k, min_chars)})
            yield pa.RecordBatch.from_arrays([pa.array(list(n.keys()), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["key", "refs"])

    return run


class Probe:
    """The filters of one round laid end to end, for lookups of many digests at once."""

    def __init__(self, filters: dict[int, bytes], n_shards: int):
        self.n_shards = n_shards
        self.base, self.mask = np.full(n_shards, -1, np.int64), np.zeros(n_shards, np.int64)
        tables, at = [], 0
        for shard, blob in filters.items():
            slots = np.frombuffer(blob, "<u2").reshape(-1, SLOTS)
            self.base[shard], self.mask[shard] = at, len(slots) - 1
            tables.append(slots)
            at += len(slots)
        self.slots = np.concatenate(tables) if tables else np.zeros((1, SLOTS), np.uint16)

    def hits(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        shard, seed, prints = _parts(_as_words(keys), self.n_shards)
        base, mask = self.base[shard], self.mask[shard]
        bucket = seed & mask
        at = np.maximum(base, 0)
        found = (self.slots[at + bucket] == prints[:, None]).any(axis=1) | (self.slots[at + _other(bucket, prints, mask)] == prints[:, None]).any(axis=1)
        return found & (base >= 0)


def _drop(batch_texts: list[bytes], probe: Probe, min_chars: int, spared: list[set]) -> list[tuple[bytes, int, int, list[bytes]]]:
    """Of each text: what stays, number of lines, number dropped, and the distinct keys dropped."""
    lines = [t.split(b"\n") for t in batch_texts]
    flat = [line_key(x) for doc in lines for x in doc]
    valid = [long_enough(k, min_chars) for k in flat]
    digests = [xxhash.xxh3_128_digest(k) for k in flat]
    hit = probe.hits(digests) & np.array(valid, bool)
    out, at = [], 0
    for doc, spare in zip(lines, spared, strict=True):
        gone = [bool(hit[at + i]) and digests[at + i] not in spare for i in range(len(doc))]
        out.append((b"\n".join(x for x, g in zip(doc, gone, strict=True) if not g), len(doc), sum(gone), list({digests[at + i] for i, g in enumerate(gone) if g})))
        at += len(doc)
    return out


@dataclass(frozen=True)
class LineIndex:
    """refs(key binary, refs long): the exact counts; filters(shard int, filter binary): keys with refs >= min_docs."""

    refs: DataFrame
    filters: DataFrame
    n_shards: int
    min_docs: int
    min_chars: int
    max_filter_bytes: int = 32 << 20
    keys_per_shard: int = 1 << 20

    @classmethod
    def build(cls, docs: DataFrame, *, text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keys_per_shard: int = 1 << 20) -> LineIndex:
        """An index of the lines of all documents, each document counting once for a line."""
        refs = materialize(_counted(docs, text_col, min_chars), "line-refs")
        n_shards = max(1, -(-refs.count() // keys_per_shard))
        frequent = refs.where(F.col("refs") >= min_docs).select("key")
        return cls(refs, materialize(_filters(frequent, n_shards), "line-filters"), n_shards, min_docs, min_chars, keys_per_shard=keys_per_shard)

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        return self._changed(docs, text_col, 1)

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """Take documents out again. They must have been inserted before."""
        return self._changed(docs, text_col, -1)

    def _changed(self, docs: DataFrame, text_col: str, sign: int) -> LineIndex:
        delta = _counted(docs, text_col, self.min_chars).withColumn("refs", F.col("refs") * sign)
        both = self.refs.withColumn("old", F.col("refs")).unionByName(delta.withColumn("old", F.lit(0).cast("long")))
        summed = materialize(both.groupBy("key").agg(F.sum("refs").alias("refs"), F.sum("old").alias("old")), "line-sums")
        needed = -(-summed.where("refs > 0").count() // self.keys_per_shard)
        if needed > 2 * self.n_shards:  # shards have outgrown their size: deal the keys anew
            refs = summed.where(F.col("refs") > 0).select("key", "refs")
            frequent = refs.where(F.col("refs") >= self.min_docs).select("key")
            return replace(self, refs=refs, filters=materialize(_filters(frequent, needed), "line-filters"), n_shards=needed)
        moved = summed.where((F.col("refs") >= self.min_docs) != (F.col("old") >= self.min_docs)).select(_shard(self.n_shards).alias("shard"), "key", (F.col("refs") >= self.min_docs).alias("enters"))
        n_shards = self.n_shards

        def update(old: pa.Table, new: pa.Table) -> pa.Table:
            """Deletions and insertions into one shard's filter; a filter that overflows comes back null."""
            held = CuckooFilter.loads(old["filter"][0].as_py()) if old.num_rows else CuckooFilter.sized(new.num_rows)
            ok = True
            if new.num_rows:
                _, seeds, prints = _parts(_as_words(new["key"].to_pylist()), n_shards)
                moves = sorted(zip(new["enters"].to_pylist(), seeds.tolist(), prints.tolist(), strict=True))
                ok = all([held.insert(s, p) if enters else held.delete(s, p) for enters, s, p in moves])
            shard = (old if old.num_rows else new)["shard"][0].as_py()
            return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([held.dumps() if ok else None], pa.binary())})

        changed = materialize(self.filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInArrow(update, "shard int, filter binary"), "line-filters")
        refs = summed.where(F.col("refs") > 0).select("key", "refs")
        frequent = refs.where(F.col("refs") >= self.min_docs)
        again = frequent.join(changed.where(F.col("filter").isNull()).select("shard"), _shard(self.n_shards) == F.col("shard"), "left_semi")
        filters = changed.where(F.col("filter").isNotNull()).unionByName(_filters(again.select("key"), self.n_shards))
        return replace(self, refs=refs, filters=materialize(filters, "line-filters"))

    def _rounds(self) -> Iterator[dict[int, bytes]]:
        """The filters, some at a time."""
        group: dict[int, bytes] = {}
        size = 0
        for row in self.filters.toLocalIterator():  # one partition at a time
            if group and size + len(row["filter"]) > self.max_filter_bytes:
                yield group
                group, size = {}, 0
            group[row["shard"]] = bytes(row["filter"])
            size += len(row["filter"])
        yield group

    def _passes(self, frame: DataFrame, text_col: str, digest_only: bool) -> DataFrame:
        """``frame`` after all rounds, written; of what was written between rounds nothing stays."""
        spark, before, rounds = frame.sparkSession, None, self._rounds()
        group = next(rounds)
        while group is not None:
            after = next(rounds, None)
            shared = spark.sparkContext.broadcast((group, self.n_shards))  # max_filter_bytes, or one shard
            frame = materialize(_one_round(frame, text_col, shared, self.min_chars, digest_only and after is None), "line-pass")
            shared.unpersist()
            if before is not None:
                forget(spark, before)
            before, group = frame, after
        return frame

    def apply(self, docs: DataFrame, *, text_col: str = "text", digest_only: bool = False) -> DataFrame:
        """docs with frequent lines dropped from ``text_col``, plus __n_lines and __n_dropped (longs).

        With ``digest_only`` the text column holds the lowercase hex SHA-256 of what stays. All other columns pass
        unchanged, of whatever type and name (but for those that begin with two underscores, which are reserved).
        """
        spark = docs.sparkSession
        # What is dropped hangs on the text alone, so its hash names the rows that must be done again.
        start = docs.withColumns({"__row": F.xxhash64(F.col(f"`{text_col}`")), "__n_lines": F.lit(0).cast("long"), "__n_dropped": F.lit(0).cast("long"), "__hits": F.array().cast("array<binary>")})
        done = self._passes(start, text_col, digest_only)
        # Few keys, and written first: the join that finds their documents is then planned by their size.
        hit = done.select(F.explode("__hits").alias("key")).distinct()
        wrong = materialize(hit.join(self.refs.where(F.col("refs") >= self.min_docs), "key", "left_anti"), "false-alarms")
        redo = materialize(done.select("__row", F.explode("__hits").alias("key")).join(wrong, "key", "left_semi").groupBy("__row").agg(F.collect_set("key").alias("__spare")), "line-redo")
        if redo.isEmpty():
            forget(spark, wrong, redo)
            return done.drop("__row", "__hits")
        maybe = Filter(redo.select("__row"))
        sought = redo.select(F.col("__row").alias("__again"), "__spare")
        # Only texts that may have to be done again shuffle, if the joins do.
        again = maybe.mark(start, F.col("__row"), "__maybe").where("__maybe").drop("__maybe").join(sought, F.col("__row") == F.col("__again")).drop("__again")
        again = self._passes(again, text_col, digest_only).drop("__spare")
        marked = maybe.mark(done, F.col("__row"), "__maybe")
        right = marked.where("not __maybe").unionByName(marked.where("__maybe").join(sought, F.col("__row") == F.col("__again"), "left_anti")).drop("__maybe")
        return right.unionByName(again).drop("__row", "__hits")


def _one_round(frame: DataFrame, text_col: str, shared, min_chars: int, digest: bool) -> DataFrame:
    names = frame.columns
    at, n, d, h = (names.index(c) for c in (text_col, "__n_lines", "__n_dropped", "__hits"))
    spare = names.index("__spare") if "__spare" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = Probe(*shared.value)
        for batch in by_bytes(batches, at):
            texts = [(v.as_py() or "").encode() for v in batch.column(at)]
            spared = [set(x) for x in batch.column(spare).to_pylist()] if spare is not None else [set()] * len(texts)
            rows = _drop(texts, probe, min_chars, spared)
            columns = list(batch.columns)
            columns[at] = pa.array([hashlib.sha256(r[0]).hexdigest() if digest else r[0].decode() for r in rows], pa.string()).cast(batch.column(at).type)
            columns[n] = pa.array([old or r[1] for r, old in zip(rows, batch.column(n).to_pylist(), strict=True)], pa.int64())
            columns[d] = pa.array([r[2] + old for r, old in zip(rows, batch.column(d).to_pylist(), strict=True)], pa.int64())
            columns[h] = pa.array([old + r[3] for r, old in zip(rows, batch.column(h).to_pylist(), strict=True)], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=plain)

    # By place: mapInArrow() cannot take names with dots.
    plain = [f"c{k}" for k in range(len(names))]
    renamed = frame.toDF(*plain)
    return renamed.mapInArrow(run, renamed.schema).toDF(*names)


def _shard(n_shards: int) -> F.Column:
    """The shard of a key, as _parts() has it: its first 8 bytes, little-endian, modulo n_shards."""
    swapped = F.concat(*(F.substring(F.hex("key"), 2 * i + 1, 2) for i in reversed(range(8))))
    high, low = F.conv(F.substring(swapped, 1, 8), 16, 10).cast("long"), F.conv(F.substring(swapped, 9, 8), 16, 10).cast("long")
    return (((high % n_shards) * F.lit((1 << 32) % n_shards) + low % n_shards) % n_shards).cast("int")


def _counted(docs: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    rows = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(_count_lines(min_chars), "key binary, refs long")
    return rows.groupBy("key").agg(F.sum("refs").alias("refs"))


def _filters(frequent: DataFrame, n_shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys come in order of shard, so one shard is held at a time."""
        now, held = None, []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([_filled(held, n_shards)], pa.binary())], names=["shard", "filter"])

        for batch in batches:
            for shard, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != now and held:
                    yield made()
                    held = []
                now = shard
                held.append(key)
        if held:
            yield made()

    width = min(n_shards, shuffle_width(frequent.sparkSession))
    return frequent.select(_shard(n_shards).alias("shard"), "key").repartition(width, "shard").sortWithinPartitions("shard").mapInArrow(run, "shard int, filter binary")


def dedup_lines(docs: DataFrame, *, text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs without the lines whose key stands in at least ``min_docs`` of them; see LineIndex.apply().

    A key is the line without blanks (space, tab to carriage return) at both ends, A-Z lower-cased; keys of fewer
    than ``min_chars`` code points are never dropped. A null or empty text is one empty line; a text all of whose
    lines go becomes empty. Repeated rows count as documents of their own. An empty table stays empty.
    """
    return LineIndex.build(docs, text_col=text_col, min_docs=min_docs, min_chars=min_chars).apply(docs, text_col=text_col)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = LineIndex.build(docs, min_docs=10, min_chars=1).apply(docs, digest_only=True)
    return kept.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.col("text").alias("kept_sha256"))


SQL = """
WITH l AS (
  SELECT doc_id, row, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM (SELECT doc_id, text, row_number() OVER () AS row FROM documents)
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id, row
"""
