"""SimHash near-duplicates by bit-sliced comparison.

Each document gets a 64-bit fingerprint of its word shingles. Different fingerprints are put into blocks by keys that any
two linked ones must (or, for wide radii, all but surely do) share; within a block distances are found for 64 fingerprints at
once: the block's bits are stored as vertical planes, a query's bit turns a plane into a plane of differences, carry-save
adders sum three such planes into bit-sliced counters, and a word whose 64 lanes have all passed the radius is abandoned.

Small radii use exact keys: with radius r and n_blocks blocks of bits, two fingerprints within r agree on some
n_blocks - r blocks, so every choice of that many blocks is a key, and no link is lost. Near-duplicate removal at a Jaccard
similarity uses minimum hashes of the shingles as keys, a wide radius, sketches of the sets, and then an exact check on the shingle sets.

Equal fingerprints are one node, so groups of exact copies cost nothing. A block of more than ``tile`` fingerprints is
dealt out as pairs of tiles to different tasks. A block returns links that span its groups, not all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .prefilter import Filter, without
from .shared import ASCII_LOWER, by_bytes, forget, materialize, shuffle_width, table

SEED = 42
TILE = 2048
#: Rows of five numbers, at most 40 MB, that may be broadcast.
BROADCAST_ROWS = 500_000
#: Query and word pairs compared at once: bounds the memory of a comparison.
PAIRS = 1 << 16


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of ``width`` words, repeats included; of all words where there are fewer; none without words."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[: -width]]).tolist()
    return np.fromiter((h(joined[s:e], SEED) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set where bit i is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _add(counters: list[np.ndarray], plane: np.ndarray, level: int, over: np.ndarray) -> np.ndarray:
    """Add a plane of weight 2**level to the bit-sliced counters; what carries out of the top has passed any radius."""
    for k in range(level, len(counters)):
        counters[k], plane = counters[k] ^ plane, counters[k] & plane
    return over | plane


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter exceeds the radius, compared from the top bit down."""
    more, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            more |= equal & counters[k]
            equal &= ~counters[k]
    return more


def close_pairs(prints: np.ndarray, starts: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) within a group whose fingerprints differ in at most ``radius`` bits.

    ``prints`` holds the groups end to end, ``starts`` their first positions.
    """
    sizes = np.diff(np.append(starts, len(prints)))
    words = -(-sizes // 64)
    base = np.concatenate([[0], np.cumsum(words)[:-1]])
    inside = np.arange(len(prints)) - np.repeat(starts, sizes)
    word = np.repeat(base, sizes) + inside // 64
    lane = (inside % 64).astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    planes = [np.bitwise_or.reduceat(((prints >> np.uint64(b)) & np.uint64(1)) << lane, first) for b in range(64)]
    valid = np.bitwise_or.reduceat(np.uint64(1) << lane, first)
    last = np.repeat(base + words, sizes)
    n_pairs = last - word  # each query meets its own word and the later ones
    ends = np.cumsum(n_pairs)
    n_counters = max(1, radius.bit_length())
    at = 0
    while at < len(prints):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        n = n_pairs[at:upto]
        q = np.repeat(np.arange(at, upto), n)
        w = word[q] + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
        live = valid[w]
        own = w == word[q]
        live[own] &= ~((np.uint64(2) << lane[q[own]]) - np.uint64(1))  # only later lanes
        keep = live != 0
        q, w, live = q[keep], w[keep], live[keep]
        counters, over = [np.zeros(len(q), np.uint64) for _ in range(n_counters)], np.zeros(len(q), np.uint64)
        for step, bit in enumerate(range(0, 63, 3)):
            a, b, c = (planes[k][w] ^ (np.uint64(0) - ((prints[q] >> np.uint64(k)) & np.uint64(1))) for k in (bit, bit + 1, bit + 2))
            half = a ^ b
            over = _add(counters, half ^ c, 0, over)
            carry = (a & b) | (c & half)
            over = _add(counters, carry, 1, over) if n_counters > 1 else over | carry
            if step % 4 == 3:
                live = live & ~(over | _above(counters, radius))
                keep = live != 0
                if keep.mean() < 0.75:
                    q, w, live, over, counters = q[keep], w[keep], live[keep], over[keep], [x[keep] for x in counters]
            if not len(q):
                break
        if len(q):
            over = _add(counters, planes[63][w] ^ (np.uint64(0) - ((prints[q] >> np.uint64(63)) & np.uint64(1))), 0, over)
            live = live & ~(over | _above(counters, radius))
            keep = np.flatnonzero(live)
            if len(keep):
                bits = np.unpackbits(live[keep].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                row, col = np.nonzero(bits)
                home = starts[np.searchsorted(starts, q[keep][row], side="right") - 1]
                yield q[keep][row], home + (w[keep][row] - word[home]) * 64 + col
        at = upto


def roots_of(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Smallest linked index of each of n nodes, by hooking and pointer jumping."""
    root = np.arange(n) if root is None else root
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = np.minimum(root, before)
        while not np.array_equal(jumped := root[root], root):
            root = jumped
        if np.array_equal(root[a], root[b]):
            return root


def _alike(sizes: np.ndarray, sketches: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes and sketches may have the similarity: sizes rule out nothing that has it, sketches hardly anything."""
    ratio = np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b])
    return ratio & (np.bitwise_count(sketches[:, a] ^ sketches[:, b]).sum(axis=0, dtype=np.int64) <= sketch_radius(similarity))


def _links_in(prints: np.ndarray, starts: np.ndarray, radius: int, alike: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (later, root) that span the groups of close fingerprints, of which only the pairs that are ``alike`` count."""
    root = np.arange(len(prints))
    for a, b in close_pairs(prints, starts, radius):
        if alike is not None:
            keep = alike(a, b)
            a, b = a[keep], b[keep]
        root = roots_of(len(prints), a, b, root)
    at = np.flatnonzero(root != np.arange(len(prints)))
    return at, root[at]


def _compare(radius: int, similarity: float) -> Callable:
    """Streams rows (key, tile keys, node, fp[, n, s0, s1]) sorted by block; yields spanning links (a, b) of each block."""

    def links(block: list[pa.RecordBatch], last: bool) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
        rows = pa.Table.from_batches(block).combine_chunks()
        key, i, j, node, fp = (rows[c].to_numpy() for c in ("key", "i", "j", "node", "fp"))
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        end = len(key) if last else int(new[-1])
        rest = [] if last else pa.Table.to_batches(rows.slice(end))
        starts = new[new < end]
        if not end:
            return None, rest
        sizes = np.diff(np.append(starts, end))
        keep = np.repeat(sizes > 1, sizes)
        if not keep.any():
            return None, rest
        node, prints = node[:end][keep], fp[:end][keep].view(np.uint64)
        kept = sizes[sizes > 1]
        alike = None
        if similarity:
            n, sketches = rows["n"].to_numpy()[:end][keep], np.stack([rows[c].to_numpy()[:end][keep].view(np.uint64) for c in SKETCH])
            alike = lambda a, b: _alike(n, sketches, a, b, similarity)
        a, b = _links_in(prints, np.cumsum(kept) - kept, radius, alike)
        return (pa.RecordBatch.from_arrays([pa.array(node[b]), pa.array(node[a])], names=["a", "b"]) if len(a) else None), rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                out, held = links([*held, batch], False)
                if out is not None:
                    yield out
        if held:
            out, _ = links(held, True)
            if out is not None:
                yield out

    return run


def candidate_links(keyed: DataFrame, radius: int, *, tile: int = TILE, similarity: float = 0.0) -> DataFrame:
    """Spanning links (a, b) among rows keyed(key long, node long, fp long) of one key whose fingerprints are within the radius.

    With a ``similarity`` the columns n int, s0 and s1 long hold the size and the sketch of each set, and only pairs count that may be so similar.
    """
    carried = ["node", "fp", *(("n", *SKETCH) if similarity else ())]
    big = materialize(keyed.groupBy("key").count().where(F.col("count") > tile).select("key", F.ceil(F.col("count") / tile).cast("int").alias("tiles")), "big-blocks")
    mine = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    partners = F.transform(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1), lambda t: F.struct(F.least(t, F.coalesce(mine, F.lit(0))).alias("i"), F.greatest(t, F.coalesce(mine, F.lit(0))).alias("j")))
    dealt = keyed.join(big, "key", "left").select("key", *carried, F.explode(partners).alias("p")).select("key", "p.i", "p.j", *carried)
    width = shuffle_width(keyed.sparkSession)
    return dealt.repartition(width, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compare(radius, similarity), "a long, b long")


def block_keys(fp: Column, radius: int, n_blocks: int) -> Column:
    """Keys of which two fingerprints within the radius share at least one: the bits of every n_blocks - radius of n_blocks blocks."""
    edges = [64 * k // n_blocks for k in range(n_blocks + 1)]
    masks = [sum(((1 << edges[k + 1]) - (1 << edges[k])) for k in chosen) for chosen in combinations(range(n_blocks), n_blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(m))) for k, m in enumerate(signed)))


def _fingerprints(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            prints = [fingerprint(shingle_hashes(v.as_py() or b"", width)) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["id", "fp"])

    return run


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, n_blocks: int = 4) -> DataFrame:
    """One row per input row: (id_col, fingerprint string, component_id).

    Words are runs of characters other than space and tab to carriage return, A-Z lower-cased; a null text is empty; a text without words
    has fingerprint zero, which links like any other. component_id is the smallest id that is reachable over links of at most ``radius``
    bits, itself included; null ids count for nothing unless no other id is there. Repeated rows get equal results. Other columns are not
    read. An empty table gives no rows. Every link between different fingerprints within the radius is found.
    """
    if not 0 <= radius < n_blocks:
        raise ValueError("the radius must be less than the number of blocks")
    kind = docs.schema[id_col].dataType.simpleString()
    prints = materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(_fingerprints(width), f"id {kind}, fp long"), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    keyed = nodes.select(F.explode(block_keys(F.col("fp"), radius, n_blocks)).alias("key"), F.col("fp").alias("node"), "fp")
    roots = components(candidate_links(keyed, radius))
    linked = nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "root", "low")
    lowest = linked.groupBy("root").agg(F.min("low").alias("component"))
    grouped = linked.join(lowest, "root").select("fp", "component")
    alone = nodes.where("n > 1").join(grouped.select("fp"), "fp", "left_anti").select("fp", F.col("low").alias("component"))
    told = materialize(grouped.unionByName(alone), "fingerprint-components")
    return prints.join(told, "fp", "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component", "id").alias("component_id"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


# Near copies by similarity: minimum-hash keys, a wide radius, and an exact check.

N_KEYS = 6
#: A bit of the minimum under each of 128 hash functions, in two words.
SKETCH_BITS, SKETCH = 128, ("s0", "s1")
_SKETCHERS = np.random.default_rng(SEED + 1).integers(0, 1 << 31, SKETCH_BITS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def sketch_radius(similarity: float) -> int:
    """Sketches of two sets of the similarity differ in more bits with a probability of less than 0.00005."""
    p = (1 - similarity) / 2
    tail, at = 0.0, SKETCH_BITS
    while at and (tail := tail + comb(SKETCH_BITS, at) * p**at * (1 - p) ** (SKETCH_BITS - at)) < 5e-5:
        at -= 1
    return at


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Two words of one bit for each hash function: two sets differ in a bit with half the probability that their minima differ."""
    h, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(SKETCH_BITS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(h), 1024):
        least = np.minimum(least, (_SKETCHERS[:, None] * h[None, at : at + 1024]).min(axis=1))
    return np.packbits(least * np.uint32(0x9E3779B1) >> np.uint32(31) == 1, bitorder="little").view("<u8")


def _set_of(text: bytes, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def _signatures(width: int) -> Callable:
    multipliers = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, N_KEYS, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2):
            prints, sizes, digests, keys, sketches = [], [], [], [], []
            for v in batch.column(2):
                s = _set_of(v.as_py() or b"", width)
                prints.append(fingerprint(s))  # of the set, as the similarity is: repeats within a text count for nothing
                sizes.append(len(s))
                sketches.append(sketch(s))
                digests.append(xxhash.xxh3_128_digest(s.astype("<u8").tobytes()))
                keys.append([xxhash.xxh3_64_intdigest(k.to_bytes(1, "little") + int((s * m).min()).to_bytes(8, "little")) >> 1 for k, m in enumerate(multipliers)] if len(s) else [])
            columns = [batch.column(0), batch.column(1), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            columns += [pa.array(np.ascontiguousarray(w).view(np.int64)) for w in np.array(sketches, np.uint64).reshape(-1, len(SKETCH)).T]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "hash", "fp", "n", "digest", "keys", *SKETCH])

    return run


def similar_links(prints: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> Iterator[tuple[int, int]]:
    """Links that span the groups in which each document has a Jaccard similarity of ``similarity`` or more to another one.

    Pairs within the radius are tried from the closest on, and skipped where they are linked already.
    """
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sizes = np.array([len(s) for s in sets])
    near, a, b = [], [], []
    for i in range(len(sets) - 1):
        d = np.bitwise_count(prints[i + 1 :] ^ prints[i])
        ok = np.flatnonzero((d <= radius) & (np.minimum(sizes[i + 1 :], sizes[i]) >= similarity * np.maximum(sizes[i + 1 :], sizes[i])))
        near.append(d[ok])
        a.append(np.full(len(ok), i))
        b.append(ok + i + 1)
    if not near:
        return
    order = np.argsort(np.concatenate(near), kind="stable")
    for i, j in zip(np.concatenate(a)[order].tolist(), np.concatenate(b)[order].tolist(), strict=True):
        ri, rj = find(i), find(j)
        if ri != rj:
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if shared >= similarity * (len(sets[i]) + len(sets[j]) - shared):
                root[max(ri, rj)] = min(ri, rj)
                yield i, j


def _verify(width: int, radius: int, similarity: float) -> Callable:
    """Streams rows (root, i, j, node, fp, text) sorted by group; yields verified links (a, b). Sets are made here: texts are smaller on the way."""

    def links(rows: list[tuple]) -> pa.RecordBatch:
        nodes = [r[0] for r in rows]
        found = list(similar_links(np.array([r[1] for r in rows], np.int64).view(np.uint64), [r[2] for r in rows], radius, similarity))
        return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[j] for _, j in found], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group = None
        for batch in by_bytes(batches, 5):
            for *key, node, fp, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != group and held:
                    yield links(held)
                    held = []
                group = key
                held.append((node, fp, _set_of(text or b"", width)))
        if held:
            yield links(held)

    return run


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, radius: int = 20, tile: int = 512) -> DataFrame:
    """(id, hash, keeper) for every document that is not the one to keep of its group; hash is xxhash64 of the text.

    Two documents are linked when the sets of their ``width``-word shingles (all words, where there are fewer) have a Jaccard similarity
    of ``similarity`` or more; the document with the smallest id of each connected group stays. Two linked ones share one of six
    minimum hashes with probability 1 - 0.2**6 at a similarity of 0.8, and the fingerprints of their sets lie within 20 of 64 bits with
    more than 0.999. Fingerprints alone would chain a share of the corpus that grows with it into one group, whose texts would have to meet
    each other; so a pair's set sizes and sketches of 128 bits must allow the similarity too (one in 20,000 pairs at 0.8 is lost by that,
    fewer above). What is found is checked exactly. Texts without words, null or empty, are copies of each other; so are repeated rows. A null id is
    never kept where another is there. Other columns are not read. A text of any length is compared whole; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).cast("binary").alias("text"))
    signed = materialize(rows.mapInArrow(_signatures(width), f"id {kind}, hash long, fp long, n int, digest binary, keys array<long>, s0 long, s1 long").withColumn("node", F.xxhash64("digest")), "signatures")
    nodes = materialize(signed.groupBy("node").agg(F.min(F.struct("id", "hash")).alias("any"), F.min("id").alias("low"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), *(F.first(c).alias(c) for c in ("n", *SKETCH)), F.count(F.lit(1)).alias("copies")), "different-texts")
    near = components(candidate_links(nodes.select(F.explode("keys").alias("key"), "node", "fp", "n", *SKETCH), radius, similarity=similarity))
    asked = materialize(near.join(nodes, "node").select("root", "node", "fp", F.col("any.id").alias("i"), F.col("any.hash").alias("h")), "near-texts")
    # Only texts that may be asked for shuffle.
    wanted = Filter(asked.select("h"))
    # Where the narrow side is of a size that any executor holds, texts need not move to meet it; beyond that Spark plans the join by size.
    small = asked.schema["i"].dataType.simpleString() in ("int", "bigint") and asked.count() <= BROADCAST_ROWS
    fetched = wanted.mark(rows, F.col("hash"), "maybe").where("maybe").join(F.broadcast(asked) if small else asked, F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")))
    big = materialize(asked.groupBy("root").count().where(F.col("count") > tile).select("root", F.ceil(F.col("count") / tile).cast("int").alias("tiles")), "big-groups")
    mine = F.coalesce(F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"), F.lit(0))
    partners = F.transform(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1), lambda t: F.struct(F.least(t, mine).alias("i"), F.greatest(t, mine).alias("j")))
    dealt = fetched.select("root", "node", "fp", "text").join(big, "root", "left").select("root", F.explode(partners).alias("p"), "node", "fp", "text").select("root", "p.i", "p.j", "node", "fp", "text")
    checked = dealt.repartition(shuffle_width(docs.sparkSession), "root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_verify(width, radius, similarity), "a long, b long")
    groups = components(checked)
    linked = nodes.join(groups, "node").select("node", "root", "low")
    keepers = linked.join(linked.groupBy("root").agg(F.min("low").alias("keeper")), "root").select("node", "keeper")
    alone = nodes.where("copies > 1").join(keepers.select("node"), "node", "left_anti").select("node", F.col("low").alias("keeper"))
    told = materialize(keepers.unionByName(alone), "keepers")
    out = materialize(signed.join(told, "node").where(~F.col("id").eqNullSafe(F.col("keeper"))).select("id", "hash", "keeper"), "copies")
    wanted.forget()
    forget(docs.sparkSession, signed, nodes, asked, big, told)
    return out


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each group of near copies (see near_copies()), all columns as they were, whatever their names and types.

    Null and empty texts and those of blanks alone are one group. Of copies the smallest id stays; rows that repeat the id and text that
    stays all stay. An empty table stays empty.
    """
    copies = near_copies(docs, id_col=id_col, text_col=text_col, **options)
    gone = materialize(copies.select("id", "hash").distinct(), "near-copies")
    forget(docs.sparkSession, copies)
    return without(docs, gone, id_col, F.xxhash64(F.col(f"`{text_col}`")))
