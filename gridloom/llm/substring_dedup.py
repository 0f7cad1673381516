"""Exact substring dedup: bytes covered by a string of ``length`` bytes that also starts in a document with a smaller id are removed.

Equal strings must meet. Each window of ``length`` bytes is routed by its minimizer - the least hash of its 16-byte grams -
which depends on the window alone, so equal windows go to the same place wherever they stand. Neighbouring windows
mostly share a minimizer and travel as one segment.

1. Documents are packed into chunks, written once to the shared folder, bucketed by chunk. They are dealt by the least hash of all their
   grams, which near copies mostly share, so that their common segments are found equal within a chunk and move once; Spark splits
   a share that a large group of copies makes too big.
2. Each chunk sends the minimizers that it holds (about 3 bytes each); the answer says which occur in two documents or more, and which
   of those have so many different segments that they must be split.
3. Each chunk sends the different segments of repeated minimizers, with the least and the largest document id that hold them here: one
   row to each group of minimizers. Segments of a minimizer that must be split go as single windows, dealt by the hash of the window,
   so a passage that stands in many different surroundings spreads over groups too.
4. A group cuts its segments, in order of minimizer, into texts of about ``slice_bytes``. Of each it sorts the suffixes to the depth that
   matters, takes the Burrows-Wheeler transform and derives common prefixes by increasing value: breadth-first, every interval of
   suffixes that share a string is extended to the left by each character before it, and the end of the interval thus found, if not
   set yet, gets the current value. The search stops at ``length``; suffixes between which nothing was set share ``length`` bytes or
   more. The least document id of each such group goes back to the chunks that have a larger one.
5. Each chunk marks its windows and returns its documents.

Only different segments per chunk move, so a passage that a third of all documents hold costs its group one entry a chunk, and
no task holds a group of documents. Text moves only in repeated segments. Chunks and groups grow with the root of the corpus, up to
8 and 4 times, so that a row between them holds hundreds of segments up to several TB, and tens beyond; there are never more rows than
segments. Within a chunk segments are told apart by a 64-bit hash of their bytes and length (two different ones of 8 MB
are confused with a probability of about 1e-8); groups compare bytes.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import forget, forget_path, materialize, scratch_path, shuffle_width, table

GRAM = 16
RUN = 64
LAST = np.iinfo(np.int64).max
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_P = 0xA0761D6478BD642F
_BLOCK = 1 << 17
#: A text of fewer symbols than PLACES is sorted with its places in the same word.
PLACE_BITS = 21
PLACES = (1 << PLACE_BITS) - 1


def _planes(a: np.ndarray) -> bytes:
    """An integer array, byte planes apart."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def _zip(*arrays: np.ndarray) -> bytes:
    """Integer arrays of one length, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(map(_planes, arrays)))


def _unzip(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).reshape(-1).view(kind))
        at += n * size
    return out


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _minima(data: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` bytes, the least 64-bit hash of its grams."""
    n = len(data) - 7
    words = np.empty(n, np.uint64)
    for k in range(8):
        count = (len(data) - k) // 8
        if count > 0:
            words[k::8] = np.frombuffer(data, "<u8", count, k)[: len(words[k::8])]
    m = n - (GRAM - 8)
    h = words[:m] * _K[0]
    for k in range(8, GRAM, 8):
        h = (h ^ (h >> np.uint64(29)) ^ words[k : k + m]) * _K[1 + k // 8 % 2]
    h ^= h >> np.uint64(32)
    width, have = length - GRAM + 1, 1
    while have * 2 <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (width - have)], h[width - have :]) if width > have else h


class Chunk:
    """Documents laid end to end, one byte apart, in order of id; and the segments of their windows."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, data: bytes, length: int):
        self.ids, self.sizes, self.length = ids, sizes, length
        self.data = np.frombuffer(data, np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)

    @classmethod
    def pack(cls, ids: list[int], texts: list[bytes]) -> tuple[bytes, bytes]:
        order = sorted(range(len(ids)), key=ids.__getitem__)
        body = b"".join(texts[i] + b"\0" for i in order)
        return _zip(np.array([ids[i] for i in order], np.int64), np.array([len(texts[i]) for i in order], np.int64)), zstandard.ZstdCompressor(level=1).compress(body)

    @classmethod
    def load(cls, ids: bytes, body: bytes, length: int) -> Chunk:
        return cls(*_unzip(ids, "<i8", "<i8"), zstandard.ZstdDecompressor().decompress(body), length)

    def segments(self, bits: int = 32) -> None:
        """Runs of up to RUN windows with one minimizer: at, windows, value (remixed minimizer, of some bits), doc, and which different segment each is.

        Different segments are numbered in order of value and content, so every round sees the same numbers: ``heads`` is the first segment of each.
        """
        length = self.length
        ends = self.starts + self.sizes - length + 1  # of the window starts of each document
        at, windows, value, content = [], [], [], []
        power, inverse = _powers(_BLOCK + length, _P), _powers(_BLOCK + length, pow(_P, -1, 1 << 64))
        for lo in range(0, len(self.data), _BLOCK):
            block = self.data[lo : lo + _BLOCK + length - 1]
            if len(block) < max(length, GRAM):
                break
            m = _minima(block, length)
            fits = np.zeros(len(m) + 1, np.int32)
            near = slice(np.searchsorted(ends, lo, side="right"), np.searchsorted(self.starts, lo + len(m)))
            first, last = np.clip(self.starts[near] - lo, 0, len(m)), np.clip(ends[near] - lo, 0, len(m))
            real = first < last
            np.add.at(fits, first[real], 1)
            np.add.at(fits, last[real], -1)
            valid = np.cumsum(fits[:-1]) > 0
            begins = np.concatenate([[True], m[1:] != m[:-1]])
            begins[first[real]] = True
            begins[1:] |= ~valid[:-1]
            begins &= valid
            s = np.flatnonzero(begins)
            if not len(s):
                continue
            stops = np.flatnonzero(np.concatenate([valid[:-1] & ~valid[1:], valid[-1:]])) + 1
            e = np.minimum(np.append(s[1:], len(m)), stops[np.searchsorted(stops, s, side="right")])
            parts = -(-(e - s) // RUN)
            k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            s2 = np.repeat(s, parts) + k * RUN
            n2 = np.minimum(np.repeat(e, parts) - s2, RUN)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((block.astype(np.uint64) + np.uint64(1)) * power[: len(block)], dtype=np.uint64)])
            h = (total[s2 + n2 + length - 1] - total[s2]) * inverse[s2]
            mixed = m[s2] * _K[0]
            at.append(s2 + lo)
            windows.append(n2)
            value.append((mixed ^ (mixed >> np.uint64(29))) * _K[1] >> np.uint64(64 - bits))
            content.append((h ^ (mixed << np.uint64(1)) ^ n2.astype(np.uint64)) * _K[2])
        none = np.zeros(0, np.int64)
        self.at, self.windows = (np.concatenate(x) if x else none for x in (at, windows))
        self.value, content = (np.concatenate(x) if x else none.astype(np.uint64) for x in (value, content))
        self.doc = np.searchsorted(self.starts, self.at, side="right") - 1
        order = np.argsort(content)
        c = content[order]
        new = np.concatenate([[True], c[1:] != c[:-1]]) if len(c) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        by_value = np.argsort(self.value[order[first]], kind="stable")
        number = np.empty(len(first), np.int64)
        number[by_value] = np.arange(len(first))
        self.which = np.empty(len(c), np.int64)
        self.which[order] = number[np.cumsum(new) - 1]
        doc = self.doc[order]
        self.low, self.high = (f.reduceat(doc, first)[by_value] if len(c) else none for f in (np.minimum, np.maximum))
        self.heads = order[first][by_value]

    def values(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted different values, how many different segments each has here, and which of them stand in two documents here."""
        v = self.value[self.heads]
        if not len(v):
            return v, np.zeros(0, np.int64), np.zeros(0, bool)
        at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        return v[at], np.diff(np.append(at, len(v))), np.minimum.reduceat(self.low, at) != np.maximum.reduceat(self.high, at)


def _top(value: np.ndarray, bits: int) -> np.ndarray:
    """The upper 32 of some bits."""
    return value >> np.uint64(bits - 32) if bits > 32 else value << np.uint64(32 - bits)


def _bucket(top: np.ndarray, n: int) -> np.ndarray:
    """Buckets are ranges of 32-bit values, so sorted values are in order of bucket."""
    return ((top.astype(np.uint64) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _cuts(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    for s, e in zip(at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True):
        yield int(bucket[s]), s, e


def _arrange(key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, and the places that go with them. Both in one word where they fit: sorting values is several times faster than sorting indices.

    What must fit is the largest place: a few ties of a large text may stand anywhere in it.
    """
    if int(place.max(initial=0)) < PLACES and int(key.max(initial=0)) < 1 << (63 - PLACE_BITS):
        packed = np.sort((key << PLACE_BITS) | place)
        return packed >> PLACE_BITS, packed & PLACES
    by = np.argsort(key, kind="stable")
    return key[by], place[by]


def suffix_order(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes of an array of symbols sorted by their first ``length``: words of a few symbols, then doubling within ties only.

    Also the common prefix of each suffix with the one before it as far as the words tell, and how many symbols a word has: that value
    means as many or more.
    """
    n = len(text)
    bits = max(1, int(text.max(initial=0)).bit_length())
    depth = first = min(8, (63 - PLACE_BITS) // bits)
    padded = np.concatenate([text, np.zeros(first, np.uint8)]).astype(np.int64)
    word = np.zeros(n, np.int64)
    for k in range(first):
        word = (word << bits) | padded[k : k + n]
    w, order = _arrange(word, np.arange(n))
    differ = w[1:] ^ w[:-1]
    new = np.concatenate([[True], differ != 0])
    values = np.concatenate([[0], sum((differ < 1 << bits * (first - k)).astype(np.int8) for k in range(1, first + 1))]).astype(np.int8)
    del padded, word, w, differ
    while depth < length:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        rank = np.zeros(n + depth, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(1, n + 1), 0))  # a group's first place is its rank
        place = order[tied]
        group = np.cumsum(new[tied]) - 1
        # At least two suffixes a group: half as many groups as places.
        key, order[tied] = _arrange(group * (n + 1) + rank[place + depth] if n >= PLACES else (group << PLACE_BITS) | rank[place + depth], place)
        new[tied[1:]] |= key[1:] != key[:-1]  # the groups keep their places
        depth *= 2
    return order, values, first


def shared_prefix_groups(text: np.ndarray, order: np.ndarray, values: np.ndarray, known: int, length: int) -> np.ndarray:
    """Group number of each suffix in sorted order; one group shares its first ``length`` symbols. Symbol 0 ends a segment.

    Intervals of suffixes with a common string are extended to the left over the Burrows-Wheeler transform, all intervals
    of one string length at once; an interval's end that wasn't set yet gets a common prefix below ``length``. Common prefixes below
    ``known`` are read off the first sort (``values``), so the search begins with the strings of that length whose interval ends at a
    prefix of one less.
    """
    n = len(text)
    bwt = text[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)  # where a suffix goes when its preceding symbol is put in front
    step[by_symbol] = np.arange(n)
    same = bwt[by_symbol][1:] == bwt[by_symbol][:-1]
    after, before = np.full(n, n, np.int64), np.full(n, -1, np.int64)  # next and last place with the same preceding symbol
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    ended = np.concatenate([values < known, [True]])
    edges = np.flatnonzero(ended)
    last = np.append(values, 0)[edges[1:]] == known - 1
    low, high = edges[:-1][last], edges[1:][last]
    for _ in range(known, length):
        if not len(low):
            break
        size = high - low
        which = np.repeat(np.arange(len(low)), size)
        i = np.arange(len(which)) + np.repeat(low - (np.cumsum(size) - size), size)
        inner = bwt[i] != 0  # nothing stands to the left of a segment
        i, which = i[inner], which[inner]
        low, high = np.sort(step[i[before[i] < low[which]]]), np.sort(step[i[after[i] >= high[which]]]) + 1
        fresh = ~ended[high]
        low, high = low[fresh], high[fresh]
        ended[high] = True
    return np.concatenate([[0], np.cumsum(ended[1:n])])


def least_holders(pieces: list[bytes], docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows of each piece, end to end: the least of ``docs`` over all pieces that hold the same window; and window counts."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    ends = starts + sizes
    used = np.zeros(256, bool)
    inner = np.ones(len(raw), bool)
    inner[ends] = False
    used[raw[inner]] = True
    symbol = np.zeros(256, np.uint8)
    symbol[used] = np.arange(1, used.sum() + 1)  # UTF-8 uses fewer than 255 byte values, so 0 is free for the ends
    text = np.where(inner, symbol[raw], 0).astype(np.uint8)
    order, values, known = suffix_order(text, length)
    group = shared_prefix_groups(text, order, values, known, length)
    counts = sizes - length + 1
    piece = np.repeat(np.arange(len(pieces)), counts)
    places = np.arange(len(piece)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    of_place = np.empty(len(text), np.int64)
    of_place[order] = group
    mine = of_place[places]
    least = np.full(int(group[-1]) + 1, LAST, np.int64)
    np.minimum.at(least, mine, docs[piece])
    return least[mine], counts


def _dealt_by(length: int):
    """(key, id, text): the least gram hash of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for text in batch.column(1):
                data = np.frombuffer(text.as_py() or b"", np.uint8)
                keys.append(min((int(_minima(data[at : at + _BLOCK + length], length).min() >> np.uint64(1)) for at in range(0, len(data) - length + 1, _BLOCK)), default=-1))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(0), batch.column(1)], names=["key", "id", "text"])

    return run


def _chunks(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0

        def made() -> pa.RecordBatch:
            packed = Chunk.pack(ids, texts)
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65]), *(pa.array([x]) for x in packed)], names=["chunk", "ids", "body"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(LAST if i is None else i)
                texts.append(text.as_py() or b"")
                size += len(texts[-1]) + 1
                if size >= chunk_bytes:
                    yield made()
                    ids, texts, size = [], [], 0
        if ids:
            yield made()

    return run


def _send_values(length: int, bits: int, n_groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, *packed in zip(*(batch.column(c).to_pylist() for c in ("chunk", "ids", "body")), strict=True):
                c = Chunk.load(*packed, length)
                c.segments(bits)
                v, n, shared = c.values()
                told = (np.minimum(n, 32767) * 2 + shared).astype(np.uint16)
                rows = [(g, chunk, _zip(np.diff(v[s:e], prepend=np.uint64(0)), told[s:e])) for g, s, e in _cuts(_bucket(_top(v, bits), n_groups))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["bucket", "chunk", "values"])

    return run


def _answer_values(length: int, hot_bytes: int):
    """Of one group: for each chunk, which of its values stand in two documents or more (1), and into how many parts those must be dealt (2 and more)."""

    def run(rows: pa.Table) -> pa.Table:
        each = [_unzip(v.as_py(), "<u8", "<u2") for v in rows["values"]]
        everything, told = np.concatenate([np.cumsum(v, dtype=np.uint64) for v, _ in each]), np.concatenate([t for _, t in each])
        order = np.argsort(everything, kind="stable")
        v, t = everything[order], told[order].astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        n = np.diff(np.append(at, len(v)))
        twice = (n > 1) | np.logical_or.reduceat(t % 2 == 1, at)
        different = np.add.reduceat(t // 2, at)  # at most so many over all chunks
        size = length - GRAM // 2  # windows of a segment and bytes around them, on average
        parts = np.where(different * (length + size // 2) > hot_bytes, -(-different * (size // 2) * length // hot_bytes), 1)
        out = np.empty(len(v), np.uint32)
        out[order] = np.repeat(np.where(twice, parts, 0), n)
        cuts = np.cumsum([len(v) for v, _ in each])[:-1]
        return pa.table({"chunk": rows["chunk"], "bucket": rows["bucket"], "told": pa.array([_zip(x) for x in np.split(out, cuts)], pa.binary())})

    return run


def _send_segments(length: int, bits: int, n_values: int, n_groups: int):
    """Of each chunk joined with the answers: its different segments of repeated values, a row for each group.

    A piece is a run of windows of a segment: all of them, or a single one where the value must be split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, ids, body, answers in zip(*(batch.column(c).to_pylist() for c in ("chunk", "ids", "body", "answers")), strict=True):
                c = Chunk.load(ids, body, length)
                c.segments(bits)
                v, _, _ = c.values()
                by = {a["bucket"]: a["told"] for a in answers}
                told = np.concatenate([_unzip(by[g], "<u4")[0] for g, _, _ in _cuts(_bucket(_top(v, bits), n_values))]) if len(v) else np.zeros(0, np.uint32)
                if not told.any():
                    continue
                value = c.value[c.heads]
                parts = told[np.searchsorted(v, value)]
                raw = c.data.tobytes()
                whole, split = np.flatnonzero(parts == 1), np.flatnonzero(parts > 1)
                n = c.windows[c.heads[split]]
                single, off = np.repeat(split, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                hashes = [xxhash.xxh3_64_intdigest(raw[x : x + length]) for x in (c.at[c.heads[single]] + off).tolist()]
                dealt = (np.array(hashes, np.uint64) % parts[single].astype(np.uint64) + np.uint64(1)) * _K[1] ^ value[single] * _K[0]
                key = np.concatenate([_top(value[whole], bits), (dealt * _K[2]) >> np.uint64(32)])
                part, off = np.concatenate([whole, single]), np.concatenate([np.zeros(len(whole), np.int64), off])
                n = np.concatenate([c.windows[c.heads[whole]], np.ones(len(single), np.int64)])
                order = np.argsort(key, kind="stable")
                key, part, off, n = key[order].astype(np.uint32), part[order], off[order], n[order]
                at, low, high = c.at[c.heads[part]] + off, c.ids[c.low[part]], c.ids[c.high[part]]
                rows = []
                for g, s, e in _cuts(_bucket(key, n_groups)):
                    text = b"".join([raw[x : x + k] for x, k in zip(at[s:e].tolist(), (n[s:e] + length - 1).tolist(), strict=True)])
                    meta = _zip(np.diff(key[s:e], prepend=np.uint32(0)), part[s:e].astype(np.uint32), off[s:e].astype(np.uint8), n[s:e].astype(np.uint8), low[s:e], high[s:e] - low[s:e])
                    rows.append((g, chunk, meta, zstandard.ZstdCompressor(level=1).compress(text)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["bucket", "chunk", "pieces", "text"])

    return run


def _decide(given: list[tuple[bytes, np.ndarray, np.ndarray]], length: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each (bytes, piece lengths, least documents) of one slice: runs (piece, first window, windows, least document over all) of its windows."""
    seen: dict[bytes, int] = {}
    least: list[int] = []
    names = []
    for raw, sizes, low in given:
        ends, ours = np.cumsum(sizes), []
        for s, e, d in zip((ends - sizes).tolist(), ends.tolist(), low.tolist(), strict=True):
            k = seen.setdefault(raw[s:e], len(seen))
            if k == len(least):
                least.append(d)
            elif d < least[k]:
                least[k] = d
            ours.append(k)
        names.append(np.array(ours, np.int64))
    smallest, counts = least_holders(list(seen), np.array(least, np.int64), length)
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    # Runs of windows of one piece with one holder.
    new = np.concatenate([[True], smallest[1:] != smallest[:-1]])
    new[begin] = True
    run_at = np.flatnonzero(new)
    run_piece = np.searchsorted(begin, run_at, side="right") - 1
    run_from, run_size, run_doc = run_at - begin[run_piece], np.diff(np.append(run_at, len(smallest))), smallest[run_at]
    first_run = np.searchsorted(run_piece, np.arange(len(seen) + 1))
    out = []
    for ours in names:
        n = first_run[ours + 1] - first_run[ours]
        r = np.repeat(first_run[ours] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out.append((np.repeat(np.arange(len(ours)), n), run_from[r], run_size[r], run_doc[r]))
    return out


def _slices(keys: list[np.ndarray], sizes: list[np.ndarray], most: int) -> np.ndarray:
    """First keys of slices of about ``most`` bytes: a new one begins with the first key past each multiple, so one key's bytes at most come on top."""
    key, size = np.concatenate(keys), np.concatenate(sizes)
    order = np.argsort(key)
    key, size = key[order], size[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    before = (np.cumsum(size) - size)[new]
    return key[new][np.concatenate([[True], before[1:] // most != before[:-1] // most])]


def _answer_segments(length: int, n_groups: int, slice_bytes: int):
    """Of one group: runs of windows that a smaller document holds too, for the chunks that have a larger one."""

    def run(rows: pa.Table) -> pa.Table:
        held = []
        for pieces, text in zip(rows["pieces"], rows["text"], strict=True):
            key, which, off, n, low, spread = _unzip(pieces.as_py(), "<u4", "<u4", "u1", "u1", "<i8", "<i8")
            inside = (np.cumsum(key, dtype=np.uint32).astype(np.uint64) * np.uint64(n_groups)) & np.uint64(0xFFFFFFFF)  # place within the group's range
            ends = np.concatenate([[0], np.cumsum(n.astype(np.int64) + length - 1)])
            held.append((inside, which, off, low, low + spread, ends, zstandard.ZstdDecompressor().decompress(text.as_py())))
        begins = _slices([h[0] for h in held], [np.diff(h[-2]) for h in held], slice_bytes)
        cuts = [np.append(np.searchsorted(h[0], begins), len(h[0])) for h in held]
        found: list[list[tuple]] = [[] for _ in held]
        for k in range(len(begins)):
            rows_here = [i for i, c in enumerate(cuts) if c[k] < c[k + 1]]
            given = []
            for i in rows_here:
                (s, e), (_, _, _, low, _, ends, raw) = cuts[i][k : k + 2], held[i]
                given.append((raw[ends[s] : ends[e]], np.diff(ends[s : e + 1]), low[s:e]))
            for i, (piece, begin, size, doc) in zip(rows_here, _decide(given, length) if given else (), strict=True):
                _, which, off, _, high, _, _ = held[i]
                piece += cuts[i][k]
                wanted = doc < high[piece]
                if wanted.any():
                    piece, begin, size, doc = piece[wanted], begin[wanted], size[wanted], doc[wanted]
                    found[i].append((which[piece], (off[piece] + begin).astype(np.uint8), size.astype(np.uint8), doc))
        out = [(chunk, _zip(*map(np.concatenate, zip(*f, strict=True)))) for chunk, f in zip(rows["chunk"].to_pylist(), found, strict=True) if f]
        return pa.table({"chunk": pa.array([c for c, _ in out], pa.int64()), "runs": pa.array([r for _, r in out], pa.binary())})

    return run


def _cut(length: int, bits: int, with_text: bool):
    """Of each chunk joined with its runs: what is removed of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, body, answers in zip(*(batch.column(c).to_pylist() for c in ("ids", "body", "answers")), strict=True):
                c = Chunk.load(ids, body, length)
                gone = np.zeros(len(c.data), bool)
                if answers:
                    c.segments(bits)
                    which, begin, size, doc = (np.concatenate(x) for x in zip(*(_unzip(a, "<u4", "u1", "u1", "<i8") for a in answers), strict=True))
                    by = np.argsort(which, kind="stable")
                    which, begin, size, doc = which[by], begin[by].astype(np.int64), size[by].astype(np.int64), doc[by]
                    first = np.searchsorted(which, np.arange(len(c.heads) + 1))
                    lo, hi = first[c.which], first[c.which + 1]
                    n = hi - lo
                    r = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    segment = np.repeat(np.arange(len(n)), n)
                    hit = doc[r] < c.ids[c.doc[segment]]
                    r, segment = r[hit], segment[hit]
                    start = c.at[segment] + begin[r]
                    cover = np.bincount(start, minlength=len(c.data) + 1).astype(np.int32)
                    cover -= np.bincount(start + size[r] + length - 1, minlength=len(c.data) + 1).astype(np.int32)
                    gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
                rises = np.flatnonzero(gone & ~np.concatenate([[False], gone[:-1]]))
                spans = np.bincount(np.searchsorted(c.starts, rises, side="right") - 1, minlength=len(c.ids)) if len(rises) else np.zeros(len(c.ids), np.int64)
                removed, shas, kept = [], [], []
                for s, k in zip(c.starts.tolist(), c.sizes.tolist(), strict=True):
                    mask = gone[s : s + k]
                    stays = c.data[s : s + k][~mask].tobytes()
                    removed.append(int(mask.sum()))
                    shas.append(hashlib.sha256(stays).hexdigest())
                    kept.append(stays)
                names = pa.array([None if i == LAST else i for i in c.ids.tolist()], pa.int64())
                columns = [names, pa.array(c.sizes), pa.array(removed, pa.int64()), pa.array(spans.astype(np.int64)), pa.array(shas, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.binary())] if with_text else [])], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])])

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, chunk_bytes: int | None = None, group_bytes: int | None = None, slice_bytes: int = 512 << 10, hot_bytes: int = 1 << 20, with_text: bool = False) -> DataFrame:
    """One row per input row: (id_col long, n_bytes, n_removed, n_spans longs, kept_sha256 string[, kept binary]).

    A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id; strings are judged on
    the input and never cross documents. Ids are integers below 2^63 - 1; a null id counts as larger than any other. Rows with the same id are one
    another's equals: neither loses anything to the other, both lose to smaller ids. A null text is empty; texts shorter than
    ``length`` keep all. Other columns are not read. An empty table gives no rows. A text of any length is one chunk at least, which
    one task holds; ``length`` is at least 40 and at most 64. A minimizer with about ``hot_bytes`` of different segments or more is split.
    """
    if not 40 <= length <= 64:
        raise ValueError("length must be from 40 to 64")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    total, largest = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)), F.max("id")).first()
    if largest == LAST:
        raise ValueError("the id 2^63 - 1 is taken for null")
    root = math.sqrt(total / (64 << 30))
    chunk_bytes = chunk_bytes or int((8 << 20) * min(8.0, max(1.0, root)))
    group_bytes = group_bytes or int((16 << 20) * min(4.0, max(1.0, root)))
    bits = min(56, max(32, (total // 16).bit_length() + 6))  # so that few different minimizers have the same value
    n_values, n_groups = -(-total // (4 * group_bytes)) or 1, -(-total // group_bytes) or 1
    dealt = rows.mapInArrow(_dealt_by(length), "key long, id long, text binary").hint("rebalance", F.col("key")).sortWithinPartitions("key").select("id", "text")
    packed = dealt.mapInArrow(_chunks(chunk_bytes), "chunk long, ids binary, body binary")
    # Bucketed by chunk: the two joins below move the answers only.
    path, name, width = scratch_path(spark, "chunks"), f"chunks_{uuid.uuid4().hex}", shuffle_width(spark)
    packed.write.bucketBy(width, "chunk").option("path", path).saveAsTable(name)
    try:
        chunks = spark.table(name)
        told = chunks.mapInArrow(_send_values(length, bits, n_values), "bucket long, chunk long, values binary").groupBy("bucket").applyInArrow(_answer_values(length, hot_bytes), "chunk long, bucket long, told binary")
        answers = told.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "told")).alias("answers"))
        asked = chunks.join(answers.hint("shuffle_hash"), "chunk").select("chunk", "ids", "body", "answers").mapInArrow(_send_segments(length, bits, n_values, n_groups), "bucket long, chunk long, pieces binary, text binary")
        runs = materialize(asked.groupBy("bucket").applyInArrow(_answer_segments(length, n_groups, slice_bytes), "chunk long, runs binary"), "repeat-runs")
        gathered = runs.groupBy("chunk").agg(F.collect_list("runs").alias("answers"))
        joined = chunks.join(gathered.hint("shuffle_hash"), "chunk", "left").select("ids", "body", "answers")
        out = joined.mapInArrow(_cut(length, bits, with_text), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
        out = materialize(out.withColumnRenamed("id", id_col), "without-repeats")
        forget(spark, runs)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        forget_path(spark, path)
    return out


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=50)
