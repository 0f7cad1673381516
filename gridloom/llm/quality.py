"""Quality classifier by supervised subword embeddings.

Every word, every pair of neighbouring words and every character n-gram (3 to 5 bytes of the text as it stands, over word borders
too, runs of blanks left out) hashes to a row of one table of learned vectors. A document is the average of its features' vectors, a
softmax layer gives the class. Vectors and layer are trained together by stochastic gradient descent in numpy, on a
bounded sample of labelled documents, whose features wait packed: 1 to 2 bytes each. No feature is written for a kind of bad text; whatever decides is learned.

With two classes the score needs one number per feature: the vector's product with the difference of the two
output rows. Scoring therefore looks up one float per feature in a table of fixed size (1 MB), which is broadcast, and
adds up over whole texts with array operations, a block of bytes at a time. Blocks read a few bytes on either side of
their own, so a score depends on the text alone, wherever blocks begin. A word is hashed by its first REACH bytes; its n-grams cover all of it.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import parts_of, table

BITS = 18
GRAMS = (3, 4, 5)
REACH = 64
BLOCK_BYTES = 1 << 17
#: Bytes of training text, or one text, whose features are counted at once.
COUNT_BYTES = 1 << 16
_P = 0x9E3779B97F4A7C15
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK_BYTES + REACH + 8, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER, _INVERSE = _powers(_P), _powers(pow(_P, -1, 1 << 64))


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int32)


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, numbers of the texts they stand in) of all features of the texts, a part at a time; each feature comes once."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    borders = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)  # the blanks around the texts
    before, before_text = np.zeros(1, np.uint64), np.full(1, -1)
    for start in range(0, len(data) - 1, BLOCK_BYTES):
        own = min(BLOCK_BYTES, len(data) - 1 - start)
        here = data[start : start + own + 1 + REACH]
        blank = _IS_BLANK[here]
        wide = np.where(blank, 32, here).astype(np.uint64)
        border = np.zeros(len(here), bool)
        border[borders[slice(*np.searchsorted(borders, [start, start + len(here)]))] - start] = True
        text_of = lambda at: np.searchsorted(borders, at + start, side="right") - 1  # noqa: E731,B023
        twice = blank[:-1] & blank[1:]
        for n in GRAMS:
            m = min(own, len(here) - n + 1)
            if m <= 0:
                continue
            key, bad = wide[:m].copy(), twice[:m].copy()
            for k in range(1, n):
                key |= wide[k : k + m] << np.uint64(8 * k)
                if k < n - 1:
                    bad |= border[k : k + m] | twice[k : k + m]
            at = np.flatnonzero(~bad)
            yield _bucket(key[at] + np.uint64(n << 56)), text_of(at)
        first = np.flatnonzero(blank[:own] & ~blank[1 : own + 1]) + 1
        if not len(first):
            continue
        blanks = np.append(np.flatnonzero(blank), len(here))
        end = np.minimum(blanks[np.searchsorted(blanks, first)], first + REACH)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wide * _POWER[: len(wide)], dtype=np.uint64)])
        word, text = (total[end] - total[first]) * _INVERSE[first], text_of(first)
        yield _bucket(word), text
        left, left_text = np.concatenate([before, word[:-1]]), np.concatenate([before_text, text[:-1]])
        pair = left * np.uint64(0xC2B2AE3D27D4EB4F) ^ (word + (word >> np.uint64(7)))
        yield _bucket(pair[left_text == text]), text[left_text == text]
        before, before_text = word[-1:], text[-1:]


def _pack(bucket: np.ndarray, count: np.ndarray) -> tuple[int, bytes]:
    """Distinct sorted buckets and how often each occurs, compressed: gaps and counts, byte planes apart."""
    both = np.stack([np.diff(bucket, prepend=0), count]).astype("<u4")
    blob = zstandard.ZstdCompressor(level=1).compress(both.view(np.uint8).reshape(2, -1, 4).transpose(2, 0, 1).tobytes())
    return len(bucket), bytes(memoryview(blob))  # a copy: the compressor's result keeps the room of the worst case


def _unpack(packed: tuple[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets, and their shares of all features."""
    n, blob = packed
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, 2, n)
    gap, count = np.ascontiguousarray(planes.transpose(1, 2, 0)).reshape(2, -1).view("<u4")
    return np.cumsum(gap, dtype=np.int64), (count / max(1, int(count.sum(dtype=np.int64)))).astype(np.float32)


def counted(texts: list[bytes]) -> list[tuple[int, bytes]]:
    """Each document's distinct feature buckets and their counts, packed (a tenth of them as arrays); some documents at a time."""
    out: list[tuple[int, bytes]] = []
    at = 0
    while at < len(texts):
        size, upto = 0, at
        while upto < len(texts) and size < COUNT_BYTES:
            size += len(texts[upto])
            upto += 1
        found = [np.unique((text.astype(np.int64) << BITS) | bucket, return_counts=True) for bucket, text in features(texts[at:upto])]
        key, place = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        n = np.bincount(place, np.concatenate([c for _, c in found]), len(key)) if found else np.zeros(0)
        cuts = np.searchsorted(key >> BITS, np.arange(upto - at + 1))
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out.append(_pack(key[s:e] & ((1 << BITS) - 1), n[s:e]))
        at = upto
    return out


@dataclass(frozen=True)
class QualityModel:
    """What scoring needs: one weight per feature bucket, and the bias."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text; an empty one gets the bias alone."""
        sums, counts = np.zeros(len(texts)), np.zeros(len(texts))
        for bucket, text in features(texts):
            sums += np.bincount(text, self.weights[bucket], len(texts))
            counts += np.bincount(text, minlength=len(texts))
        return 1 / (1 + np.exp(-(sums / np.maximum(counts, 1) + self.bias)))


def fit(texts: list[bytes], labels: list[int], *, dim: int = 8, epochs: int = 8, rate: float = 0.5, seed: int = 7) -> QualityModel:
    """Stochastic gradient descent over single documents, in an order drawn anew each epoch, with a linearly falling rate."""
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((1 << BITS, dim)) - 0.5) / dim).astype(np.float32)
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    docs = counted(texts)
    step, steps = 0, max(1, epochs * len(docs))
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            at, share = _unpack(docs[i])
            now = rate * (1 - step / steps)
            step += 1
            rows = vectors[at]
            v = share @ rows
            z = layer @ v + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ layer
            layer -= now * np.outer(p, v)
            bias -= now * p
            # The average's gradient is spread over its features; the factor undoes the shrinking by their number.
            vectors[at] = rows - (now * np.minimum(share * len(at), 16.0))[:, None] * back
    return QualityModel((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, max_docs: int, max_bytes: int, id_col: str, text_col: str, label_col: str) -> list[tuple[bytes, int]]:
    """Labelled documents outside the held-out fifth, in the order in which their ids hash: at most ``max_docs``, and as many as ``max_bytes`` of whole texts hold."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"), F.shiftrightunsigned(F.xxhash64(id_col), 34).alias("h"))
    n = usable.count()
    near = 1 << 30 if n <= max_docs else min(1 << 30, int((1 << 30) * 1.2 * max_docs / n) + 1)
    ids = sorted((r["h"], r["i"], r["y"]) for r in usable.where(F.col("h") < near).toLocalIterator())[:max_docs]
    if not ids:
        return []
    kinds = T.StructType([T.StructField("h", T.LongType()), T.StructField("i", usable.schema["i"].dataType), T.StructField("y", T.IntegerType())])
    picked = docs.sparkSession.createDataFrame(ids, kinds)
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t")).join(F.broadcast(picked), "i")  # max_docs rows at most
    held: list[tuple[tuple, int, bytes]] = []
    size, end = 0, None
    for r in rows.toLocalIterator():
        key = (r["h"], r["i"])
        if end is not None and key >= end:
            continue
        insort(held, (key, r["y"], bytes(r["t"])))
        size += len(r["t"])
        while size > max_bytes and len(held) > 1:
            end, _, text = held.pop()
            size -= len(text)
    found = sorted((key[1], y, t) for key, y, t in held)
    return [(t, min(1, max(0, y))) for _, y, t in found]


def train(docs: DataFrame, labels: DataFrame, *, max_docs: int = 4000, max_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> QualityModel:
    """Fit on a bounded sample (``max_docs`` documents, ``max_bytes`` of text). Without a usable label every text scores 0.5."""
    sample = training_sample(docs, labels, max_docs, max_bytes, id_col, text_col, label_col)
    return fit([t for t, _ in sample], [y for _, y in sample], **options)


def score_column(spark: SparkSession, model: QualityModel, text: F.Column) -> F.Column:
    """The score of a text column; null counts as empty."""
    shared = spark.sparkContext.broadcast(model)  # one table of fixed size

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [shared.value.scores([v.as_py() or b"" for v in part]) for part in parts_of(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score(text.cast("binary"))


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = 4000) -> DataFrame:
    """One row per input row: (id_col, held_out boolean, score double, predicted int).

    Scores depend on the text only. A null text is empty; a null id is carried through (its held_out is null) and never
    trained on; labels that are null, or of ids that no document has, are left out; ids labelled more than once are trained on
    each time. Repeated rows score alike. Other columns are not read. An empty table gives no rows.
    """
    model = train(docs, labels, max_docs=max_docs, id_col=id_col, text_col=text_col, label_col=label_col)
    scored = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), score_column(docs.sparkSession, model, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs that score at least ``threshold``, with their columns as they were, whatever their names.

    A null or empty text gets the score of one without words, so all such rows stay or all go; equal texts and repeated rows share their
    fate, a score of exactly ``threshold`` stays, a text of any length is scored whole. Labels are used as in classify(). An
    empty table stays empty.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    return docs.where(score_column(docs.sparkSession, model, F.col(f"`{text_col}`")) >= threshold)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
