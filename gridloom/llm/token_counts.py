"""Token counts: pieces are counted once per distinct pre-token, joined to each document's pre-token
frequencies, and summed. No id list of a document is ever built.

A byte-pair tokenizer never merges across pre-tokens, so a document's token count is the sum over its
distinct pre-tokens of frequency x pieces.

1. Texts are read once and taken apart into pre-tokens. About ``part_bytes`` of documents make a part: the part's different pre-tokens, dealt into
   groups by their hash, and for each document which of them it has and how often, as packed numbers. Parts are written to the shared folder,
   bucketed by part.
2. Each part sends its different pre-tokens, a packed row to each group. A group is a part of the one table of distinct pre-tokens: the
   tokenizer's pieces of each are counted there, once in the whole corpus, and every part gets back a packed row of counts for what it sent.
3. Those counts join the part's frequencies, and documents are sums.

What moves is each part's different pre-tokens, compressed, and one number for each - never a document's frequencies. A pre-token that
stands in every document is sent once a part, so none is hot. Groups grow in number with the corpus, so a group's table stays in memory.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import by_bytes, forget, forget_path, materialize, scratch_path, shuffle_width, table

#: The pre-token pattern of byte-level BPE, as published with the vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What its classes are in ASCII texts, for the standard library's faster engine.
ASCII_CLASSES = ((r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]"), (r"\p{L}", "[A-Za-z]"), (r"\p{N}", "[0-9]"))
#: A blank between two ASCII letters always starts a pre-token, so long texts may be cut before it.
_SAFE_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
SEGMENT = 1 << 16


class PreTokens:
    """A tokenizer file's pre-tokens of a text, and their pieces by the tokenizer library itself."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.pre, self.bpe = tokenizer.pre_tokenizer, tokenizer.model.tokenize
        kind = type(self.pre).__name__
        if kind != "ByteLevel" or tokenizer.normalizer is not None:
            raise ValueError(f"{path}: only byte-level BPE without a normalizer is supported, not {kind}")
        if self.pre.add_prefix_space or not self.pre.use_regex:
            raise ValueError(f"{path}: a prefix space, or no pattern, isn't supported")
        if getattr(tokenizer.model, "dropout", None):
            raise ValueError(f"{path}: a model with dropout has no one count")
        added = tokenizer.get_added_tokens_decoder().values()
        if odd := [t.content for t in added if t.single_word or t.lstrip or t.rstrip]:
            raise ValueError(f"{path}: added tokens with single_word, lstrip or rstrip aren't supported: {odd}")
        ascii_pattern = PATTERN
        for ours, theirs in ASCII_CLASSES:
            ascii_pattern = ascii_pattern.replace(ours, theirs)
        self.find, self.find_ascii = regex.compile(PATTERN).findall, re.compile(ascii_pattern, re.ASCII).findall
        self.classes = [(k, regex.compile(p)) for k, p in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s"))]
        self.split = re.compile("|".join(re.escape(t.content) for t in sorted(added, key=lambda t: len(t.content), reverse=True))) if added else None
        self.agrees: dict[str, bool] = {}

    def _same_class(self, ch: str) -> bool:
        """Whether the library puts this character in the class that the regex module puts it in (Unicode versions differ)."""
        ours = next((k for k, p in self.classes if p.match(ch)), "O")
        one = lambda text: len(self.pre.pre_tokenize_str(text)) == 1
        theirs = "L" if one("a" + ch) else "N" if one("1" + ch) else "O" if one("!" + ch) else "S"
        return ours == theirs

    def _of(self, text: str) -> list[str]:
        if text.isascii():
            return self.find_ascii(text)
        for ch in set(text):
            if ch > "\x7f" and not self.agrees.setdefault(ch, self.agrees.get(ch) or self._same_class(ch)):
                return [text[a:b] for _, (a, b) in self.pre.pre_tokenize_str(text)]
        return self.find(text)

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """The document's pre-token frequencies, and how many added tokens stand in it."""
        freq: Counter = Counter()
        parts = self.split.split(text) if self.split else [text]
        for part in parts:
            at = 0
            while at < len(part):
                cut = _SAFE_CUT.search(part, at + SEGMENT) if len(part) - at > 2 * SEGMENT else None
                end = cut.start() if cut else len(part)
                freq.update(self._of(part[at:end]))
                at = end
        return freq, len(parts) - 1

    def pieces(self, token: str) -> int:
        return sum(len(self.bpe(p)) for p, _ in self.pre.pre_tokenize_str(token))


class _Numbers(dict):
    """Numbers from 0 in order of first asking."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _packed(numbers: list[int] | np.ndarray) -> bytes:
    a = np.array(numbers, "<u4")
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, 4).T.tobytes())  # byte planes apart


def _packed_tokens(tokens: list[bytes]) -> bytes:
    """Pre-tokens with their lengths."""
    sizes = np.array([len(t) for t in tokens], "<u4")
    return zstandard.ZstdCompressor(level=3).compress(len(tokens).to_bytes(4, "little") + sizes.view(np.uint8).reshape(-1, 4).T.tobytes() + b"".join(tokens))


def _unpacked_tokens(blob: bytes) -> list[str]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    sizes = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 4).reshape(4, n).T).reshape(-1).view("<u4").astype(np.int64)
    ends = np.cumsum(sizes) + 4 + 4 * n
    return [raw[s:e].decode() for s, e in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def _unpacked(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).reshape(-1).view("<u4").astype(np.int64)


def _parts(path: str, part_bytes: int, n_groups: int):
    """Documents (id, text, n_bytes) to parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = PreTokens(path)
        for batch in by_bytes(batches, 1, part_bytes):
            numbers, which, times, sizes, added = _Numbers(), [], [], [], []
            for value in batch.column(1):
                freq, specials = known.frequencies(value.as_py() or "")
                which.extend(map(numbers.__getitem__, freq))
                times.extend(freq.values())
                sizes.append(len(freq))
                added.append(specials)
            # In order of group and, as that packs best, of bytes.
            tokens = [t.encode() for t in numbers]
            order = np.array(sorted(range(len(tokens)), key=tokens.__getitem__), np.int64)
            group = np.array([xxhash.xxh3_64_intdigest(t) % n_groups for t in tokens], np.int64)
            order = order[np.argsort(group[order], kind="stable")] if len(order) else order
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            cuts = np.searchsorted(group[order], np.arange(n_groups + 1))
            sent = [(g, _packed_tokens([tokens[i] for i in order[s:e].tolist()])) for g, (s, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if s < e]
            ids, n_bytes = (pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), pa.concat_arrays([batch.column(c)])) for c in (0, 2))
            packed = [pa.array([_packed(x)]) for x in (number[which] if which else [], times, sizes, added)]
            told = pa.array([[{"g": g, "tokens": t} for g, t in sent]], pa.list_(pa.struct([("g", pa.int64()), ("tokens", pa.binary())])))
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65]), ids, n_bytes, told, *packed], names=["part", "ids", "n_bytes", "sent", "which", "times", "sizes", "added"])

    return run


def _pieces(path: str):
    """One group: the pieces of its distinct pre-tokens, each counted once, for every part that sent some."""

    def run(rows: pa.Table) -> pa.Table:
        known = PreTokens(path)

        class Pieces(dict):
            def __missing__(self, token: str) -> int:
                self[token] = n = known.pieces(token)
                return n

        distinct = Pieces()
        counts = [_packed(list(map(distinct.__getitem__, _unpacked_tokens(blob.as_py())))) for blob in rows["tokens"]]
        return pa.table({"part": rows["part"], "g": rows["g"], "pieces": pa.array(counts, pa.binary()), "distinct": pa.array([len(distinct)] * len(counts), pa.int64())})

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts joined with their pre-tokens' pieces to documents."""
    for batch in batches:
        for k in range(batch.num_rows):
            which, times, sizes, added = (_unpacked(batch.column(c)[k].as_py()) for c in (2, 3, 4, 5))
            told = sorted((t["g"], t["pieces"]) for t in batch.column(6)[k].as_py() or [])
            pieces = np.concatenate([np.zeros(0, np.int64), *(_unpacked(p) for _, p in told)])
            ends = np.cumsum(sizes)
            total = np.concatenate([[0], np.cumsum(times * pieces[which])])
            yield pa.RecordBatch.from_arrays([batch.column(0)[k].values, batch.column(1)[k].values, pa.array(total[ends] - total[ends - sizes] + added, pa.int64())], names=["id", "n_bytes", "n_tokens"])


def count_tokens(df: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 4 << 20, group_bytes: int = 32 << 20) -> DataFrame:
    """Token count of each whole text, as the library's encode() gives it without added specials.

    Returns (id_col, n_bytes long, n_tokens long), one row per input row, repeated rows included. A null
    text counts as empty (0 bytes, 0 tokens); a null id is carried through; other columns are not read,
    so their names cannot clash; an empty table gives no rows. Any text length: memory holds one part of about
    ``part_bytes`` bytes (or one longer text) and its pre-tokens, or the pre-tokens of one group (of about ``group_bytes`` of the
    corpus). A tokenizer file with settings that aren't handled is refused.
    """
    PreTokens(tokenizer_path)
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`")
    picked = df.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    total = picked.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    n_groups = -(-total // group_bytes) or 1
    packed = picked.mapInArrow(_parts(tokenizer_path, part_bytes, n_groups), f"part long, ids array<{kind}>, n_bytes array<long>, sent array<struct<g:long,tokens:binary>>, which binary, times binary, sizes binary, added binary")
    # Bucketed by part: the last join moves the pieces only.
    path, name, width = scratch_path(spark, "parts"), f"parts_{uuid.uuid4().hex}", shuffle_width(spark)
    packed.write.bucketBy(width, "part").option("path", path).saveAsTable(name)
    try:
        parts = spark.table(name)
        sent = parts.select("part", F.explode("sent").alias("s")).select("part", "s.g", "s.tokens")
        pieces = materialize(sent.groupBy("g").applyInArrow(_pieces(tokenizer_path), "part long, g long, pieces binary, distinct long"), "pieces")
        told = pieces.groupBy("part").agg(F.collect_list(F.struct("g", "pieces")).alias("told"))
        joined = parts.join(told.hint("shuffle_hash"), "part", "left").select("ids", "n_bytes", "which", "times", "sizes", "added", "told")
        out = materialize(joined.mapInArrow(_sums, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col), "token-counts")
        forget(spark, pieces)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        forget_path(spark, path)
    return out


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under byte_bpe_50k, and whether they exceed a context of 1024."""
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)
