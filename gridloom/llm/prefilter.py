"""Keeping wide rows out of a join: a bounded Bloom filter, in DataFrame functions, marks those that surely have no partner.

Joining a narrow table of keys to documents would shuffle every text. Here the keys set bits of a table (word, bits) of at most
``max_words`` rows; each row looks up its own two bits by joins with that table, which its bound allows to broadcast. Rows that it
rules out pass straight; only the others shuffle and are joined exactly. With more keys than the bound has room for it rules out less, and
never anything wrongly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, materialize

PROBES = 2
BITS_PER_KEY = 32
LEAST_WORDS = 16


def _cell(key: Column, probe: int, n_words: int) -> Column:
    """One of 64 x n_words bits for a long; n_words is a power of two."""
    return F.xxhash64(key, F.lit(probe)).bitwiseAND(F.lit(64 * n_words - 1))


def _bit(cell: Column) -> Column:
    """1 shifted to a cell's place in its word; the shift is not a constant, so it is written as an SQL function."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), cell.bitwiseAND(F.lit(63)).cast("int"))


class Filter:
    """The filter of ``keys`` (one column of longs; nulls are left out)."""

    def __init__(self, keys: DataFrame, max_words: int = 1 << 18):
        keys = keys.toDF("k").where("k is not null")
        most = max(LEAST_WORDS, min(max_words, keys.count() * BITS_PER_KEY // 64))
        self.n_words = 1 << (most.bit_length() - 1)
        cells = F.explode(F.array(*(_cell(F.col("k"), p, self.n_words) for p in range(PROBES))))
        words = keys.select(cells.alias("c")).groupBy(F.shiftright("c", 6).alias("word")).agg(F.bit_or(_bit(F.col("c"))).alias("bits"))
        self.words = materialize(words, "filter-words")

    def mark(self, rows: DataFrame, key: Column, name: str) -> DataFrame:
        """``rows`` with a boolean column ``name``: false where ``key`` (a long) surely isn't among the keys."""
        out = rows.withColumn(f"{name}_k", key)
        for p in range(PROBES):
            cell = _cell(F.col(f"{name}_k"), p, self.n_words)
            side = self.words.select(F.col("word").alias(f"{name}_w{p}"), F.col("bits").alias(f"{name}_b{p}"))
            # n_words rows at most.
            out = out.join(F.broadcast(side), F.shiftright(cell, 6) == F.col(f"{name}_w{p}"), "left")
        hit = [F.coalesce(F.col(f"{name}_b{p}"), F.lit(0)).bitwiseAND(_bit(_cell(F.col(f"{name}_k"), p, self.n_words))) != 0 for p in range(PROBES)]
        told = F.col(f"{name}_k").isNotNull()
        for h in hit:
            told = told & h
        return out.select(*(F.col(f"`{c}`") for c in rows.columns), told.alias(name))

    def forget(self) -> None:
        forget(self.words.sparkSession, self.words)


def free_name(df: DataFrame, like: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(like.lower()) for c in taken):
        like = f"_{like}"
    return like


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_hash: Column) -> DataFrame:
    """docs less the rows whose id and xxhash64 of the text are in ``gone`` (columns id and hash, each pair once).

    Null ids match null ids. All columns pass as they were, whatever their names. Only rows that may have to go shuffle, if the join does.
    """
    m = free_name(docs, "__gone")
    marked = Filter(gone.select("hash")).mark(docs.withColumn(f"{m}h", text_hash), F.col(f"{m}h"), m)
    sought = gone.select(F.col("id").alias(f"{m}i"), F.col("hash").alias(f"{m}g"))
    left = marked.where(F.col(m)).join(sought, F.col(f"`{id_col}`").eqNullSafe(F.col(f"{m}i")) & (F.col(f"{m}h") == F.col(f"{m}g")), "left_anti")
    return marked.where(~F.col(m)).unionByName(left).select(*(F.col(f"`{c}`") for c in docs.columns))
