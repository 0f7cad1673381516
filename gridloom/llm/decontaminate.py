"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Every benchmark item is cut into windows; a document is hit where a whole window occurs. A window is
a set of word shingles, and containing it means containing all of them, so its necessary prefix under any
global order has one shingle: the rarest. One pass over the texts finds the positions of benchmark shingles; they are
counted over all documents, which orders shingles by rarity; a window one of whose shingles never occurs is out. The positions of
prefix shingles join their windows; the window must lie within the document at the position that the shingle's offset
gives (length and positional bounds). Exact containment is then a join on positions: shingles that cover the window must all stand where
the window has them.

Texts are read once and never shuffled: what moves are positions of benchmark shingles with the shingle. They are looked up by
hash in a filter of bounded size (see prefilter.py); a benchmark that outgrows it lets more positions through to the join that compares the
shingles themselves, and changes no result. Nothing of the benchmark comes to the driver but the sizes of its shingles (three numbers at
most).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .prefilter import Filter, without
from .shared import ascii_lower, forget, materialize, table

#: What stands between words (a fixed value): every ASCII character but digits and lower-case letters.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3


def words_of(text: Column) -> Column:
    """Lower-cased runs of digits, letters a-z and non-ASCII characters; a null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAPS), "")


def _windows(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(window_id, item, window array, len): the windows of all items, each different window with an id of its own."""
    words = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.lit(width), F.size("w"))
    cut = words.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("window"))
    return cut.distinct().select(F.sha2(F.concat_ws(" ", "window"), 256).alias("window_id"), "item", "window", F.size("window").alias("len"))


def _shingles(windows: DataFrame) -> DataFrame:
    """(window_id, len, off, size, shingle, key): shingles of SHINGLE words, or of all words of a shorter window."""
    size = F.least(F.lit(SHINGLE), F.col("len"))
    parts = F.transform(F.sequence(F.lit(0), F.col("len") - size), lambda i: F.struct(i.alias("off"), F.slice("window", i + 1, size).alias("w")))
    each = windows.dropDuplicates(["window_id"]).select("window_id", "len", size.alias("size"), F.explode(parts).alias("s"))
    return each.select("window_id", "len", "s.off", "size", F.concat_ws(" ", "s.w").alias("shingle"), _key([F.get("s.w", F.lit(k)) for k in range(SHINGLE)]).alias("key"))


def _key(words: list[Column]) -> Column:
    """Hash of a shingle's words; a missing one leaves it as it is."""
    return F.xxhash64(*words)


def _candidates(docs: DataFrame, id_col: str, text_col: str, shingles: DataFrame, max_words: int) -> DataFrame:
    """(id, hash, n_words, pos, found): for each position at which shingles of the benchmark may begin, those shingles; and for each row its first position, or
    null where it has no words, in any case."""
    sizes = sorted(r["size"] for r in shingles.select("size").distinct().collect())  # of 1 .. SHINGLE
    w = F.col("w")
    words = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("hash"), words_of(F.col(f"`{text_col}`")).alias("w"))
    run = F.arrays_zip(w.alias("a"), *(F.slice(w, k + 1, F.size(w)).alias("abc"[k]) for k in range(1, max(sizes, default=1))))
    names = "abc"[: max(sizes, default=1)]
    # The zipped array has as many places as the text has words; its last ones lack words.
    at = words.select("id", "hash", F.size(w).cast("long").alias("n_words"), F.posexplode_outer(run).alias("pos", "r"))
    at = at.select("id", "hash", "n_words", "pos", *(F.col("r")[n].alias(n) for n in names))
    found = []
    filters = []
    for size in sizes:
        filters.append(Filter(shingles.where(F.col("size") == size).select("key"), max_words))
        inner = [F.col(n) for n in names[:size]]
        at = filters[-1].mark(at, F.when(inner[-1].isNotNull(), _key(inner)), f"in_{size}")
        found.append(F.when(F.col(f"in_{size}"), F.concat_ws(" ", *inner)))
    found = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    out = at.select("id", "hash", "n_words", "pos", found.alias("found")).where((F.coalesce("pos", F.lit(0)) == 0) | (F.size("found") > 0))
    out = materialize(out, "candidates")
    for f in filters:
        f.forget()
    return out


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 13, max_words: int = 1 << 18) -> DataFrame:
    """Per document: (id_col, n_words, n_hit, n_items longs, items array<string>, __hash long).

    n_hit counts document words inside an occurrence of any window (``width`` consecutive item words, or a whole
    shorter item); items are the ids, as strings and sorted, of items with such an occurrence. One row per input row;
    __hash is xxhash64 of the text and tells apart rows that share an id. A null text has no words; an item
    without words has no window; items that share an id count as one, and a null item id is the empty string. An empty
    benchmark leaves all documents clean, an empty table gives no rows. Other columns are not read. ``max_words`` bounds
    the filter of shingles: 8 bytes each.
    """
    windows = materialize(_windows(items, item_col, item_text_col, width), "windows")
    shingles = materialize(_shingles(windows), "window-shingles")
    candidates = _candidates(docs, id_col, text_col, shingles, max_words)
    base = candidates.where(F.coalesce("pos", F.lit(0)) == 0).select("id", "hash", "n_words")

    at = candidates.select("id", "hash", "n_words", "pos", F.explode("found").alias("shingle"))
    counts = materialize(at.groupBy("shingle").count(), "shingle-counts")
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "shingle", "off", "len")).alias("p")
    prefix = materialize(shingles.join(counts, "shingle", "left").groupBy("window_id").agg(rarest).where("p.count > 0").select("window_id", "p.shingle", "p.off", "p.len"), "prefixes")
    start = F.col("pos") - F.col("off")
    bounded = at.join(prefix, "shingle").where((start >= 0) & (start + F.col("len") <= F.col("n_words")))
    tried = bounded.select("id", "hash", start.alias("start"), "window_id").distinct()
    # Shingles that cover a window: every SHINGLE-th, and the last.
    cover = shingles.where((F.col("off") % SHINGLE == 0) | (F.col("off") == F.col("len") - F.col("size"))).select("window_id", "len", "off", "shingle")
    asked = tried.join(cover, "window_id").select("id", "hash", "start", "window_id", "len", (F.col("start") + F.col("off")).alias("pos"), "shingle")
    there = at.select(F.col("id").alias("i"), F.col("hash").alias("h"), F.col("pos").alias("p"), F.col("shingle").alias("s"))
    stands = asked.join(there, F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")) & (F.col("pos") == F.col("p")) & (F.col("shingle") == F.col("s")), "left_semi")
    needed = F.ceil(F.col("len") / SHINGLE)
    hits = materialize(stands.groupBy("id", "hash", "start", "window_id", "len").count().where(F.col("count") == needed).drop("count"), "hits")
    covered = hits.select("id", "hash", "start", "len").distinct().select("id", "hash", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("pos")).distinct().groupBy("id", "hash").agg(F.count("pos").alias("n_hit"))
    named = hits.select("id", "hash", "window_id").distinct().join(windows.select("window_id", "item"), "window_id").groupBy("id", "hash").agg(F.sort_array(F.collect_set("item")).alias("items"))
    on = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["hash"] == b["hash"])
    verdict = materialize(covered.join(named, on(covered, named)).select(covered["id"], covered["hash"], "n_hit", "items"), "verdicts")
    forget(docs.sparkSession, windows, shingles, counts, prefix, hits)
    out = base.join(verdict, on(base, verdict), "left")
    return out.select(
        base["id"].alias(id_col), base["n_words"], F.coalesce(verdict["n_hit"], F.lit(0)).alias("n_hit"), F.coalesce(F.size(verdict["items"]), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(verdict["items"], F.array().cast("array<string>")).alias("items"), base["hash"].alias("__hash"),
    )


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated ones, all columns as they were, whatever their names and types.

    Contaminated is a document of which a twentieth of the words or more is hit (see contamination()). A null, empty or wordless text is clean; rows that
    repeat an id and text share their fate; texts of any length are judged whole. An empty benchmark drops nothing, an empty table stays empty.
    """
    found = contamination(docs, items, id_col=id_col, text_col=text_col).where(is_contaminated())
    bad = materialize(found.select(F.col(id_col).alias("id"), F.col("__hash").alias("hash")).distinct(), "contaminated")
    return without(docs, bad, id_col, F.xxhash64(F.col(f"`{text_col}`")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), h AS (
  SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n
), p AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id
), m AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""
