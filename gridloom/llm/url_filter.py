"""URL filters with a history: dated list entries become validity intervals, captures are judged as of their fetch time.

A list is a log of entries (kind, value, action, at): an add opens an interval for (kind, value), a remove closes it. A
capture asks for each suffix of its host, each directory prefix of its path and each query parameter name - of hosts and paths no more labels
and directories than the longest entry has, since longer ones cannot match, so keys stay few and short however long a url is. An entry applies where the
key matches and the fetch time lies in the interval.

Intervals are cut at every BUCKET_DAYS days of time, so the temporal join is an equi-join on (kind, value, bucket): the intervals of a key within
a bucket are one short row in order of time, however long the key's history, and the as-of step picks the last one that began by the fetch
time. Spark broadcasts that table if its size allows; else a host that holds a third of all captures makes a skewed join, which Spark splits.
Captures are grouped again by capture only, never by host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, table

BUCKET_DAYS = 30

#: Hand-written entries of the query's list (fixed values): kind, value, action, time in UTC.
ENTRIES = """
host      example.net         add     2024-02-01 00:00:00
host      example.net         remove  2024-05-01 00:00:00
host      example.net         add     2024-10-01 00:00:00
host      blog.thtion.example.com  add  2024-01-01 00:00:00
host      therha.example.com  add     2024-03-15 12:00:00
host      therha.example.com  remove  2024-03-15 12:00:00
host      thin.example.org    add     2024-06-01 00:00:00
host      thin.example.org    add     2024-07-01 00:00:00
host      thin.example.org    remove  2024-09-01 00:00:00
path      /fr                 add     2024-04-01 00:00:00
path      /fr                 remove  2024-08-01 00:00:00
path      /de                 add     2024-11-01 00:00:00
path      /en/9               add     2024-01-01 00:00:00
param     utm_source          add     2024-02-15 00:00:00
param     utm_source          remove  2024-12-01 00:00:00
param     ref                 remove  2024-03-01 00:00:00
param     ref                 add     2024-09-15 00:00:00
"""


#: Entries that a rule adds to them: directories of four languages, in turn added and removed.
RULED = 20_000
LANGS = ("en", "fr", "de", "es")


def ruled_entries(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    value = F.concat(F.lit("/"), F.get(F.array(*map(F.lit, LANGS)), (i % 4).cast("int")), F.lit("/"), (i % 9973).cast("string"))
    minutes = ((i * 6007) % (366 * 24 * 60)).cast("int")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    return spark.range(RULED).select(F.lit("path").alias("kind"), value.alias("value"), F.when(i % 5 < 3, "add").otherwise("remove").alias("action"), at.alias("at"))


def list_entries(spark: SparkSession, text: str = ENTRIES) -> DataFrame:
    rows = [(k, v, a, f"{d} {t}") for k, v, a, d, t in (x.split() for x in text.strip().splitlines())]
    return spark.createDataFrame(rows, "kind string, value string, action string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, value, since, until): when each key is listed; until is null for an open interval.

    Entries of one key are taken in order of time. Of entries at the same time a remove comes last, so that an interval is
    never empty. An add while listed and a remove while not listed change nothing. Entries with a null field, or another
    action, are left out; repeated entries count once.
    """
    valid = entries.where(F.col("kind").isNotNull() & F.col("value").isNotNull() & F.col("at").isNotNull() & F.col("action").isin("add", "remove"))
    last = valid.groupBy("kind", "value", "at").agg(F.max(F.col("action") == "add").alias("adds"), F.max(F.col("action") == "remove").alias("removes")).select("kind", "value", "at", (F.col("adds") & ~F.col("removes")).alias("on"))
    order = Window.partitionBy("kind", "value").orderBy("at")
    turns = last.withColumn("was", F.coalesce(F.lag("on").over(order), F.lit(False))).where(F.col("on") != F.col("was"))
    return turns.withColumn("until", F.lead("at").over(order)).where("on").select("kind", "value", F.col("at").alias("since"), "until")


def host_of(url: Column) -> Column:
    """Lower-cased host without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:]*)", 2))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def params_of(url: Column) -> Column:
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    return F.filter(F.transform(F.split(query, "&"), lambda p: F.element_at(F.split(p, "="), 1)), lambda p: p != "")


def keys_of(url: Column, labels_most: int, parts_most: int) -> Column:
    """The keys that a capture asks for, as structs (kind, value): at most so many labels of its host and directories of its path."""
    labels, parts = F.split(host_of(url), r"\."), F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    as_keys = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    upto = lambda values, most: F.when(F.least(F.size(values), F.lit(most)) > 0, F.sequence(F.lit(1), F.least(F.size(values), F.lit(most)))).otherwise(F.array().cast("array<int>"))
    suffixes = F.transform(upto(labels, labels_most), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    prefixes = F.transform(upto(parts, parts_most), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return F.array_distinct(F.concat(as_keys("host", F.filter(suffixes, lambda s: s != "")), as_keys("path", prefixes), as_keys("param", params_of(url))))


def _bucket(at: Column) -> Column:
    return F.floor(F.unix_seconds(at.cast("timestamp")) / (BUCKET_DAYS * 86400))


def judge(captures: DataFrame, entries: DataFrame, *, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """Per capture: (id_col, url_col, time_col, n_rules long, rules array<string>, blocked boolean).

    rules are the entries, as kind:value in order, that were active at the fetch time (since <= time < until). A null url or
    time matches nothing; repeated rows are judged each; an empty list blocks nothing and an empty table gives no
    rows. Other columns are not read. Urls of any length are read whole.
    """
    valid = intervals(entries)
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).cast("timestamp_ntz").alias("t"))
    longest = lambda kind, by: F.coalesce(F.max(F.when(F.col("kind") == kind, F.size(F.split("value", by)))), F.lit(0))
    labels_most, parts_most = valid.agg(longest("host", r"\."), longest("path", "/")).first()
    horizon = rows.agg(F.max(_bucket(F.col("t")))).first()[0]
    last = F.least(F.coalesce(_bucket(F.col("until")), F.lit(horizon)), F.lit(horizon))
    cut = valid.withColumn("b", _bucket(F.col("since"))).where(F.col("b") <= F.lit(horizon)).withColumn("b", F.explode(F.sequence("b", last)))
    spans = materialize(cut.groupBy("kind", "value", "b").agg(F.sort_array(F.collect_list(F.struct("since", "until"))).alias("spans")), "list-intervals")
    asked = rows.dropDuplicates(["id", "url", "t"]).withColumn("b", _bucket(F.col("t"))).select("id", "url", "t", "b", F.explode(keys_of(F.col("url"), labels_most, parts_most)).alias("k")).select("id", "url", "t", "b", "k.kind", "k.value")
    begun = F.try_element_at(F.filter("spans", lambda s: s["since"] <= F.col("t")), F.lit(-1))
    active = asked.join(spans, ["kind", "value", "b"]).withColumn("s", begun).where(F.col("s").isNotNull() & (F.col("s.until").isNull() | (F.col("t") < F.col("s.until"))))
    found = active.groupBy("id", "url", "t").agg(F.sort_array(F.collect_set(F.concat_ws(":", "kind", "value"))).alias("rules")).toDF("_id", "_url", "_t", "_rules")
    on = F.col("id").eqNullSafe(F.col("_id")) & F.col("url").eqNullSafe(F.col("_url")) & F.col("t").eqNullSafe(F.col("_t"))
    rules = F.coalesce(F.col("_rules"), F.array().cast("array<string>"))
    return rows.join(found, on, "left").select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("t").alias(time_col), F.size(rules).cast("long").alias("n_rules"), rules.alias("rules"), (F.size(rules) > 0).alias("blocked"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the list as it stood when the page was fetched.

    The table has no fetch time, so the query gives each page one in 2024 that follows from its id alone.
    """
    minutes = F.pmod(F.col("page_id") * 7919, F.lit(366 * 24 * 60))
    fetched = (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))).alias("fetched_at")
    out = judge(table(spark, sf_dir, "pages").select("page_id", "url", fetched), list_entries(spark).unionByName(ruled_entries(spark)))
    return out.select("page_id", "fetched_at", "n_rules", F.array_join("rules", ",").alias("rules"), "blocked")


SQL = (
    r"""
WITH e(kind, value, action, ts) AS (
  VALUES {rows}
  UNION ALL SELECT 'path', '/' || ['en', 'fr', 'de', 'es'][1 + i % 4] || '/' || (i % 9973), CASE WHEN i % 5 < 3 THEN 'add' ELSE 'remove' END, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((i * 6007) % 527040 AS INTEGER)) FROM range(20000) r(i)
),
l AS (
  SELECT kind, value, ts, bool_or(action = 'add') AND NOT bool_or(action = 'remove') AS "on" FROM e GROUP BY kind, value, ts
), t AS (
  SELECT *, coalesce(lag("on") OVER (PARTITION BY kind, value ORDER BY ts), false) AS was FROM l
), u AS (
  SELECT *, lead(ts) OVER (PARTITION BY kind, value ORDER BY ts) AS until FROM t WHERE "on" <> was
), v AS (SELECT kind, value, ts AS since, until FROM u WHERE "on"),
c AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((page_id * 7919) % 527040 AS INTEGER)) AS fetched_at,
         lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:]*)', 2)) AS host,
         list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts,
         string_split(regexp_extract(coalesce(url, ''), '^[^?#]*\?([^#]*)', 1), '&') AS params
  FROM pages
), k AS (
  SELECT page_id, fetched_at, 'host' AS kind, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') AS value
  FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM c)
  UNION
  SELECT page_id, fetched_at, 'path', '/' || array_to_string(list_slice(parts, 1, i), '/') FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM c)
  UNION
  SELECT page_id, fetched_at, 'param', string_split(p, '=')[1] FROM (SELECT *, unnest(params) AS p FROM c)
), m AS (
  SELECT DISTINCT page_id, k.kind || ':' || k.value AS rule FROM k JOIN v ON k.kind = v.kind AND k.value = v.value AND k.value <> '' AND since <= fetched_at AND (until IS NULL OR fetched_at < until)
), g AS (SELECT page_id, count(*) AS n_rules, string_agg(rule, ',' ORDER BY rule) AS rules FROM m GROUP BY page_id)
SELECT c.page_id, fetched_at, coalesce(n_rules, 0) AS n_rules, coalesce(rules, '') AS rules, coalesce(n_rules, 0) > 0 AS blocked FROM c LEFT JOIN g ON c.page_id = g.page_id
"""
).replace("{rows}", ", ".join(f"('{k}', '{v}', '{a}', TIMESTAMP '{d} {t}')" for k, v, a, d, t in (x.split() for x in ENTRIES.strip().splitlines())))
