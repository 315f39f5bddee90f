"""Operator 5: URL filters by a temporal list join.

Dated list entries (pattern, verdict, action add or remove, date) become
validity intervals, half open, the next entry of the same pattern ending one.
Every capture is expanded into the keys that could match it (its host, all
parent domains, and every path prefix of the host), met with the intervals by
key, and judged by those valid at its fetch time: the longest pattern decides,
and of equal ones ``allow``.

The list is broadcast only while it has at most ``BOUND`` intervals (counted
first); beyond that it is an equi-join on the key, which adaptive execution
splits where one key is hot. Only matches are aggregated.

Defined cases: a null or unparsable URL, or a null fetch time, is ``unlisted``;
entries of one pattern with the same date: ``remove`` applies last; repeated
entries and repeated captures are harmless, one row per capture comes back; an
empty list leaves all unlisted; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BOUND = 200_000

#: The list of the registered query.
ENTRIES = (
    ("example.net", "block", "add", "2024-02-01"),
    ("example.net", "block", "remove", "2024-08-15"),
    ("example.net", "block", "add", "2024-11-01"),
    ("example.org", "block", "add", "2024-05-01"),
    ("tionsh.example.net", "allow", "add", "2024-03-01"),
    ("tionsh.example.net", "allow", "remove", "2024-12-01"),
    ("therha.example.com", "block", "add", "2023-06-01"),
    ("therha.example.com", "block", "remove", "2024-09-10"),
    ("blog.tionble.example.com", "block", "add", "2024-07-01"),
    ("thther.example.org/en", "allow", "add", "2024-01-01"),
    ("thering.example.org/de", "allow", "add", "2024-06-01"),
    ("thering.example.org/de", "allow", "remove", "2024-06-20"),
    ("tionsh.example.net/fr", "block", "add", "2024-04-04"),
    ("com", "block", "add", "2024-12-24"),
    ("com", "block", "remove", "2024-12-27"),
)


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, verdict, action, listed_on) -> (pattern, verdict, valid_from, valid_to), for the adds only."""
    e = entries.filter("pattern is not null and verdict is not null and action in ('add', 'remove') and listed_on is not null").select(F.lower("pattern").alias("pattern"), "verdict", "action", F.col("listed_on").cast("timestamp").alias("valid_from")).distinct()
    nxt = F.lead("valid_from").over(W.partitionBy("pattern", "verdict").orderBy("valid_from", "action"))
    return e.withColumn("valid_to", nxt).filter("action = 'add' and (valid_to is null or valid_to > valid_from)").select("pattern", "verdict", "valid_from", "valid_to")


HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^[^:]+://[^/?#]*([^?#]*)"


def keys(url, depth: int):
    """Every pattern that could match a URL: the host's suffixes at dots, and the host and its path's prefixes at slashes.

    Prefixes go as deep as ``depth`` segments, those of the list's deepest pattern.
    """
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"^www\.", "")
    parts = F.split(host, r"\.")
    n = F.size(parts)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "."))
    segs = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda x: x != "")
    m = F.least(F.size(segs), F.lit(depth))
    prefixes = F.when(m > 0, F.transform(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segs, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.coalesce(host, F.lit("")) != "", F.concat(domains, prefixes))


def judge(captures: DataFrame, entries: DataFrame, bound: int = BOUND) -> DataFrame:
    """captures (page_id, url, fetched_at) with verdict (block, allow, unlisted), the deciding pattern and since when it held."""
    caps = captures.select("page_id", F.col("url").cast("string").alias("url"), F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    iv = intervals(entries)
    if iv.limit(bound + 1).count() <= bound:
        iv = F.broadcast(iv)
    depth = entries.agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0
    asked = caps.select("url", "fetched_at", F.explode(keys(F.col("url"), depth)).alias("pattern"))
    hit = asked.join(iv, "pattern").filter("fetched_at >= valid_from and (valid_to is null or fetched_at < valid_to)")
    rank = F.struct(F.length("pattern").alias("l"), (F.col("verdict") == "allow").cast("int").alias("a"), "verdict", "pattern", "valid_from")
    best = hit.groupBy("url", "fetched_at").agg(F.max(rank).alias("r"))
    out = caps.join(best, ["url", "fetched_at"], "left")
    return out.select("page_id", "url", "fetched_at", F.coalesce("r.verdict", F.lit("unlisted")).alias("verdict"), F.col("r.pattern").alias("pattern"), F.col("r.valid_from").alias("since"))


def query(spark, sf_dir):
    """``pages`` has no fetch time: page_id spreads the captures over the days of 2024."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    caps = pages.withColumn("fetched_at", F.timestamp_add("DAY", F.pmod("page_id", F.lit(366)).cast("int"), F.lit("2024-01-01").cast("timestamp")))
    entries = spark.createDataFrame(list(ENTRIES), "pattern string, verdict string, action string, listed_on string")
    found = judge(caps, entries)
    return found.select("page_id", "url", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched_on"), "verdict", "pattern", F.date_format("since", "yyyy-MM-dd").alias("since"))


def sql() -> str:
    values = ", ".join(f"('{p}', '{v}', '{a}', TIMESTAMP '{d}')" for p, v, a, d in ENTRIES)
    return rf"""
    WITH e(pattern, verdict, action, valid_from) AS (VALUES {values}),
    nx AS (SELECT *, lead(valid_from) OVER (PARTITION BY pattern, verdict ORDER BY valid_from, action) AS valid_to FROM e),
    iv AS (SELECT * FROM nx WHERE action = 'add' AND (valid_to IS NULL OR valid_to > valid_from)),
    c AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + (page_id % 366) * INTERVAL 1 DAY AS fetched_at,
            regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '^www\.', '') AS host,
            list_filter(string_split(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS segs FROM pages),
    k AS (SELECT page_id, url, fetched_at, unnest(list_concat(
            list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
            list_transform(range(1, len(segs) + 1), lambda i: host || '/' || array_to_string(segs[1:i], '/')))) AS pattern FROM c),
    hit AS (SELECT k.page_id, iv.pattern, verdict, valid_from FROM k JOIN iv USING (pattern) WHERE fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to)
            QUALIFY row_number() OVER (PARTITION BY k.page_id ORDER BY length(iv.pattern) DESC, (verdict = 'allow')::int DESC, verdict DESC, iv.pattern DESC, valid_from DESC) = 1)
    SELECT c.page_id, c.url, strftime(c.fetched_at, '%Y-%m-%d') AS fetched_on, coalesce(verdict, 'unlisted') AS verdict, pattern, strftime(valid_from, '%Y-%m-%d') AS since
    FROM c LEFT JOIN hit ON hit.page_id = c.page_id"""
