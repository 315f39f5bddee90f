"""Ranking metrics over query sets, latency and cost summaries, baseline comparison.

ranked: (query_id, key, rank); judged: (query_id, key, grade). A query without
hits scores 0 everywhere and still counts. ``coverage`` is the share of relevant
keys found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..registry import metrics as registry

METRICS = ("precision", "coverage", "hit_rate", "ndcg", "mrr")


def per_query(ranked: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """query_id and the five metrics at k."""
    grades = judged.groupBy("query_id", "key").agg(F.max("grade").alias("grade"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("grade").desc()))
    gain = lambda g, pos: (F.pow(F.lit(2.0), g) - 1) / F.log2(pos + 1)
    ideal = grades.filter("grade > 0").withColumn("pos", place).groupBy("query_id").agg(F.count("*").alias("n_rel"), F.sum(F.when(F.col("pos") <= k, gain(F.col("grade"), F.col("pos")))).alias("idcg"))
    hits = ranked.filter(F.col("rank") <= k).join(grades, ["query_id", "key"]).filter("grade > 0")
    hits = hits.withColumn("again", F.row_number().over(W.partitionBy("query_id", "key").orderBy("rank")))
    found = hits.groupBy("query_id").agg(
        F.count("*").alias("positions"),
        F.sum(F.when(F.col("again") == 1, 1)).alias("keys"),
        F.min("rank").alias("first"),
        F.sum(F.when(F.col("again") == 1, gain(F.col("grade"), F.col("rank")))).alias("dcg"),
    )
    all_queries = judged.select("query_id").distinct()
    t = all_queries.join(ideal, "query_id", "left").join(found, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return t.select(
        "query_id",
        zero(F.col("positions") / F.lit(k)).alias("precision"),
        zero(F.col("keys") / F.col("n_rel")).alias("coverage"),
        F.when(F.col("positions") > 0, 1.0).otherwise(0.0).alias("hit_rate"),
        zero(F.col("dcg") / F.col("idcg")).alias("ndcg"),
        zero(1 / F.col("first")).alias("mrr"),
    )


for _name in METRICS:
    registry.register(_name, lambda ranked, judged, k, _n=_name: per_query(ranked, judged, k).select("query_id", _n))


def evaluate(ranked: DataFrame, judged: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(query_id, metric, k, value), long form."""
    out = None
    for k in ks:
        names = ", ".join(f"'{m}', {m}" for m in METRICS)
        part = per_query(ranked, judged, k).selectExpr("query_id", f"stack({len(METRICS)}, {names}) as (metric, value)", f"{k} as k")
        out = part if out is None else out.unionByName(part)
    return out.select("query_id", "metric", "k", "value")


def mean_by_run(outcomes: DataFrame) -> DataFrame:
    """(run_id, metric, k) means over the queries that did not fail, 6 digits."""
    return outcomes.filter("error is null").groupBy("run_id", "metric", "k").agg(F.round(F.avg("value"), 6).alias("value"), F.count("*").alias("n_queries"))


def percentile(column: str, p: float) -> Column:
    """Exact, interpolated; 0 for no rows."""
    return F.coalesce(F.percentile(column, F.lit(p)), F.lit(0.0))


def latency_summary(samples: DataFrame, column: str, by: list[str]) -> DataFrame:
    r = lambda c, n: F.round(F.coalesce(c, F.lit(0.0)), 3).alias(n)
    return samples.groupBy(*by).agg(*[r(percentile(column, p), f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)], r(F.avg(column), "mean"), r(F.min(column), "low"), r(F.max(column), "high"))


def cost(tokens: Column, price_per_million: Column, local: Column) -> Column:
    """USD at 8 digits; 0 for local models; null where the price is unknown."""
    return F.when(local, 0.0).otherwise(F.round(tokens * price_per_million / 1e6, 8))


def compare(baseline: DataFrame, current: DataFrame, threshold: float = 0.02) -> DataFrame:
    """(run_id, metric) full outer: delta, relative delta (null at a zero baseline) and verdict."""
    b, c = baseline.select("run_id", "metric", F.col("value").alias("base")), current.select("run_id", "metric", F.col("value").alias("now"))
    d = F.round(F.col("now") - F.col("base"), 9)
    verdict = F.when(F.col("base").isNull(), "added").when(F.col("now").isNull(), "missing").when(d < -threshold, "regressed").when(d > threshold, "improved").otherwise("same")
    return b.join(c, ["run_id", "metric"], "full_outer").select("run_id", "metric", "base", "now", d.alias("delta"), F.round(d / F.nullif(F.col("base"), F.lit(0.0)), 6).alias("relative"), verdict.alias("verdict"))
