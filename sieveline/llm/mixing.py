"""Operator 8: mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source). A token budget goes down the tree: at
each node it is shared among the children by weight, no child getting more than
its subtree can give (tokens times ``max_epochs``). What a child can't take goes
to its siblings first; only if all of them are full does it go back to the
ancestors. The share is the closed form of water filling: level = max over the
children, in order of capacity per weight, of (budget - capacities before) /
(weights from here on), and a child gets least(capacity, weight * level). So
three window expressions over the table of leaves do it, without a loop.

A leaf takes whole epochs of all its documents and then a prefix, by tokens, of
the next epoch in seeded hash order. The prefix is found without sorting a
leaf: sums by hash bucket decide all buckets but the one where the prefix ends,
and only that bucket's rows are shuffled and ordered.

Defined cases: null domain, language or source are leaves of their own with the
default weight; null or empty texts have no tokens and are never selected;
repeated rows are selected apart, equal ones are interchangeable; ties of the
hash go by doc_id; an empty table gives an empty selection; further columns, whatever
their names, are carried along by ``select`` untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Saved, docs_table

WS = r"[^\x20\x09-\x0D]+"
#: Weights among siblings; what isn't named has the weight of "*".
DOMAIN_WEIGHTS = {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 2.0, "*": 1.0}
LANG_WEIGHTS = {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 2.0, "*": 1.0}
SOURCE_WEIGHTS = {"src0": 3.0, "*": 1.0}
#: Budget in tokens as a share of all tokens; most times that a document may be taken; seed of the order.
BUDGET_SHARE, MAX_EPOCHS, SEED = 1.0, 4, "mix-1"
BUCKET_HEX = 3  # 4,096 buckets a leaf
MAX_BROADCAST_LEAVES = 20_000


def domain_of(source):
    """The domain of a source: here its number modulo 4; a parameter of ``select``."""
    n = F.regexp_extract(source, r"^src(\d{1,9})$", 1)
    return F.when(n != "", F.concat(F.lit("d"), (n.cast("int") % 4).cast("string"))).otherwise("other")


def _weight(col: str, table: dict[str, float]):
    e = F.lit(table["*"])
    for k, v in table.items():
        if k != "*":
            e = F.when(F.col(col) == k, F.lit(v)).otherwise(e)
    return e


def _share(rows: DataFrame, parent: list[str], name: str, cap: str, weight, budget: str, out: str) -> DataFrame:
    """Adds ``out``: each row's share of its parent's ``budget``."""
    rows = rows.withColumn("_w", weight).withColumn("_r", F.when(F.col("_w") > 0, F.col(cap) / F.col("_w")).otherwise(F.lit(1e300)))
    part = W.partitionBy(*parent)
    order = part.orderBy("_r", F.coalesce(name, F.lit("")))
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(order.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("_l", F.when(rest > 0, (F.col(budget) - before) / rest))
    level = F.coalesce(F.max("_l").over(part), F.lit(0.0))
    return rows.withColumn(out, F.greatest(F.lit(0.0), F.least(F.col(cap), F.col("_w") * level))).drop("_w", "_r", "_l")


def budgets(leaves: DataFrame, total, max_epochs: int = MAX_EPOCHS, weights=(DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS)) -> DataFrame:
    """(domain, lang, source, tokens) leaves -> with ``budget`` in whole tokens. total: a Column over ``all_tokens``."""
    t = leaves.withColumn("cap", F.col("tokens").cast("double") * max_epochs)
    t = t.withColumn("all_tokens", F.sum("tokens").over(W.partitionBy(F.lit(0)))).withColumn("b0", total)
    doms = t.groupBy("domain").agg(F.sum("cap").alias("dcap"), F.max("b0").alias("b0"))
    doms = _share(doms.withColumn("_root", F.lit(0)), ["_root"], "domain", "dcap", _weight("domain", weights[0]), "b0", "b1")
    langs = t.groupBy("domain", "lang").agg(F.sum("cap").alias("lcap"))
    langs = langs.join(doms.select("domain", "b1"), langs["domain"].eqNullSafe(doms["domain"])).select(langs["domain"], "lang", "lcap", "b1")
    langs = _share(langs, ["domain"], "lang", "lcap", _weight("lang", weights[1]), "b1", "b2")
    l2 = langs.select(F.col("domain").alias("_d"), F.col("lang").alias("_g"), "b2")
    t = t.join(l2, t["domain"].eqNullSafe(l2["_d"]) & t["lang"].eqNullSafe(l2["_g"])).drop("_d", "_g")
    t = _share(t, ["domain", "lang"], "source", "cap", _weight("source", weights[2]), "b2", "b3")
    return t.select("domain", "lang", "source", "tokens", F.floor(F.round("b3", 6)).cast("bigint").alias("budget"))


KEY = ["domain", "lang", "source"]


def _same(t: DataFrame, other: DataFrame):
    e = F.lit(True)
    for c in KEY:
        e = e & t[c].eqNullSafe(other[f"_{c}"])
    return e


def _renamed(t: DataFrame, *more: str) -> DataFrame:
    return t.select(*[F.col(c).alias(f"_{c}") for c in KEY], *more)


def tokens_of(docs: DataFrame, domain=domain_of) -> DataFrame:
    """(id, domain, lang, source, n_tokens), one row per document that has tokens, as a table: the texts are read and counted once."""
    return Saved(_keyed(docs, domain).select("id", *KEY, "n_tokens").filter("n_tokens > 0"), "mix").df


def _keyed(docs: DataFrame, domain) -> DataFrame:
    return docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"),
        F.col("doc_id").cast("bigint").alias("id"),
        domain(F.col("source")).alias("domain"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WS)), F.lit(0)).cast("bigint").alias("n_tokens"),
    )


def _hashed(rows: DataFrame, plan: DataFrame, seed: str, bucket_hex: int) -> DataFrame:
    """rows with their leaf's plan, ``h`` (place in the order of the partial epoch) and its ``bucket``."""
    joined = rows.join(plan, _same(rows, plan)).drop(*[f"_{c}" for c in KEY])
    joined = joined.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), F.col("whole").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    return joined.withColumn("bucket", F.substring("h", 1, bucket_hex))


def _bounded(plan: DataFrame, rows: int = MAX_BROADCAST_LEAVES) -> DataFrame:
    """One row a leaf: broadcast after its size was checked, else joined by shuffle."""
    return F.broadcast(plan) if plan.limit(rows + 1).count() <= rows else plan


def cuts(counted: DataFrame, budget_share: float, max_epochs: int, seed: str, weights, bucket_hex: int) -> DataFrame:
    """One row a leaf: whole epochs, tokens of the partial one, the bucket where its prefix ends and the tokens before that."""
    leaves = counted.groupBy(*KEY).agg(F.sum("n_tokens").alias("tokens"))
    plan = budgets(leaves, F.floor(F.round(F.col("all_tokens") * F.lit(budget_share), 6)).cast("double"), max_epochs, weights)
    plan = Saved(_renamed(plan, F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("whole"), (F.col("budget") % F.col("tokens")).alias("part")), "mix-plan").df
    # At most 16**bucket_hex rows a leaf, summed before the shuffle.
    sums = _hashed(counted, _bounded(plan), seed, bucket_hex).groupBy(*KEY, "whole", "part", "bucket").agg(F.sum("n_tokens").alias("n"))
    upto = sums.withColumn("upto", F.sum("n").over(W.partitionBy(*KEY).orderBy("bucket"))).filter("upto > part")
    edge = upto.groupBy(*KEY, "whole", "part").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("e"))
    return Saved(_renamed(edge, "whole", "part", F.col("e.bucket").alias("edge"), F.col("e.before").alias("before")), "mix-cut").df


def _chosen(rows: DataFrame, cut: DataFrame, seed: str, bucket_hex: int) -> DataFrame:
    """rows times epochs. Only rows of the buckets where prefixes end are shuffled."""
    at = _hashed(rows, _bounded(cut), seed, bucket_hex)
    inside = at.withColumn("_n", F.col("whole") + (F.col("bucket") < F.col("edge")).cast("int")).filter("_n > 0 and n_tokens > 0")
    inside = inside.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    last = at.filter("bucket = edge and part > before and n_tokens > 0")
    order = W.partitionBy(*KEY).orderBy("h", "id", "n_tokens").rowsBetween(W.unboundedPreceding, 0)
    last = last.withColumn("cum", F.sum("n_tokens").over(order) + F.col("before")).filter("cum <= part").withColumn("epoch", F.col("whole"))
    pick = lambda d: d.select(*rows.columns, F.col("epoch").cast("int").alias("epoch"))
    return pick(inside).unionByName(pick(last))


def select(docs: DataFrame, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED, domain=domain_of, weights=(DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS), bucket_hex: int = BUCKET_HEX) -> DataFrame:
    """One row per document and epoch taken: ``doc`` (the whole input row), ``id``, ``domain``, ``lang``, ``source``, ``n_tokens``, ``epoch`` from 0."""
    rows = Saved(_keyed(docs, domain), "mix").df  # tokens are counted once; the cuts read their columns alone
    cut = cuts(rows.select("id", *KEY, "n_tokens").filter("n_tokens > 0"), budget_share, max_epochs, seed, weights, bucket_hex)
    return _chosen(rows, cut, seed, bucket_hex)


def query(spark, sf_dir):
    """The selection by number: texts are left at the scan, their counts go on."""
    counted = tokens_of(docs_table(spark, sf_dir).select("doc_id", "lang", "source", "text"))
    cut = cuts(counted, BUDGET_SHARE, MAX_EPOCHS, SEED, (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS), BUCKET_HEX)
    return _chosen(counted, cut, SEED, BUCKET_HEX).select(F.col("id").alias("doc_id"), *KEY, "epoch", "n_tokens")


def _case(col: str, table: dict[str, float]) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN {v}::DOUBLE" for k, v in table.items() if k != "*") + f" ELSE {table['*']}::DOUBLE END"


def sql(table: str = "documents", prefix: str = "") -> str:
    """The selection in DuckDB. prefix: further CTEs that define ``table``, ending in a comma."""

    def share(src, parent, name, cap, weight, budget, out):
        return f"""(SELECT *, greatest(0::DOUBLE, least({cap}, w * coalesce(max(l) OVER (PARTITION BY {parent}), 0))) AS {out} FROM (
            SELECT *, CASE WHEN rest > 0 THEN ({budget} - bef) / rest END AS l FROM (
            SELECT *, coalesce(sum({cap}) OVER (PARTITION BY {parent} ORDER BY r, coalesce({name}, '') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef,
              sum(w) OVER (PARTITION BY {parent} ORDER BY r, coalesce({name}, '') ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM (
            SELECT *, CASE WHEN w > 0 THEN {cap} / w ELSE 1e300 END AS r FROM (SELECT *, {weight} AS w FROM {src}) a) b) c) d)"""

    return rf"""
    WITH {prefix} t AS (SELECT doc_id, CASE WHEN regexp_matches(source, '^src[0-9]{{1,9}}$') THEN 'd' || (substr(source, 4)::INT % 4) ELSE 'other' END AS domain, lang, source,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM {table}),
    r AS (SELECT * FROM t WHERE n_tokens > 0),
    lv AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::DOUBLE * {MAX_EPOCHS} AS cap FROM r GROUP BY ALL),
    tot AS (SELECT floor(round(sum(tokens)::DOUBLE * {BUDGET_SHARE}, 6))::DOUBLE AS b0 FROM lv),
    d0 AS (SELECT domain, sum(cap)::DOUBLE AS dcap, 0 AS root FROM lv GROUP BY domain),
    d1 AS (SELECT * FROM {share("(SELECT d0.*, b0 FROM d0, tot)", "root", "domain", "dcap", _case("domain", DOMAIN_WEIGHTS), "b0", "b1")}),
    g0 AS (SELECT lv.domain, lang, sum(cap)::DOUBLE AS lcap, any_value(b1) AS b1 FROM lv JOIN d1 ON lv.domain IS NOT DISTINCT FROM d1.domain GROUP BY lv.domain, lang),
    g1 AS (SELECT * FROM {share("g0", "domain", "lang", "lcap", _case("lang", LANG_WEIGHTS), "b1", "b2")}),
    s0 AS (SELECT lv.*, g1.b2 FROM lv JOIN g1 ON lv.domain IS NOT DISTINCT FROM g1.domain AND lv.lang IS NOT DISTINCT FROM g1.lang),
    s1 AS (SELECT domain, lang, source, tokens, floor(round(b3, 6))::BIGINT AS budget FROM {share("s0", "domain, lang", "source", "cap", _case("source", SOURCE_WEIGHTS), "b2", "b3")}),
    p AS (SELECT r.*, (budget // tokens)::INT AS whole, budget % tokens AS part, md5('{SEED}:' || (budget // tokens) || ':' || coalesce(doc_id::VARCHAR, '')) AS h
          FROM r JOIN s1 ON r.domain IS NOT DISTINCT FROM s1.domain AND r.lang IS NOT DISTINCT FROM s1.lang AND r.source IS NOT DISTINCT FROM s1.source),
    c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS cum FROM p),
    mix AS (SELECT doc_id, domain, lang, source, unnest(range(0, whole))::INT AS epoch, n_tokens FROM p WHERE whole > 0
    UNION ALL SELECT doc_id, domain, lang, source, whole AS epoch, n_tokens FROM c WHERE cum <= part)
    SELECT doc_id, domain, lang, source, epoch, n_tokens FROM mix"""
