"""Operator 4: quality rules, a threshold table compiled into one Spark projection.

No user functions: every metric is built-in expressions over the words and
lines of one row, so the work is a map without any shuffle.

Defined cases: a null or empty text has no words, all metrics 0, and fails the
base rule; repeated rows are judged alike, each on its own; an empty table
gives an empty table; further columns, whatever their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_text

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8
STOP_WORDS = (
    "the of and to in is that a it for was on with as be by at this from or are an "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
    "le la les de et des en un une du que est pour qui dans par sur au pas plus "
    "el la los las y en que del se por con un una para es al lo como su"
).split()

#: (metric, operator, bound): a document is kept if every line holds. The metrics are the ratios of ``METRICS``.
RULES: tuple[tuple[str, str, float], ...] = (
    ("n_words", ">=", 20),
    ("n_words", "<=", 1_000_000),
    ("mean_word_chars", ">=", 2.0),
    ("mean_word_chars", "<=", 14.0),
    ("symbols_per_word", "<=", 0.1),
    ("stop_kinds", ">=", 2),
    ("dup_line_share", "<=", 0.5),
    ("repeat_share", "<=", 0.3),
)


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def measured(docs: DataFrame, carry: str = "doc_id") -> DataFrame:
    """``carry`` and the counts that the rules use. Each ``select`` names arrays that later ones read, so none is evaluated twice."""
    a = docs.select(carry, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(carry, "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w"), _lines(F.col("text")).alias("ln"))
    b = a.select(
        carry,
        F.size("w").alias("n"),
        F.length(F.array_join("w", "")).alias("wc"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).alias("sym"),
        F.size("ln").alias("nl"),
        (F.size("ln") - F.size(F.array_distinct("ln"))).alias("dl"),
        F.size(F.array_intersect(F.col("w"), F.array(*[F.lit(x) for x in dict.fromkeys(STOP_WORDS)]))).alias("stops"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("hs"),
    )
    c = b.withColumn("wh", F.when(F.col("n") >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("hs", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))).drop("hs")
    # Only a text with an equal pair of windows pays for the sort that finds where they are.
    order = F.sort_array(F.transform("wh", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = c.withColumn("so", F.when(F.size(F.array_distinct("wh")) < F.size("wh"), order)).drop("wh")
    same = lambda x, i, j: F.coalesce(F.get(F.col("so"), i + j)["h"] == x["h"], F.lit(False))
    e = d.withColumn("at", F.sort_array(F.transform(F.filter("so", lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"]))).drop("so")
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )
    long = lambda c: F.col(c).cast("bigint")
    return e.select(carry, long("n").alias("n_words"), long("wc").alias("word_chars"), long("sym").alias("n_symbols"), long("dl").alias("n_dup_lines"), F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"), long("nl").alias("n_lines"), long("stops").alias("stop_kinds"))


METRICS = {
    "n_words": lambda: F.col("n_words").cast("double"),
    "mean_word_chars": lambda: F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
    "symbols_per_word": lambda: F.col("n_symbols") / F.greatest(F.col("n_words"), F.lit(1)),
    "stop_kinds": lambda: F.col("stop_kinds").cast("double"),
    "dup_line_share": lambda: F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    "repeat_share": lambda: F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
}


def compiled(rules=RULES) -> Column:
    """The threshold table as one boolean expression."""
    verdict = F.lit(True)
    for metric, op, bound in rules:
        m = METRICS[metric]()
        verdict = verdict & (m >= F.lit(float(bound)) if op == ">=" else m <= F.lit(float(bound)))
    return verdict


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def quality(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per input row: the counts, ``base_failed`` and ``kept``."""
    return beside(doc_text(docs), "doc_id", rules)


def beside(docs: DataFrame, carry: str, rules=RULES) -> DataFrame:
    """``carry``, a column of any type, with the metrics and verdict of the row's ``text``."""
    return measured(docs, carry).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def query(spark, sf_dir):
    from .common import docs_table

    return quality(docs_table(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "stop_kinds")


def sql(table: str = "documents") -> str:
    """The same rows in DuckDB."""
    stops = ", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))
    names = {
        "n_words": "n_words::double",
        "mean_word_chars": "word_chars / greatest(n_words, 1)",
        "symbols_per_word": "n_symbols / greatest(n_words, 1)",
        "stop_kinds": "stop_kinds::double",
        "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
        "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    }
    rules = " AND ".join(f"{names[m]} {op} {float(b)}" for m, op, b in RULES)
    return rf"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM {table}),
    w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM t),
    win AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
    dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) >= 2),
    cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY doc_id),
    m AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
            (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ln)::BIGINT AS n_lines, len(list_distinct(list_filter(w.w, lambda x: list_contains([{stops}], x))))::BIGINT AS stop_kinds
          FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
      (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {rules}) AS kept, n_lines, stop_kinds FROM m"""
