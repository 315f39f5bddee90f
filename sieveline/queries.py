"""Driver queries of the engine, each over its whole tables, and the same in DuckDB SQL.

Query sets: every benchmark text for lexical search; for vectors every row whose
vec_id is divisible by 100, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .functions import ids, text
from .functions.extract import extracted
from .operators import chunking as C
from .operators import metrics as M
from .operators import retrieval as R
from .operators.embedding import cosine_similarity, embed, l2_normalize
from .operators.filters import SearchFilters, predicate
from .plans import store as S
from .plans.sync import counts, outcomes
from .registry import chunkers
from .sources.files import page_for_offset

K = 10


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _chunks(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source")


def _queries(spark, d):
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _vectors(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def _vector_queries(spark, d):
    return _vectors(spark, d).filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector")


def _named(df):
    return df.select("query_id", F.col("chunk_id").alias("doc_id"), "score", F.col("rank").cast("bigint").alias("rank"))


# --- retrieval ---------------------------------------------------------------


def bm25_topk(spark, d, where=None, **options):
    chunks = _chunks(spark, d)
    return _named(R.bm25(_queries(spark, d), chunks.filter(where) if where is not None else chunks, K, **options))


def bm25_b0(spark, d):
    return bm25_topk(spark, d, b=0.0)


def bm25_filtered_stats(spark, d):
    f = SearchFilters(file_types=("en", "de"), source_ids=("src0", "src1", "src2", "src3"))
    return bm25_topk(spark, d, predicate(f, {"file_types": "lang", "source_ids": "source"}))


def bm25_tf_cap(spark, d):
    return bm25_topk(spark, d, tf_cap=3)


def bm25_term_stats(spark, d):
    p = R.postings(_chunks(spark, d))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_stopword_query_empty(spark, d):
    """Queries without any term find nothing."""
    q = _queries(spark, d).withColumn("text", F.regexp_replace("text", r"[\p{L}\p{N}_]", "."))
    return _named(R.bm25(q, _chunks(spark, d), K))


def corpus_stats(spark, d):
    n = _chunks(spark, d).select(F.size(text.simple_terms(F.col("text"))).alias("dl"))
    return n.agg(F.count("*").alias("n_docs"), F.round(F.avg("dl"), 6).alias("avgdl"))


_TOKENS = "SELECT doc_id, lang, source, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS ts FROM documents"
_QUERY_TERMS = "SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM benchmark"


def _bm25_sql(where: str = "TRUE", b: float = 0.75, cap: int = 0, depth: int = K) -> str:
    tf = f"least(tf, {cap})" if cap else "tf"
    return f"""
    toks AS (SELECT doc_id, ts, len(ts) AS dl FROM ({_TOKENS}) WHERE {where}),
    qt AS ({_QUERY_TERMS}),
    stats AS (SELECT count(*)::DOUBLE AS n, coalesce(avg(dl), 0)::DOUBLE AS avgdl FROM toks),
    tf AS (SELECT doc_id, dl, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, dl, unnest(ts) AS term FROM toks) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
    df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
    bm AS (SELECT query_id, doc_id, sum(ln(1::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * {tf} * 2.2::DOUBLE / ({tf} + 1.2::DOUBLE * ({1 - b}::DOUBLE + {b}::DOUBLE * dl / avgdl))) AS score
           FROM tf JOIN df USING (term) JOIN qt USING (term), stats GROUP BY query_id, doc_id),
    bmr AS (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm QUALIFY rank <= {depth})"""


def _bm25_top(**o) -> str:
    return f"WITH {_bm25_sql(**o)} SELECT query_id, doc_id, score, rank FROM bmr"


def dense_topk(spark, d):
    return _named(R.dense(_vector_queries(spark, d), _vectors(spark, d), K)).withColumnRenamed("doc_id", "vec_id")


def dense_filtered_topk(spark, d):
    v = _vectors(spark, d).withColumn("model_key", F.when(F.col("label") < 5, "hash:a").otherwise("hash:b"))
    return _named(R.dense(_vector_queries(spark, d), v, K, "hash:a")).withColumnRenamed("doc_id", "vec_id")


def _dense_sql(where: str = "vec_id IS NOT NULL", depth: int = K) -> str:
    return f"""
    v AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
    dn AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.{where}),
    dnr AS (SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM dn QUALIFY rank <= {depth})"""


def _lists(spark, d):
    """Benchmark texts as lexical queries; as dense ones the vector of the same number, against documents by number."""
    q, docs = _queries(spark, d), _chunks(spark, d)
    v = _vectors(spark, d)
    qv = q.join(v.select(F.col("chunk_id").alias("query_id"), "vector"), "query_id").select("query_id", "vector")
    cv = v.join(docs.select("chunk_id"), "chunk_id")
    return {"dense": lambda n: R.dense(qv, cv, n), "bm25": lambda n: R.bm25(q, docs, n)}


def _hybrid_sql(fused: str) -> str:
    return f"""WITH {_bm25_sql(depth=3 * K)},
    v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    dn AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, list_cosine_similarity(q.v, c.v) AS score FROM v q, v c WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND c.vec_id IN (SELECT doc_id FROM documents)),
    dnr AS (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM dn QUALIFY rank <= {3 * K}),
    l AS (SELECT *, 'dense' AS r FROM dnr UNION ALL SELECT *, 'bm25' AS r FROM bmr),
    s AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1::DOUBLE END AS scaled FROM l WINDOW w AS (PARTITION BY query_id, r)),
    f AS (SELECT query_id, doc_id, sum(CASE r WHEN 'dense' THEN 0.65::DOUBLE ELSE 0.35::DOUBLE END * {fused}) AS score FROM s GROUP BY query_id, doc_id)
    SELECT query_id, doc_id, round(score, 8) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f QUALIFY rank <= {K}"""


_WEIGHTS = {"dense": 0.65, "bm25": 0.35}


def rrf_fusion(spark, d):
    return _named(R.hybrid(_lists(spark, d), K, "rrf", weights=_WEIGHTS))


def weighted_fusion(spark, d):
    return _named(R.hybrid(_lists(spark, d), K, "weighted", weights=_WEIGHTS))


def hybrid_components(spark, d):
    """How many components named each hybrid hit, from the component maps."""
    h = R.hybrid(_lists(spark, d), K, "rrf", weights=_WEIGHTS)
    return h.select("query_id", F.col("chunk_id").alias("doc_id"), F.size("component_ranks").cast("bigint").alias("n_lists"), F.col("component_ranks")["bm25"].cast("bigint").alias("bm25_rank"))


def rerank_none_pool(spark, d):
    return _named(R.search(lambda n: R.dense(_vector_queries(spark, d), _vectors(spark, d), n), 5, "none", 50)).withColumnRenamed("doc_id", "vec_id")


# --- evaluation --------------------------------------------------------------


def _judged(spark, d):
    """Vectors with a query's label are relevant; the query's own vector counts 3."""
    v = _vectors(spark, d)
    q = v.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "label")
    return v.join(F.broadcast(q), "label").select("query_id", F.col("chunk_id").alias("key"), F.when(F.col("query_id") == F.col("chunk_id"), 3).otherwise(1).alias("grade"))


def _metrics(spark, d):
    ranked = dense_topk(spark, d).select("query_id", F.col("vec_id").alias("key"), "rank")
    return M.per_query(ranked, _judged(spark, d), K)


def _rounded(df, *cols):
    return df.select("query_id", *[F.round(c, 9).alias(c) for c in cols])


def precision_coverage_at_k(spark, d):
    return _rounded(_metrics(spark, d), "precision", "coverage")


def hit_rate_mrr(spark, d):
    return _rounded(_metrics(spark, d), "hit_rate", "mrr")


def ndcg_graded(spark, d):
    return _rounded(_metrics(spark, d), "ndcg")


def metrics_mean_by_run(spark, d):
    ranked = dense_topk(spark, d).select("query_id", F.col("vec_id").alias("key"), "rank")
    rows = M.evaluate(ranked, _judged(spark, d), (5, K)).withColumn("run_id", F.concat(F.lit("dense__rerank-off__k"), F.col("k").cast("string"))).withColumn("error", F.lit(None).cast("string"))
    return M.mean_by_run(rows).select("run_id", "metric", "value", F.col("n_queries").cast("bigint").alias("n_queries"))


_METRIC_SQL = f"""WITH {_dense_sql()},
    j AS (SELECT q.vec_id AS query_id, c.vec_id AS key, CASE WHEN q.vec_id = c.vec_id THEN 3 ELSE 1 END AS grade FROM v q JOIN v c ON q.label = c.label WHERE q.vec_id % 100 = 0),
    i AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS pos FROM j),
    kk AS (SELECT unnest([5, 10]) AS k),
    ideal AS (SELECT query_id, k, count(*) AS n_rel, sum(CASE WHEN pos <= k THEN (2 ** grade - 1) / log2(pos + 1) END) AS idcg FROM i, kk GROUP BY query_id, k),
    f AS (SELECT dnr.query_id, k, count(*) AS n, min(rank) AS first, sum((2 ** grade - 1) / log2(rank + 1)) AS dcg FROM dnr JOIN j ON j.query_id = dnr.query_id AND j.key = dnr.vec_id, kk WHERE rank <= k GROUP BY dnr.query_id, k),
    m AS (SELECT ideal.query_id, ideal.k, coalesce(n / ideal.k, 0)::DOUBLE AS precision, coalesce(n / n_rel, 0)::DOUBLE AS coverage, CASE WHEN n > 0 THEN 1 ELSE 0 END::DOUBLE AS hit_rate, coalesce(dcg / idcg, 0)::DOUBLE AS ndcg, coalesce(1.0::DOUBLE / first, 0)::DOUBLE AS mrr FROM ideal LEFT JOIN f USING (query_id, k))"""


def _metric_cols(*cols: str) -> str:
    return f"{_METRIC_SQL} SELECT query_id, {', '.join(f'round({c}, 9) AS {c}' for c in cols)} FROM m WHERE k = {K}"


def percentile_latency(spark, d):
    return M.latency_summary(_t(spark, d, "events"), "value", ["event_type"])


def cost_estimate(spark, d):
    tokens = _t(spark, d, "conversations").groupBy("role").agg(F.sum(text.approx_tokens(F.coalesce("text", F.lit("")))).alias("tokens"))
    price = F.when(F.col("role") == "user", 0.02).when(F.col("role") == "assistant", 0.13)
    return tokens.select("role", "tokens", M.cost(F.col("tokens"), price, F.col("role") == "system").alias("usd"))


def baseline_compare(spark, d):
    """Mean value per event type: the first half of the events as the baseline of the second."""
    e = _t(spark, d, "events")
    half = e.agg((F.max("event_id") / 2).alias("h"))
    e = e.crossJoin(F.broadcast(half)).withColumn("late", F.col("event_id") > F.col("h"))
    mean = e.groupBy("late", F.col("event_type").alias("run_id")).agg(F.round(F.avg("value"), 6).alias("value")).withColumn("metric", F.lit("mean_value"))
    return M.compare(mean.filter("not late"), mean.filter("late"))


def label_resolution(spark, d):
    from .sources.datasets import resolved

    ranked = dense_topk(spark, d).select("query_id", F.col("vec_id").cast("string").alias("document_id"), "rank")
    names = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("label"))
    return resolved(ranked, names).select("query_id", "rank", "key")


# --- text, identifiers, chunks -----------------------------------------------


def token_count_approx(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.approx_tokens(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_tokens"))


def token_count_ws(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.whitespace_tokens(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_tokens"))


def normalize_whitespace(spark, d):
    t = text.normalize_whitespace(F.replace("text", F.lit(" "), F.lit(" \t ")))
    return _t(spark, d, "documents").select("doc_id", F.sha2(t, 256).alias("digest"), F.length(t).cast("bigint").alias("n"))


def document_uuid5(spark, d):
    return _t(spark, d, "documents").select("doc_id", ids.document_id(F.col("source"), F.col("doc_id").cast("string")).alias("document_id"))


def content_checksum(spark, d):
    return _t(spark, d, "documents").select("doc_id", ids.checksum(F.col("source"), F.col("text")).alias("checksum"))


def preview_lines(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.preview(F.col("text"), 80).alias("line"))


def _chunked(spark, d, name, **o):
    rows = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    counter = o.get("counter", "approx")
    c = C.with_chunks(rows, chunkers.create(name, **o), counter=counter, name=name)
    return c.select(F.col("document_id").cast("bigint").alias("doc_id"), F.col("position").cast("bigint").alias("position"), "start_char", "end_char", F.sha2("content", 256).alias("digest"), "chunk_id")


def chunk_fixed_ws(spark, d):
    return _chunked(spark, d, "fixed", chunk_size=128, overlap=0, counter="whitespace").select("doc_id", "position", "digest")


def chunk_fixed_overlap(spark, d):
    return _chunked(spark, d, "fixed", chunk_size=128, overlap=32, counter="whitespace").select("doc_id", "position", "digest")


def _fixed_sql(size: int, overlap: int) -> str:
    """Windows of whole words, joined by single spaces where the text has single white space."""
    step = size - overlap
    return rf"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '\S+\s*') AS w FROM documents),
    c AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE 1 + greatest(0, ceil((len(w) - {size}) / {step}.0))::BIGINT END)) AS position FROM t)
    SELECT doc_id, position, sha256(regexp_replace(array_to_string(w[position * {step} + 1 : position * {step} + {size}], ''), '\s+$', '')) AS digest FROM c"""


def chunk_fixed_approx(spark, d):
    return _chunked(spark, d, "fixed")


def chunk_sentence(spark, d):
    return _chunked(spark, d, "sentence", chunk_size=256)


def chunk_semantic(spark, d):
    return _chunked(spark, d, "semantic", max_chunk_size=256, dimensions=64)


def chunk_hierarchical(spark, d):
    rows = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    c = C.hierarchical_chunks(rows, 512, 128, 16)
    return c.select(F.col("document_id").cast("bigint").alias("doc_id"), "position", "chunk_level", "chunk_id", "parent_id", "token_count")


def html_text(spark, d):
    x = extracted("html", F.col("html"))
    return _t(spark, d, "pages").select("page_id", x.alias("x")).select("page_id", F.col("x.title").alias("title"), F.col("x.text").alias("text"))


def json_flatten(spark, d):
    return _t(spark, d, "events").select("event_id", extracted("json", F.col("props"))["text"].alias("text"))


def markdown_title(spark, d):
    md = F.concat(F.lit("\n# "), F.col("r_name"), F.lit(" ##\n\nbody  of "), F.col("r_name"))
    x = extracted("md", md)
    return _t(spark, d, "region").select("r_regionkey", x["title"].alias("title"), x["text"].alias("text"))


def embed_hash(spark, d):
    """The digest stands for the vector: 6 digits of every coordinate."""
    v = embed(F.col("text"), "hash", dimensions=64)
    return _t(spark, d, "documents").select("doc_id", F.array_join(F.transform(v, lambda x: F.format_string("%.6f", x)), ",").alias("vector"))


def vector_normalize(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double") * 2)
    n = l2_normalize(v)
    return _t(spark, d, "embeddings").select("vec_id", F.round(cosine_similarity(n, v), 6).alias("cosine"), F.round(F.aggregate(n, F.lit(0.0), lambda s, x: s + x * x), 6).alias("size"))


def vector_search_all_labels(spark, d):
    """Nearest other vector of each query, whatever its label."""
    q = _vectors(spark, d).filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    return _named(R.dense(q, _vectors(spark, d), 1, others=True)).withColumnRenamed("doc_id", "vec_id")


# --- filters -----------------------------------------------------------------


def filter_tags_any(spark, d):
    t = _t(spark, d, "documents").withColumn("tags", F.array("lang", "source"))
    return t.filter(predicate(SearchFilters(tags=("fr", "src5")))).select("doc_id")


def filter_metadata_contains(spark, d):
    return _t(spark, d, "events").filter(predicate(SearchFilters(metadata={"k": 7}), metadata="props")).select("event_id")


def filter_created_between(spark, d):
    f = SearchFilters(created_after="1995-01-01", created_before="1996-12-31")
    return _t(spark, d, "orders").filter(predicate(f, created="o_orderdate")).select("o_orderkey")


def filter_fields(spark, d):
    f = SearchFilters(source_types=("en", "es"), source_ids=("src1", "src2", "src3"))
    return _t(spark, d, "documents").filter(predicate(f, {"source_types": "lang", "source_ids": "source"})).select("doc_id")


def _stored(spark, d):
    """The documents in the store's own columns: author, repository and tags are in the metadata alone."""
    meta = F.to_json(F.struct(F.col("lang").alias("author"), F.col("source").alias("repository"), F.array("lang", "source").alias("tags")))
    return _t(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("source_type"), F.col("source").alias("source_id"), meta.alias("metadata"))


def _kept(spark, d, **fields):
    docs = _stored(spark, d)
    return docs.filter(predicate(SearchFilters(**fields), present=docs.columns)).select("doc_id")


def filter_authors_metadata(spark, d):
    return _kept(spark, d, authors=("fr", "es"))


def filter_repositories_metadata(spark, d):
    return _kept(spark, d, repositories=("src1", "src3"), authors=("en",))


def filter_tags_metadata(spark, d):
    return _kept(spark, d, tags=("de", "src2"))


def filter_document_ids(spark, d):
    return _kept(spark, d, document_ids=tuple(str(i) for i in range(0, 500, 7)))


def filter_empty(spark, d):
    return _t(spark, d, "documents").filter(predicate(SearchFilters())).select("doc_id")


# --- store and sync ----------------------------------------------------------


def _old_new(spark, d):
    """Documents of all sources but src9 as stored; those of even number, retitled, as found."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("source_type"), F.col("source").alias("source_id"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("title"), F.length("text").alias("n"))
    old = docs.filter("source_id <> 'src9'").withColumn("created_at", F.lit("2024-01-01"))
    new = docs.filter("id % 2 = 0").withColumn("title", F.concat("title", F.lit("b"))).withColumn("created_at", F.lit("2024-06-01"))
    return old, new


def upsert_documents(spark, d):
    """The documents of even number stand for a change set; the stored side is every source but src9."""
    old, new = _old_new(spark, d)
    return S.upsert_documents(old, new).select("id", "source_type", "source_id", "title", "created_at")


def replace_chunks(spark, d):
    """The first two turns of every third conversation stand for a change set; the stored side is the whole table."""
    old = _t(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("position"), "role")
    new = old.filter("document_id % 3 = 0 and position < 2").withColumn("role", F.lit("new"))
    return S.replace_chunks(old, new)


def upsert_vectors(spark, d):
    old = _t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("m"), (F.col("label") % 2).cast("string")).alias("model_key"), "label")
    new = old.filter("label < 3").withColumn("label", F.col("label") + 100)
    return S.upsert_vectors(old, new)


def vectors_attach(spark, d):
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    ch = _t(spark, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"))
    return S.attach(v, ch).select("chunk_id", "label", "document_id")


def delete_cascade(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"))
    ch = _t(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), "turn")
    ve = _t(spark, d, "embeddings").select(F.col("vec_id").alias("document_id"), "label")
    out = S.delete_documents(_t(spark, d, "documents").filter("lang = 'fr'").select(F.col("doc_id").alias("id")), docs, ch, ve)
    n = lambda df, name: df.agg(F.lit(name).alias("kind"), F.count("*").alias("n"))
    return n(out[0], "documents").unionByName(n(out[1], "chunks")).unionByName(n(out[2], "vectors"))


def prune_missing(spark, d):
    """A found side without every fifth document stands for a change set; the stored side is every source but src9."""
    old, _ = _old_new(spark, d)
    rows = old.withColumn("source_id", F.concat_ws("/", "source_id", F.col("id").cast("string")))
    return S.missing(rows, rows.filter("id % 5 <> 0"), "de").select("id", "source_id")


def _sync(spark, d):
    """Every fourth checksum as outdated and every fiftieth document as unreadable stand for a change set; all documents are found."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_id"), "doc_id", "lang", ids.checksum(F.col("source"), F.col("text")).alias("checksum"))
    known = docs.filter("lang <> 'es'").withColumn("checksum", F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.col("checksum")))
    found = docs.withColumn("error", F.when(F.col("doc_id") % 50 == 7, "unreadable"))
    return outcomes(found, known)


def sync_outcomes(spark, d):
    return _sync(spark, d).select("doc_id", "outcome")


def sync_counts(spark, d):
    r = _sync(spark, d).withColumn("chunks_written", F.when(F.col("outcome").isin("created", "updated"), 1).otherwise(0).cast("bigint"))
    return counts(r)


def list_documents_paged(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at"))
    return S.listing(o, 25, 50).select("id")


def chunks_by_position(spark, d):
    c = _t(spark, d, "conversations")
    return c.withColumn("position", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("bigint")).select("conv_id", "turn", "position")


def models_in_index(spark, d):
    return S.models_of(_t(spark, d, "embeddings").select(F.concat(F.lit("hash:m"), F.col("label").cast("string")).alias("model_key"), F.col("embedding").alias("vector")))


def health(spark, d):
    n = lambda t: _t(spark, d, t).agg(F.lit(t).alias("kind"), F.count("*").alias("n"))
    return n("documents").unionByName(n("conversations")).unionByName(n("embeddings"))


def page_of_offset(spark, d):
    p = _t(spark, d, "documents").select("doc_id", F.length("text").alias("n"))
    offsets = F.transform(F.sequence(F.lit(0), F.floor(F.col("n") / 1000).cast("int")), lambda i: F.struct((i + 1).alias("page"), (i * 1000 + 10).alias("start")))
    return p.select("doc_id", page_for_offset(offsets, F.floor(F.col("n") / 2)).cast("bigint").alias("page"), page_for_offset(offsets, F.lit(5)).cast("bigint").alias("none"))


def file_checksum(spark, d):
    return _t(spark, d, "pages").select("page_id", F.sha2(F.encode("html", "UTF-8"), 256).alias("checksum"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_b0, bm25_filtered_stats, bm25_tf_cap, bm25_term_stats, bm25_stopword_query_empty, corpus_stats,
        dense_topk, dense_filtered_topk, vector_search_all_labels, rrf_fusion, weighted_fusion, hybrid_components, rerank_none_pool,
        precision_coverage_at_k, hit_rate_mrr, ndcg_graded, metrics_mean_by_run, percentile_latency, cost_estimate, baseline_compare, label_resolution,
        token_count_approx, token_count_ws, normalize_whitespace, document_uuid5, content_checksum, file_checksum, preview_lines,
        chunk_fixed_ws, chunk_fixed_overlap, chunk_fixed_approx, chunk_sentence, chunk_semantic, chunk_hierarchical,
        html_text, json_flatten, markdown_title, embed_hash, vector_normalize,
        filter_tags_any, filter_metadata_contains, filter_created_between, filter_fields, filter_authors_metadata, filter_repositories_metadata, filter_tags_metadata, filter_document_ids, filter_empty,
        upsert_documents, replace_chunks, upsert_vectors, vectors_attach, delete_cascade, prune_missing, sync_outcomes, sync_counts, list_documents_paged, chunks_by_position, models_in_index, health, page_of_offset,
    )
}

_APPROX = r"list_sum(list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'), lambda w: CASE WHEN length(w) >= 6 THEN greatest(1, round_even(length(w) / 4.0, 0)) ELSE 1 END))"
_CHECK = "sha256(octet_length(encode(source))::VARCHAR || chr(0) || source || octet_length(encode(text))::VARCHAR || chr(0) || text)"
_H = "sha1(unhex('6f6b8d241f2b5a5e9f2f1b0e1f6a9c31') || encode('document:' || source || ':' || doc_id))"
_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(text, ' ', ' ' || chr(9) || ' '), '[ \t\r\f\v]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))"
_OLD = "(SELECT doc_id AS id, lang AS source_type, source AS source_id, 't' || doc_id AS title, '2024-01-01' AS created_at FROM documents WHERE source <> 'src9')"
_NEW = "(SELECT doc_id AS id, lang AS source_type, source AS source_id, 't' || doc_id || 'b' AS title, '2024-06-01' AS created_at FROM documents WHERE doc_id % 2 = 0)"
_SYNC = f"(SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN 'failed' WHEN lang = 'es' THEN 'created' WHEN doc_id % 4 = 0 THEN 'updated' ELSE 'unchanged' END AS outcome FROM documents)"

SQL = {
    "bm25_topk": _bm25_top(),
    "bm25_b0": _bm25_top(b=0.0),
    "bm25_filtered_stats": _bm25_top(where="lang IN ('en', 'de') AND source IN ('src0', 'src1', 'src2', 'src3')"),
    "bm25_tf_cap": _bm25_top(cap=3),
    "bm25_term_stats": f"WITH t AS ({_TOKENS}), p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM t) GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term",
    "bm25_stopword_query_empty": f"WITH {_bm25_sql()} SELECT query_id, doc_id, score, rank FROM bmr WHERE FALSE",
    "corpus_stats": f"SELECT count(*) AS n_docs, round(avg(len(ts)), 6) AS avgdl FROM ({_TOKENS})",
    "dense_topk": f"WITH {_dense_sql()} SELECT query_id, vec_id, score, rank FROM dnr",
    "dense_filtered_topk": f"WITH {_dense_sql('label < 5')} SELECT query_id, vec_id, score, rank FROM dnr",
    "vector_search_all_labels": f"WITH {_dense_sql('vec_id <> q.vec_id', 1)} SELECT query_id, vec_id, score, rank FROM dnr",
    "rrf_fusion": _hybrid_sql("1::DOUBLE / (60 + rank)"),
    "weighted_fusion": _hybrid_sql("scaled"),
    "hybrid_components": _hybrid_sql("1::DOUBLE / (60 + rank)").replace(f"SELECT query_id, doc_id, round(score, 8) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f QUALIFY rank <= {K}", f", top AS (SELECT query_id, doc_id FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= {K}) SELECT query_id, doc_id, count(*) AS n_lists, max(CASE WHEN r = 'bm25' THEN rank END) AS bm25_rank FROM top JOIN l USING (query_id, doc_id) GROUP BY query_id, doc_id"),
    "rerank_none_pool": f"WITH {_dense_sql()} SELECT query_id, vec_id, score, rank FROM dnr WHERE rank <= 5",
    "precision_coverage_at_k": _metric_cols("precision", "coverage"),
    "hit_rate_mrr": _metric_cols("hit_rate", "mrr"),
    "ndcg_graded": _metric_cols("ndcg"),
    "metrics_mean_by_run": f"{_METRIC_SQL}, u AS (UNPIVOT m ON precision, coverage, hit_rate, ndcg, mrr INTO NAME metric VALUE x) SELECT 'dense__rerank-off__k' || k AS run_id, metric, round(avg(x), 6) AS value, count(*) AS n_queries FROM u GROUP BY k, metric",
    "percentile_latency": "SELECT event_type, round(quantile_cont(value, 0.5), 3) AS p50, round(quantile_cont(value, 0.95), 3) AS p95, round(quantile_cont(value, 0.99), 3) AS p99, round(avg(value), 3) AS mean, round(min(value), 3) AS low, round(max(value), 3) AS high FROM events GROUP BY event_type",
    "cost_estimate": f"SELECT role, tokens, CASE role WHEN 'system' THEN 0::DOUBLE WHEN 'user' THEN round(tokens * 0.02::DOUBLE / 1e6::DOUBLE, 8) WHEN 'assistant' THEN round(tokens * 0.13::DOUBLE / 1e6::DOUBLE, 8) END AS usd FROM (SELECT role, sum(coalesce({_APPROX}, 0))::BIGINT AS tokens FROM conversations GROUP BY role)",
    "baseline_compare": "WITH m AS (SELECT event_id > (SELECT max(event_id) / 2 FROM events) AS late, event_type AS run_id, round(avg(value), 6) AS value FROM events GROUP BY ALL), j AS (SELECT coalesce(b.run_id, c.run_id) AS run_id, 'mean_value' AS metric, b.value AS base, c.value AS now, round(c.value - b.value, 9) AS delta FROM (SELECT * FROM m WHERE NOT late) b FULL JOIN (SELECT * FROM m WHERE late) c USING (run_id)) SELECT *, round(delta / nullif(base, 0), 6) AS relative, CASE WHEN base IS NULL THEN 'added' WHEN now IS NULL THEN 'missing' WHEN delta < -0.02 THEN 'regressed' WHEN delta > 0.02 THEN 'improved' ELSE 'same' END AS verdict FROM j",
    "label_resolution": f"WITH {_dense_sql()} SELECT query_id, rank, coalesce(source || '/' || doc_id, vec_id::VARCHAR) AS key FROM dnr LEFT JOIN documents ON doc_id = vec_id",
    "token_count_approx": f"SELECT doc_id, coalesce({_APPROX}, 0)::BIGINT AS n_tokens FROM documents",
    "token_count_ws": r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\S+'))::BIGINT AS n_tokens FROM documents",
    "normalize_whitespace": f"SELECT doc_id, sha256({_NORM}) AS digest, length({_NORM})::BIGINT AS n FROM documents",
    "document_uuid5": f"SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || printf('%02x', (('0x' || h[17:18])::INT & 63) | 128) || h[19:20] || '-' || h[21:32] AS document_id FROM (SELECT doc_id, {_H} AS h FROM documents)",
    "content_checksum": f"SELECT doc_id, {_CHECK} AS checksum FROM documents",
    "file_checksum": "SELECT page_id, sha256(html) AS checksum FROM pages",
    "preview_lines": r"WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents) SELECT doc_id, CASE WHEN length(f) > 80 THEN rtrim(f[1:79]) || '…' ELSE f END AS line FROM t",
    "chunk_fixed_ws": _fixed_sql(128, 0),
    "chunk_fixed_overlap": _fixed_sql(128, 32),
    "json_flatten": "SELECT event_id, 'k: ' || (props->>'k') AS text FROM events",
    "markdown_title": "SELECT r_regionkey, r_name || ' ##' AS title, '# ' || r_name || ' ##' || chr(10) || chr(10) || 'body of ' || r_name AS text FROM region",
    "vector_normalize": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 2) AS v FROM embeddings), n AS (SELECT vec_id, v, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM v) SELECT vec_id, round(list_cosine_similarity(u, v), 6) AS cosine, round(list_inner_product(u, u), 6) AS size FROM n",
    "filter_tags_any": "SELECT doc_id FROM documents WHERE lang = 'fr' OR source = 'src5'",
    "filter_metadata_contains": "SELECT event_id FROM events WHERE json_contains(props, '{\"k\": 7}')",
    "filter_created_between": "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'",
    "filter_fields": "SELECT doc_id FROM documents WHERE lang IN ('en', 'es') AND source IN ('src1', 'src2', 'src3')",
    "filter_authors_metadata": "SELECT doc_id FROM documents WHERE lang IN ('fr', 'es')",
    "filter_repositories_metadata": "SELECT doc_id FROM documents WHERE source IN ('src1', 'src3') AND lang = 'en'",
    "filter_tags_metadata": "SELECT doc_id FROM documents WHERE lang = 'de' OR source = 'src2'",
    "filter_document_ids": "SELECT doc_id FROM documents WHERE doc_id < 500 AND doc_id % 7 = 0",
    "filter_empty": "SELECT doc_id FROM documents",
    "upsert_documents": f"WITH o AS {_OLD}, n AS {_NEW} SELECT * FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT n.id, coalesce(o.source_type, n.source_type), coalesce(o.source_id, n.source_id), n.title, coalesce(o.created_at, n.created_at) FROM n LEFT JOIN o ON o.id = n.id",
    "replace_chunks": "SELECT conv_id AS document_id, turn AS position, role FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE conv_id % 3 = 0 AND turn < 2) UNION ALL SELECT conv_id, turn, 'new' FROM conversations WHERE conv_id % 3 = 0 AND turn < 2",
    "upsert_vectors": "SELECT vec_id AS chunk_id, 'm' || (label % 2) AS model_key, CASE WHEN label < 3 THEN label + 100 ELSE label END AS label FROM embeddings",
    "vectors_attach": "SELECT vec_id AS chunk_id, label, source AS document_id FROM embeddings JOIN documents ON doc_id = vec_id WHERE lang = 'en'",
    "delete_cascade": "WITH g AS (SELECT doc_id FROM documents WHERE lang = 'fr') SELECT 'documents' AS kind, (SELECT count(*) FROM documents WHERE doc_id NOT IN (FROM g)) AS n UNION ALL SELECT 'chunks', (SELECT count(*) FROM conversations WHERE conv_id NOT IN (FROM g)) UNION ALL SELECT 'vectors', (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (FROM g))",
    "prune_missing": "SELECT doc_id AS id, source || '/' || doc_id AS source_id FROM documents WHERE source <> 'src9' AND lang = 'de' AND doc_id % 5 = 0",
    "sync_outcomes": f"SELECT doc_id, outcome FROM {_SYNC}",
    "sync_counts": f"SELECT outcome, count(*) AS n, sum(CASE WHEN outcome IN ('created', 'updated') THEN 1 ELSE 0 END)::BIGINT AS chunks_written FROM {_SYNC} GROUP BY outcome",
    "list_documents_paged": "SELECT o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50",
    "chunks_by_position": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations",
    "models_in_index": "SELECT DISTINCT 'hash:m' || label AS model_key, len(embedding)::BIGINT AS dimensions FROM embeddings",
    "health": "SELECT 'documents' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'embeddings', count(*) FROM embeddings",
    "page_of_offset": "SELECT doc_id, CASE WHEN length(text) // 2 >= 10 THEN least(1 + (length(text) // 2 - 10) // 1000, 1 + length(text) // 1000) END::BIGINT AS page, NULL::BIGINT AS none FROM documents",
}
