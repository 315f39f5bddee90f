"""Composition: settings and a store give ingestion and search over query sets."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..errors import PluginNotFoundError, StorageError
from ..log import logger, request
from ..operators import retrieval as R
from ..operators.embedding import embed, model_key
from ..operators.filters import SearchFilters, predicate
from .store import Store
from .sync import ANALYZERS, Options, sync


class Context:
    """encode: texts -> vectors, for an embedding provider that has no model here."""

    def __init__(self, spark: SparkSession, settings: Settings, encode: Callable | None = None):
        self.spark, self.settings, self.encode = spark, settings, encode
        self.store = Store(spark, settings.store.path, settings.store.buckets)

    def ingest(self, found: DataFrame, source_type: str, force: bool = False, prune: bool = True, scope: str | None = None, fetch: Callable | None = None) -> DataFrame:
        c, e = self.settings.chunking, self.settings.embedding
        own = {"fixed": ("chunk_size", "overlap"), "sentence": ("chunk_size", "overlap_sentences"), "semantic": ("breakpoint_percentile", "buffer_size", "max_chunk_size", "min_sentences"), "hierarchical": ("parent_size", "chunk_size", "overlap")}
        options = {k: getattr(c, k) for k in own.get(c.strategy, ())}
        return sync(self.store, found, source_type, Options(c.strategy, options, e.provider, e.dimensions, force, prune, scope, e.model, e.batch_size, self.encode, self.settings.lexical.analyzer), fetch)

    def scoped(self, filters: SearchFilters | None) -> dict[str, DataFrame]:
        """Chunks, vectors and postings of the documents that pass the filters, so statistics and candidates agree."""
        t = {name: self.store.read(name) for name in ("chunks", "vectors", "postings")}
        if t["chunks"] is None:
            raise StorageError("the index is empty; ingest first")
        if filters is not None and not filters.is_empty:
            docs = self.store.read("documents")
            keep = docs.filter(predicate(filters, present=docs.columns)).select(F.col("id").alias("document_id"))
            t = {name: df.join(keep, "document_id", "left_semi") for name, df in t.items()}
        return t

    def search(self, queries: DataFrame, strategy: str | None = None, k: int | None = None, filters: SearchFilters | None = None, reranker: str | None = None, timing: dict[str, float] | None = None, **options) -> DataFrame:
        """(query_id, text) queries -> hits with content, document title and uri.

        timing: filled with milliseconds by stage. Each stage's rows, which the size of
        the query set bounds, are then held in memory before the next one begins.
        """
        clock = Clock(timing)
        s = self.settings
        strategy, k = strategy or s.retrieval.default, k if k is not None else s.retrieval.top_k
        reranker = reranker or (s.reranking.strategy if s.reranking.enabled else "none")
        t = self.scoped(filters)
        chunks, vectors = t["chunks"], t["vectors"]
        e = s.embedding
        key = model_key(e.provider, e.model)
        q = queries.filter("length(trim(text)) > 0")
        qv = q.select("query_id", embed(F.col("text"), e.provider, dimensions=e.dimensions, model=e.model, batch_size=e.batch_size, encode=self.encode).alias("vector"))
        asked = set(s.hybrid.components if strategy == "hybrid" else [strategy])
        if "dense" in asked:
            qv = clock.held("embedding_ms", qv)
        lexical = {"k1": s.lexical.k1, "b": s.lexical.b, "terms": ANALYZERS[s.lexical.analyzer]}

        def bm25(n: int) -> DataFrame:
            if self.store.setting("analyzer") == s.lexical.analyzer:
                return R.top_k(R.bm25_index_scores(q, t["postings"], chunks.select("chunk_id", "n_terms"), **lexical), n).withColumn("retriever", F.lit("bm25"))
            return R.bm25(q, chunks.select("chunk_id", F.col("content").alias("text")), n, **lexical)  # another analyzer than the index has

        make = {
            "dense": lambda n: R.dense(qv, vectors.select("chunk_id", "vector", "model_key"), n, key),
            "bm25": bm25,
        }
        h = s.hybrid
        extra = {"rrf_k": h.rrf_k} if h.fusion == "rrf" else {}
        one = dict(make)
        make = {c: (lambda n, c=c: clock.held("retrieval_ms", one[c](n))) for c in one}
        make["hybrid"] = lambda n: clock.held("fusion_ms", R.hybrid({c: make[c] for c in h.components}, n, h.fusion, h.multiplier, weights={"dense": h.dense, "bm25": h.bm25}, **extra))
        if strategy not in make:
            raise PluginNotFoundError(f"no retrieval strategy {strategy!r}; there are {', '.join(sorted(make))}")
        retrieve = make[strategy]
        if reranker not in ("none", "off"):
            inner = retrieve
            retrieve = lambda n: inner(n).join(chunks.select("chunk_id", "content"), "chunk_id").join(q.select("query_id", F.col("text").alias("query")), "query_id")
        hits = R.search(retrieve, k, "none" if reranker == "off" else reranker, s.reranking.top_n, **options)
        hits = hits.drop("content", "query")
        if reranker not in ("none", "off"):
            hits = clock.held("reranking_ms", hits)
        docs = self.store.read("documents").select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), F.col("uri").alias("document_uri"), "source_type")
        late = chunks.select("chunk_id", "document_id", "content")  # only the winners fetch their text
        return clock.held("total_ms", hits.join(late, "chunk_id").join(docs, "document_id"))

    def answer(self, queries: DataFrame, *args, request_id: str | None = None, **options) -> dict:
        """What ``search`` finds, with the request's id and milliseconds by stage."""
        with request(request_id) as name:
            timing: dict[str, float] = {}
            hits = self.search(queries, *args, timing=timing, **options)
            logger("search").info("searched", extra={"fields": {"hits": hits.count(), **timing}})
            return {"request_id": name, "timing": timing, "hits": hits}


class Clock:
    """Times stages by holding their rows, if there is a place to write the times to."""

    def __init__(self, times: dict[str, float] | None):
        self.times, self.began = times, time.perf_counter()

    def held(self, stage: str, df: DataFrame) -> DataFrame:
        if self.times is None:
            return df
        began = self.began if stage == "total_ms" else time.perf_counter()
        rows = df.toArrow()
        self.times[stage] = round(self.times.get(stage, 0.0) + 1000 * (time.perf_counter() - began), 3)
        return df.sparkSession.createDataFrame(rows.to_pylist(maps_as_pydicts="strict"), df.schema)
