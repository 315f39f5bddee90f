"""Incremental sync: what is new or changed is chunked and embedded, the rest carried over, in one snapshot."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stem import english_terms
from ..functions.text import simple_terms
from ..operators.chunking import with_chunks
from ..operators.embedding import embed, model_key
from ..operators.retrieval import postings
from ..registry import chunkers
from ..retry import retry
from .store import Store, checked_vectors, kept_first, missing, replace_by

ANALYZERS = {"simple": simple_terms, "english": english_terms}


def outcomes(found: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """found (source_id, checksum, error) against known (source_id, checksum): adds ``outcome``."""
    k = known.select("source_id", F.col("checksum").alias("_known"))
    same = F.lit(not force) & (F.col("checksum") == F.col("_known"))
    verdict = F.when(F.col("error").isNotNull(), "failed").when(F.col("_known").isNull(), "created").when(same, "unchanged").otherwise("updated")
    return found.join(k, "source_id", "left").withColumn("outcome", verdict).drop("_known")


def counts(report: DataFrame) -> DataFrame:
    return report.groupBy("outcome").agg(F.count("*").alias("n"), F.coalesce(F.sum("chunks_written"), F.lit(0)).alias("chunks_written"))


@dataclass
class Options:
    chunker: str = "fixed"
    chunker_options: dict | None = None
    embedder: str = "hash"
    dimensions: int = 384
    force: bool = False
    prune: bool = True
    scope: str | None = None  # prune only source_ids that begin so
    model: str | None = None
    batch_size: int = 256
    encode: Callable | None = None  # for embedders that need a function
    analyzer: str = "simple"
    counter: str = "approx"


def sync(store: Store, found: DataFrame, source_type: str, options: Options | None = None, fetch: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Brings the store up to the discovered documents; returns (source_id, outcome, chunks_written, error).

    fetch: makes documents of discovered rows. Then ``found`` is what discovery
    gives, and where it has a ``checksum`` equal to that of the stored row of the
    same name, the row is unchanged without being fetched. A row with an error is
    failed, stays stored as it was, and isn't pruned. With nothing discovered
    nothing happens, so an unreachable source empties nothing.
    """
    o = options or Options()
    spark = store.spark
    old = store.read("documents")
    if found.isEmpty():
        return spark.createDataFrame([], "source_id string, outcome string, chunks_written bigint, error string")
    known = old.filter(F.col("source_type") == source_type) if old is not None else None
    skipped = None
    rows = found
    if fetch is not None:
        if known is not None and not o.force and "checksum" in found.columns and "source_checksum" in known.columns:
            seen = known.select("source_id", F.col("source_checksum").alias("checksum"))
            skipped = found.select("source_id", "checksum").join(seen, ["source_id", "checksum"], "left_semi").select("source_id")
            rows = found.join(skipped, "source_id", "left_anti")
        marks = rows.select("source_id", F.col("checksum").alias("source_checksum")) if "checksum" in rows.columns else None
        rows = fetch(rows)
        if marks is not None:
            rows = rows.join(marks, "source_id", "left")
    before = known.select("source_id", "checksum") if known is not None else spark.createDataFrame([], "source_id string, checksum string")
    judged = outcomes(rows, before, o.force)
    changed = judged.filter(F.col("outcome").isin("created", "updated"))
    fresh = changed.drop("outcome", "error")
    entry = {"documents": store.write("documents", kept_first(old, fresh) if old is not None else fresh)}
    fresh = store.staged(entry["documents"])  # read, extracted and judged once
    cut = chunkers.create(o.chunker, **({"counter": o.counter} | (o.chunker_options or {})))
    terms = ANALYZERS[o.analyzer]
    chunks = with_chunks(fresh.select("id", "content"), cut, counter=o.counter, name=o.chunker)
    kept = fresh.select(F.col("id").alias("document_id"), F.col("metadata").alias("document_metadata")) if "metadata" in fresh.columns else None
    if kept is not None:
        chunks = chunks.join(kept, "document_id")
    params = json.dumps({"counter": o.counter} | (o.chunker_options or {}), sort_keys=True)
    chunks = chunks.withColumn("chunker_params", F.lit(params)).withColumn("n_terms", F.size(terms(F.col("content"))))
    entry["chunks"] = store.write("chunks", chunks)
    chunks = store.staged(entry["chunks"])  # cut once
    vector = embed(F.col("content"), o.embedder, dimensions=o.dimensions, model=o.model, batch_size=o.batch_size, encode=o.encode)
    vectors = chunks.select("chunk_id", "document_id", F.lit(model_key(o.embedder, o.model)).alias("model_key"), vector.alias("vector"))
    entry["vectors"] = store.write("vectors", checked_vectors(vectors, o.dimensions))
    entry["postings"] = store.write("postings", postings(chunks.select("document_id", "chunk_id", F.col("content").alias("text")), terms), ("term",))
    gone = None
    if old is not None and o.prune:
        gone = missing(old, found, source_type)
        if o.scope is not None:
            gone = gone.filter(F.startswith("source_id", F.lit(o.scope)))
    # What was there before the new rows come: deleted documents, and updated ones.
    removed = None
    if old is not None:
        removed = old.select("id").join(fresh.select("id"), "id", "left_semi")
        removed = removed if gone is None else removed.unionByName(gone.select("id"))
    store.publish(entry, removed, settings={"analyzer": o.analyzer})
    made = chunks.groupBy("document_id").agg(F.count("*").alias("n"))
    written = F.coalesce("n", F.lit(0)).cast("bigint").alias("chunks_written")
    none, line = F.lit(0).cast("bigint").alias("chunks_written"), F.lit(None).cast("string").alias("error")
    report = judged.join(made, judged["id"] == made["document_id"], "left").select("source_id", "outcome", written, "error")
    if skipped is not None:
        report = report.unionByName(skipped.select("source_id", F.lit("unchanged").alias("outcome"), none, line))
    if gone is not None:
        report = report.unionByName(gone.select(F.col("id").alias("source_id"), F.lit("deleted").alias("outcome"), none, line))
    return report


__all__ = ["Options", "counts", "outcomes", "replace_by", "retry", "sync"]
