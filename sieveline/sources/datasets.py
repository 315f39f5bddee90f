"""Query sets: JSON lines with a sidecar, checked strictly, as queries and judgements."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..errors import DatasetError, LabelError


@dataclass
class QuerySet:
    queries: list[dict]
    granularity: str
    meta: dict
    checksum: str
    graded: bool = field(default=False)

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(query_id, text) and (query_id, key, grade)."""
        q = spark.createDataFrame([(x["query_id"], x["query"]) for x in self.queries], "query_id string, text string")
        j = spark.createDataFrame([(x["query_id"], k, g) for x in self.queries for k, g in x["relevant"].items()], "query_id string, key string, grade int")
        return q, j


def relevance(raw, where: str) -> dict[str, int]:
    """A list means grade 1; an object gives whole, non-negative grades. At least one must be positive."""
    if isinstance(raw, list) and all(isinstance(x, str) for x in raw):
        out = dict.fromkeys(raw, 1)
    elif isinstance(raw, dict):
        if any(type(g) is not int or g < 0 for g in raw.values()):
            raise DatasetError(f"{where}: grades are whole numbers from 0")
        out = dict(raw)
    else:
        raise DatasetError(f"{where}: relevant items are a list of strings or an object of grades")
    if not any(out.values()):
        raise DatasetError(f"{where}: no relevant item")
    return out


def load_query_set(path: str) -> QuerySet:
    p = Path(path)
    sidecar = p.with_name(p.stem + ".meta.json")
    if not sidecar.is_file():
        raise DatasetError(f"{sidecar} is missing")
    meta = json.loads(sidecar.read_text("utf-8"))
    if meta.get("kind") not in ("synthetic", "curated"):
        raise DatasetError(f"{sidecar}: kind must be synthetic or curated")
    raw = p.read_bytes()
    out, kinds, seen = [], set(), set()
    for number, line in enumerate(raw.decode("utf-8").splitlines(), 1):
        line, where = line.strip(), f"line {number}"
        if not line or line.startswith("//"):
            continue
        try:
            x = json.loads(line)
        except ValueError as e:
            raise DatasetError(f"{where}: not JSON: {e}") from e
        text = x.get("query") if isinstance(x, dict) else None
        if not isinstance(text, str) or not text.strip():
            raise DatasetError(f"{where}: a query text is needed")
        given = [k for k in ("relevant_documents", "relevant_chunks") if k in x]
        if len(given) != 1:
            raise DatasetError(f"{where}: give one of relevant_documents and relevant_chunks")
        if text in seen:
            raise DatasetError(f"{where}: query {text!r} is there twice")
        seen.add(text)
        kinds.add(given[0].removeprefix("relevant_").removesuffix("s"))
        out.append({"query_id": x.get("query_id") or f"q{len(out) + 1}", "query": text, "relevant": relevance(x[given[0]], where)})
    if not out:
        raise DatasetError(f"{p}: no queries")
    if len(kinds) > 1:
        raise DatasetError(f"{p}: documents and chunks are mixed")
    graded = any(g > 1 for q in out for g in q["relevant"].values())
    return QuerySet(out, kinds.pop(), meta, hashlib.sha256(raw).hexdigest(), graded)


def resolve_labels(labels: list[str], known: list[tuple[str, str]]) -> dict[str, str]:
    """Label -> document id: by whole source_id, else by a base name that only one document has.

    known: (document id, source_id). Unknown or ambiguous labels, and two labels
    of one document, are refused: neither could be scored.
    """
    whole = {s: d for d, s in known}
    base: dict[str, list[str]] = {}
    for d, s in known:
        base.setdefault(s.rsplit("/", 1)[-1], []).append(d)
    out = {}
    for label in dict.fromkeys(labels):
        found = [whole[label]] if label in whole else base.get(label.rsplit("/", 1)[-1], [])
        if len(found) != 1:
            raise LabelError(f"label {label!r} is {'ambiguous' if found else 'unknown'}")
        if found[0] in out.values():
            raise LabelError(f"label {label!r} and another name the same document")
        out[label] = found[0]
    return out


def resolved(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """ranked (query_id, document_id, rank) with ``key``: the document's label, or its id where it has none."""
    from pyspark.sql import functions as F

    return ranked.join(labels.select("document_id", "label"), "document_id", "left").withColumn("key", F.coalesce("label", "document_id")).drop("label")
