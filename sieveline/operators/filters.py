"""Search filters compiled to one predicate over document columns."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SearchFilters:
    """OR within a field, AND across fields; an empty field does not filter."""

    source_types: tuple[str, ...] = ()
    source_ids: tuple[str, ...] = ()
    document_ids: tuple[str, ...] = ()
    created_after: Any = None
    created_before: Any = None
    file_types: tuple[str, ...] = ()
    authors: tuple[str, ...] = ()
    repositories: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    metadata: dict[str, Any] = field(default_factory=dict)

    @property
    def is_empty(self) -> bool:
        return not any(getattr(self, f) not in (None, (), {}, []) for f in self.__dataclass_fields__)


#: filter field -> column of the documents table
COLUMNS = {"source_types": "source_type", "source_ids": "source_id", "document_ids": "id", "file_types": "file_type", "authors": "author", "repositories": "repository"}


def predicate(f: SearchFilters, columns: dict[str, str] | None = None, created: str = "created_at", tags: str = "tags", metadata: str = "metadata", present: Iterable[str] | None = None) -> Column:
    """Never null: what is missing doesn't match. present: the table's columns; a field without one is read from the metadata."""
    names = COLUMNS | (columns or {})

    def field_of(name: str, kind: str) -> Column:
        if present is None or name in present:
            return F.col(name)
        return F.try_variant_get(F.try_parse_json(F.col(metadata).cast("string")), f"$.{name}", kind)

    terms = [field_of(c, "string").isin(*getattr(f, k)) for k, c in names.items() if getattr(f, k)]
    if f.created_after is not None:
        terms.append(F.col(created) >= F.lit(f.created_after))
    if f.created_before is not None:
        terms.append(F.col(created) <= F.lit(f.created_before))
    if f.tags:
        terms.append(F.arrays_overlap(field_of(tags, "array<string>"), F.array(*[F.lit(t) for t in f.tags])))
    if f.metadata:
        terms.append(contains(F.try_parse_json(F.col(metadata).cast("string")), f.metadata))
    return reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for t in terms], F.lit(True))


def contains(doc: Column, wanted: Any) -> Column:
    """JSON containment: objects by key, lists in any order, scalars by type and value."""
    if isinstance(wanted, dict):
        shape = F.startswith(F.schema_of_variant(doc), F.lit("OBJECT"))
        return reduce(lambda a, b: a & b, [contains(_member(doc, k), v) for k, v in wanted.items()], F.coalesce(shape, F.lit(False)))
    if isinstance(wanted, list):
        items = F.try_variant_get(doc, "$", "array<variant>")
        each = [F.coalesce(F.exists(items, _holds(v)), F.lit(False)) for v in wanted]
        return reduce(lambda a, b: a & b, each, items.isNotNull())
    text = F.to_json(doc)
    if isinstance(wanted, (int, float)) and not isinstance(wanted, bool):
        kind = F.regexp_like(F.schema_of_variant(doc), F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|TINYINT|SMALLINT)"))
        return F.coalesce(kind & (F.try_variant_get(doc, "$", "double") == F.lit(float(wanted))), F.lit(False))
    if isinstance(wanted, str):
        same = (F.schema_of_variant(doc) == "STRING") & (F.try_variant_get(doc, "$", "string") == F.lit(wanted))
        return F.coalesce(same, F.lit(False))
    return F.coalesce(text == F.lit(json.dumps(wanted)), F.lit(False))


def _holds(wanted: Any):
    return lambda x: contains(x, wanted)


def _member(doc: Column, key: str) -> Column:
    quoted = key.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(doc, f"$['{quoted}']", "variant")
