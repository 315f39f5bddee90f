"""Deterministic identifiers and checksums as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE_HEX = "6f6b8d241f2b5a5e9f2f1b0e1f6a9c31"


def uuid5(name: Column, namespace_hex: str = NAMESPACE_HEX) -> Column:
    """RFC 4122 version 5 UUID of a name, as text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128).cast("bigint")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def document_id(source_type: Column, source_id: Column) -> Column:
    return uuid5(F.concat_ws(":", F.lit("document"), source_type, source_id))


def chunk_id(document: Column, position: Column, content_checksum: Column) -> Column:
    return uuid5(F.concat_ws(":", F.lit("chunk"), document, position.cast("string"), content_checksum))


def checksum(*parts: Column) -> Column:
    """SHA-256 over the parts, each after its length in bytes and a zero byte, so that borders count."""
    pieces = []
    for p in parts:
        raw = F.encode(p.cast("string"), "UTF-8")
        pieces += [F.encode(F.octet_length(raw).cast("string"), "UTF-8"), F.unhex(F.lit("00")), raw]
    return F.sha2(F.concat(*pieces), 256)
