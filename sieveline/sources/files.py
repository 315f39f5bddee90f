"""File connector: ``binaryFile`` scan, decoding and extraction as one DataFrame."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigurationError, ProviderUnavailableError
from ..functions.extract import EXTRACTORS, by_extension
from ..functions.ids import checksum, document_id
from ..registry import connectors

DEFAULT_EXTENSIONS = ("txt", "md", "json", "html")
EXCLUDED = ("node_modules", "__pycache__", "venv", "dist", "build")
MAX_BYTES, MAX_PDF_BYTES = 5 << 20, 100 << 20


def discover(spark: SparkSession, root: str, extensions: tuple[str, ...] = DEFAULT_EXTENSIONS, excluded: tuple[str, ...] = EXCLUDED, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(source_id, uri, size_bytes, updated_at, raw) of the files that may be read, by path. The content column is read only if used."""
    kinds = tuple(e.lower().lstrip(".") for e in extensions)
    local = root.removeprefix("file://")
    if "://" not in local and not os.path.exists(local):
        raise ConfigurationError(f"no such file or folder: {root}")
    single = os.path.isfile(local)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    base = os.path.dirname(os.path.abspath(local)) if single else os.path.abspath(local) if "://" not in local else local.rstrip("/")
    rel = F.substr(path, F.lit(len(base) + 2))
    parts = F.split(rel, "/")
    seen = files.select(rel.alias("source_id"), F.col("path").alias("uri"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("updated_at"), F.col("content").alias("raw"), parts.alias("_p"), F.lower(F.regexp_extract(rel, r"\.([^./]+)$", 1)).alias("extension"))
    hidden = F.exists(F.slice("_p", 1, F.greatest(F.size("_p") - 1, F.lit(0))), lambda x: x.startswith(".") | x.isin(*excluded))
    return seen.filter(F.col("extension").isin(*kinds) & (F.col("size_bytes") <= max_bytes) & ~hidden).drop("_p").orderBy("source_id")


def fetch(files: DataFrame, source_type: str = "filesystem") -> DataFrame:
    """Documents with ``error`` set where a file can't be read; the others are unaffected."""
    text = F.decode(F.col("raw"), "UTF-8")  # malformed bytes become replacement signs
    got = files.withColumn("_x", by_extension(text, F.col("extension")))
    name = F.regexp_extract("source_id", r"([^/]+)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    content, title = F.col("_x.text"), F.coalesce(F.nullif(F.col("_x.title"), F.lit("")), stem)
    meta = F.to_json(F.struct(F.col("source_id").alias("path"), F.col("extension").alias("file_type"), "size_bytes", F.regexp_extract("source_id", r"^(.*)/[^/]*$", 1).alias("directory"), name.alias("filename"), F.concat(F.lit("."), "extension").alias("extension"), F.length(content).alias("char_count")))
    return got.select(
        document_id(F.lit(source_type), F.col("source_id")).alias("id"),
        F.lit(source_type).alias("source_type"),
        "source_id",
        title.alias("title"),
        content.alias("content"),
        "uri",
        meta.alias("metadata"),
        F.col("extension").alias("file_type"),
        checksum(title, content).alias("checksum"),
        F.col("updated_at").alias("created_at"),
        "updated_at",
        F.col("_x.error").alias("error"),
    )


@connectors.plugin("filesystem")
def filesystem(spark: SparkSession, root: str, **options) -> DataFrame:
    unknown = set(e.lower().lstrip(".") for e in options.get("extensions", ())) - EXTRACTORS.keys()
    if unknown:
        raise ConfigurationError(f"no extractor for {', '.join(sorted(unknown))}")
    return fetch(discover(spark, root, **options))


@connectors.plugin("pdf")
def pdf(spark: SparkSession, root: str, extract=None, **options) -> DataFrame:
    """PDF files through ``extract(bytes) -> (pages, title)``; no PDF library is bundled, so one has to be passed."""
    if extract is None:
        raise ProviderUnavailableError("reading PDF needs an extractor: pass extract=function(bytes) -> (list of page texts, title)")
    @F.pandas_udf("struct<text: string, title: string, pages: array<struct<page: int, start: int>>, error: string>")
    def read(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pdf_text(bytes(b), extract) for b in raw], columns=["text", "title", "pages", "error"])

    files = discover(spark, root, extensions=("pdf",), max_bytes=MAX_PDF_BYTES, **options).withColumn("_x", read("raw"))
    stem = F.regexp_extract("source_id", r"([^/]+)\.[^.]*$", 1)
    title = F.coalesce(F.nullif(F.col("_x.title"), F.lit("")), stem)
    return files.select(document_id(F.lit("pdf"), F.col("source_id")).alias("id"), F.lit("pdf").alias("source_type"), "source_id", title.alias("title"), F.col("_x.text").alias("content"), "uri", F.col("_x.pages").alias("page_offsets"), checksum(title, F.col("_x.text")).alias("checksum"), F.col("updated_at").alias("created_at"), "updated_at", F.col("_x.error").alias("error"))


def pdf_text(raw: bytes, extract) -> tuple:
    """Pages that have text, a blank line between, and where each starts."""
    try:
        pages, title = extract(raw)
    except Exception as e:
        return None, None, None, str(e)
    parts, offsets, at = [], [], 0
    for number, page in enumerate(pages, 1):
        if page := page.strip():
            offsets.append({"page": number, "start": at})
            parts.append(page)
            at += len(page) + 2
    if not parts:
        return None, None, None, "no text in this file"
    return "\n\n".join(parts), title, offsets, None


def page_for_offset(offsets, offset):
    """The last page that starts at or before an offset; null if none."""
    before = F.filter(offsets, lambda p: p["start"] <= offset)
    return F.try_element_at(before, F.lit(-1))["page"]


@connectors.plugin("memory")
def memory(spark: SparkSession, rows, **_) -> DataFrame:
    """Documents from (source_id, title, content) tuples or a DataFrame of these columns."""
    df = rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows, "source_id string, title string, content string")
    now = F.current_timestamp()
    return df.select(document_id(F.lit("memory"), F.col("source_id")).alias("id"), F.lit("memory").alias("source_type"), "source_id", "title", "content", F.concat(F.lit("memory:"), "source_id").alias("uri"), F.lit("{}").alias("metadata"), F.lit(None).cast("string").alias("file_type"), checksum(F.col("title"), F.col("content")).alias("checksum"), now.alias("created_at"), now.alias("updated_at"), F.lit(None).cast("string").alias("error"))
