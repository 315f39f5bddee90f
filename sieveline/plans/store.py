"""Snapshot store: bucketed Parquet tables, published by numbered manifests, and the operations on them."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import DimensionMismatchError, StorageError

KEPT = ("created_at", "source_type", "source_id")


def kept_first(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows with when and from where the old ones of the same id first came."""
    keep = [c for c in KEPT if c in old.columns and c in new.columns]
    first = old.select("id", *[F.col(c).alias(f"_old_{c}") for c in keep])
    fresh = new.join(first, "id", "left")
    for c in keep:
        fresh = fresh.withColumn(c, F.coalesce(f"_old_{c}", c))
    return fresh.select(*new.columns)


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones of the same id, which pass on when and from where they first came."""
    return old.join(new.select("id"), "id", "left_anti").unionByName(kept_first(old, new), allowMissingColumns=True)


def replace_by(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All old rows with a key that ``new`` has go, then its rows come."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    return replace_by(old, new, ["document_id"])


def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    return replace_by(old, new, ["chunk_id", "model_key"])


def checked_vectors(vectors: DataFrame, dimensions: int) -> DataFrame:
    """Fails the job on a vector of another size."""
    bad = F.concat(F.lit("vector of "), F.size("vector").cast("string"), F.lit(f" dimensions, the model has {dimensions}"))
    return vectors.withColumn("vector", F.when(F.size("vector") == dimensions, F.col("vector")).otherwise(F.raise_error(bad).cast("array<double>")))


def attach(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_id for each vector; those of chunks that are gone drop out."""
    return vectors.join(chunks.select("chunk_id", "document_id"), "chunk_id")


def delete_documents(ids: DataFrame, documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    gone = ids.select("id").distinct()
    of = gone.withColumnRenamed("id", "document_id")
    return documents.join(gone, "id", "left_anti"), chunks.join(of, "document_id", "left_anti"), vectors.join(of, "document_id", "left_anti")


def missing(documents: DataFrame, present: DataFrame, source_type: str) -> DataFrame:
    """Stored documents of one source type that discovery no longer finds."""
    return documents.filter(F.col("source_type") == source_type).join(present.select("source_id").distinct(), "source_id", "left_anti")


def listing(documents: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return documents.orderBy(F.col("updated_at").desc(), "id").offset(offset).limit(limit)


def lookup(ids: list[str], chunks: DataFrame) -> DataFrame:
    """Chunks in the order of the ids."""
    spark = chunks.sparkSession
    wanted = spark.createDataFrame(list(enumerate(ids)), "pos int, chunk_id string")
    return chunks.join(F.broadcast(wanted), "chunk_id").orderBy("pos").drop("pos")


class Store:
    """Tables in buckets by the document's hash, in folders that never change.

    A snapshot is a numbered manifest that names the folders of each bucket. New
    documents are appended as a further folder of their buckets; only buckets with
    changed or deleted documents, or with more than ``MAX_FOLDERS`` folders, are
    written anew. Creating the manifest of the next number publishes a run: it
    fails where the number exists, so of two writers one wins; readers keep the
    snapshot they opened, and a run that fails leaves nothing visible.
    """

    TABLES = {"documents": "id", "chunks": "document_id", "vectors": "document_id", "postings": "document_id"}
    MAX_FOLDERS = 16

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path = spark, (path if "://" in path else os.path.abspath(path)).rstrip("/")
        jvm = self._jvm = spark.sparkContext._jvm
        self._file = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._file("data").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.buckets = self.manifest()[1].get("buckets", buckets)

    def _names(self, folder: str) -> list[str]:
        at = self._file(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def manifest(self) -> tuple[int, dict]:
        """(number, content) of the newest snapshot; 0 and nothing before the first."""
        names = [n for n in self._names("snapshots") if n.isdigit()]
        if not names:
            return 0, {}
        stream = self._fs.open(self._file(f"snapshots/{names[-1]}"))
        try:
            return int(names[-1]), json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> str | None:
        number, _ = self.manifest()
        return f"{number:08d}" if number else None

    def _open(self, entry: dict, buckets: Iterable[int] | None) -> DataFrame:
        schema = StructType.fromJson(entry["schema"])
        wanted = None if buckets is None else {str(b) for b in buckets}
        paths = [f"{self.path}/{p}" for b, ps in sorted(entry["folders"].items()) if wanted is None or b in wanted for p in ps]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, table: str, buckets: Iterable[int] | None = None) -> DataFrame | None:
        """A table of the newest snapshot, whole or some buckets of it; None before it was ever written."""
        entry = self.manifest()[1].get("tables", {}).get(table)
        return None if entry is None else self._open(entry, buckets)

    def setting(self, name: str) -> str | None:
        return self.manifest()[1].get("settings", {}).get(name)

    def buckets_of(self, ids: DataFrame) -> list[int]:
        """The buckets of a table of document ids: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in ids.select(self._bucket(ids.columns[0])).distinct().collect())

    def _bucket(self, key: str):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int").alias("bucket")

    def write(self, table: str, df: DataFrame, sort: tuple[str, ...] = ()) -> dict:
        """Writes rows where no snapshot sees them yet; the entry says where they are."""
        if table not in self.TABLES:
            raise StorageError(f"no table {table}")
        folder = f"data/{table}-{uuid.uuid4().hex}"
        rows = df.withColumn("bucket", self._bucket(self.TABLES[table])).hint("rebalance", "bucket")
        rows.sortWithinPartitions("bucket", *sort).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        found = [n for n in self._names(folder) if n.startswith("bucket=")]
        return {"schema": df.schema.jsonValue(), "folders": {n.removeprefix("bucket="): [f"{folder}/{n}"] for n in found}}

    def staged(self, entry: dict) -> DataFrame:
        """The rows of an entry that no snapshot sees yet."""
        return self._open(entry, None)

    def publish(self, added: dict[str, dict], removed: DataFrame | None = None, tables: Iterable[str] | None = None, settings: dict | None = None, fresh: bool = False) -> str:
        """The next snapshot: rows of the documents in ``removed`` (column id) leave ``tables`` (default: all), then the entries come. fresh: the named tables alone, from nothing."""
        number, m = self.manifest()
        now = {} if fresh else dict(m.get("tables", {}))
        gone = removed.select("id").distinct() if removed is not None else None
        touched = self.buckets_of(gone) if gone is not None else []
        for name in tables or self.TABLES:
            if name not in now:
                continue
            entry, key = now[name], self.TABLES[name]
            crowded = [int(b) for b, ps in entry["folders"].items() if len(ps) >= self.MAX_FOLDERS]
            anew = sorted({b for b in touched if str(b) in entry["folders"]} | set(crowded))
            if anew:
                rest = self._open(entry, anew)
                if gone is not None:
                    rest = rest.join(gone.withColumnRenamed("id", key), key, "left_anti").select(*rest.columns)
                made = self.write(name, rest, ("term",) if name == "postings" else ())
                folders = {b: ps for b, ps in entry["folders"].items() if int(b) not in anew} | made["folders"]
                now[name] = entry | {"folders": folders}
        for name, entry in added.items():
            old = now.get(name, {"schema": entry["schema"], "folders": {}})
            have = {f["name"] for f in old["schema"]["fields"]}
            schema = old["schema"] | {"fields": old["schema"]["fields"] + [f | {"nullable": True} for f in entry["schema"]["fields"] if f["name"] not in have]}
            now[name] = {"schema": schema, "folders": old["folders"] | {b: old["folders"].get(b, []) + ps for b, ps in entry["folders"].items()}}
        content = {"buckets": self.buckets, "tables": now, "settings": m.get("settings", {}) | (settings or {})}
        name = f"{number + 1:08d}"
        try:
            out = self._fs.create(self._file(f"snapshots/{name}"), False)
        except Py4JJavaError as e:
            raise StorageError(f"snapshot {name} was published by another writer") from e
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        return name

    def replace(self, **tables: DataFrame) -> str:
        """A snapshot of these tables alone."""
        return self.publish({name: self.write(name, df) for name, df in tables.items()}, fresh=True)

    def delete_vectors(self, ids: DataFrame) -> int:
        """Removes all vectors of the documents (column id); how many there were."""
        v = self.read("vectors")
        if v is None:
            return 0
        n = v.join(ids.select(F.col("id").alias("document_id")), "document_id", "left_semi").count()
        self.publish({}, ids, ("vectors",))
        return n

    def health(self) -> dict[str, int | str]:
        """Rows by table, and the version of what reads them."""
        return {t: (df.count() if (df := self.read(t)) is not None else 0) for t in ("documents", "chunks", "vectors")} | {"version": self.spark.version}

    def models(self) -> DataFrame | None:
        v = self.read("vectors")
        return None if v is None else models_of(v)


def models_of(vectors: DataFrame) -> DataFrame:
    return vectors.select("model_key", F.size("vector").cast("bigint").alias("dimensions")).distinct()


def expect_dimensions(got: int, expected: int) -> None:
    if got != expected:
        raise DimensionMismatchError(expected, got)
