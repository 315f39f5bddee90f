"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigurationError


def docs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a session of one machine may name none: it gets a temporary one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ConfigurationError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="sieveline-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a worker holds copies of few texts at a time."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's bytes, for sizes of tasks; 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Each name as it is, or with underscores added until the table has no column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
        taken.add(n.lower())
    return out


class Saved:
    """A table written to the shared folder, so that lineage ends there; ``drop()`` when superseded."""

    def __init__(self, df: DataFrame, tag: str):
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        sc = self.df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def doc_text(docs: DataFrame) -> DataFrame:
    """(doc_id bigint, text string): null texts become empty; other columns are ignored."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) bigint undirected edges -> (node, comp), comp the smallest node of its component.

    Alternating large-star and small-star rounds. Each is a map-side combined
    minimum and an equi-join, so a node that has a third of all edges is never
    gathered into one list. Every round is a table in the shared folder.
    """
    tidy = lambda d: d.filter("a <> b").distinct()
    mark = lambda s: s.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = Saved(tidy(edges.select("a", "b")), "cc")
    seen = mark(now)
    while seen[0]:
        e = now.df
        sym = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = tidy(sym.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low2 = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low2.select("a", F.col("m").alias("b")))
        nxt = Saved(tidy(small), "cc")
        state = mark(nxt)
        now.drop()
        now = nxt
        if state == seen:
            break
        seen = state
    star = now.df.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp"))
    roots = now.df.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return star.union(roots.join(star.select("node"), "node", "left_anti"))
