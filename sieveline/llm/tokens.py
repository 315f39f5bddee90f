"""Operator 1: token counts, rollups maintained from signed deltas.

A change is an insert, a delete or a revised count of one document under one
tokenizer version. It becomes a signed delta of three additive totals
(documents, tokens, characters) by source, language and tokenizer version.
Deltas of a batch are summed (map-side first, so a source with a third of all
rows reaches the shuffle as one row a task) and committed under the batch's
name by creating one file, which only one writer can: a retried, repeated or
concurrent commit of a batch changes nothing. Compaction folds batches into one
table without forgetting their names.

Counts are those of a byte-pair vocabulary whose merges never cross pre-token
borders, so the count of a text is the sum over its pre-tokens, each encoded
once per worker and remembered.

Defined cases: a null or empty text has 0 tokens and still counts as a document;
null source or language are groups of their own; repeated rows count each; an
empty table gives an empty rollup; further columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Saved, docs_table, shared_dir, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PRE_TOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
CACHE = 1 << 20
KEY = ["source", "lang", "tokenizer_version"]
TOTALS = ["n_docs", "n_tokens", "n_chars"]


class Counter(dict):
    """pre-token -> number of tokens, filled as they come; emptied when full, which costs time only."""

    def __init__(self, vocabulary: str):
        import regex
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.find = regex.compile(PRE_TOKEN).findall

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self[piece] = len(self.encode(piece))
        return n

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, self.find(text))) if text else 0


_COUNTERS: dict[str, Counter] = {}


def counter(vocabulary: str) -> Counter:
    if vocabulary not in _COUNTERS:
        _COUNTERS[vocabulary] = Counter(vocabulary)
    return _COUNTERS[vocabulary]


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, version: str | None = None) -> DataFrame:
    """(doc_id, source, lang, tokenizer_version, n_tokens, n_chars), one row per input row."""
    version = version or re.sub(r"\W+", "_", vocabulary.rsplit("/", 1)[-1].rsplit(".", 1)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for b in slices(batches):
            n = pa.array([count(t.as_py()) for t in b.column(3)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), n, b.column(4)], ["doc_id", "source", "lang", "n_tokens", "n_chars"])

    flat = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"))
    out = flat.mapInArrow(run, "doc_id bigint, source string, lang string, n_tokens bigint, n_chars bigint")
    return out.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"), "n_tokens", "n_chars")


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums by key.

    changes: op (insert, delete or revise), the key columns, n_tokens and n_chars,
    and for a revision old_tokens and old_chars (null counts as 0). An unknown op
    is an error, not a silent zero.
    """
    has = set(changes.columns)
    old = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in has else F.lit(0)
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))).cast("int"))
    new = lambda c: F.coalesce(F.col(c), F.lit(0))
    signed = lambda c, o: F.when(F.col("op") == "revise", new(c) - old(o)).otherwise(sign * new(c))
    rows = changes.select(*KEY, sign.cast("bigint").alias("n_docs"), signed("n_tokens", "old_tokens").cast("bigint").alias("n_tokens"), signed("n_chars", "old_chars").cast("bigint").alias("n_chars"))
    return rows.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in TOTALS])


class Rollup:
    """Totals in a folder that all executors share.

    ``data/`` holds tables under names that are never used twice. A batch exists
    from when the file ``commits/<batch>``, which names its table, could be
    created: creation fails where the file is there, so of two writers of one
    batch one wins, and a table without a commit is never read. ``compact`` writes
    the totals so far as one table and a numbered file in ``bases/`` that names it and
    the batches in it; the highest base counts, with the commits that it doesn't name.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._at(folder)):
            return []
        return sorted(n for s in self._fs.listStatus(self._at(folder)) if not (n := s.getPath().getName()).startswith((".", "_")))

    def _create(self, name: str, text: str) -> bool:
        """Writes a small file; False if another one of the name was there first."""
        try:
            out = self._fs.create(self._at(name), False)
        except Py4JJavaError:
            if self._fs.exists(self._at(name)):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _base(self) -> tuple[int, str | None, set[str]]:
        """(number, table, batches) of the highest base; number 0 without one."""
        found = self._names("bases")
        if not found:
            return 0, None, set()
        x = json.loads(self._read(f"bases/{found[-1]}"))
        return int(found[-1]), x["table"], set(x["batches"])

    def _put(self, df: DataFrame) -> str:
        table = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/data/{table}")
        return table

    def _drop(self, table: str) -> None:
        self._fs.delete(self._at(f"data/{table}"), True)

    def batches(self) -> set[str]:
        """Names of all batches applied so far."""
        return set(self._names("commits"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies the batch once; False if it was there already, or another writer was faster."""
        if not re.fullmatch(r"[A-Za-z0-9-]+", batch):
            raise ValueError(f"batch name {batch!r}")
        if self._fs.exists(self._at(f"commits/{batch}")):
            return False
        table = self._put(deltas(changes))
        if self._create(f"commits/{batch}", table):
            return True
        self._drop(table)
        return False

    def _sums(self) -> tuple[DataFrame, list[str], list[str]]:
        """Sums over everything committed, the tables read and the batches in them."""
        _, base, inside = self._base()
        fresh = [b for b in self._names("commits") if b not in inside]
        tables = [*([base] if base else []), *(self._read(f"commits/{b}") for b in fresh)]
        schema = "source string, lang string, tokenizer_version string, n_docs bigint, n_tokens bigint, n_chars bigint"
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{t}" for t in tables]) if tables else self.spark.createDataFrame([], schema)
        return rows.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in TOTALS]), tables, [*inside, *fresh]

    def totals(self) -> DataFrame:
        """Sums over all batches; keys that are back to nothing are left out.

        Deletes of what was never inserted show as totals below zero until the insert comes: batches may arrive in any order.
        """
        return self._sums()[0].filter(" OR ".join(f"{c} <> 0" for c in TOTALS))

    def compact(self) -> bool:
        """Makes one table of all batches and drops those that the base before it had replaced; False if another compaction was faster.

        Tables of the batches compacted now stay until the next compaction, for readers that began before.
        """
        number, old, inside = self._base()
        sums, _, batches = self._sums()
        table = self._put(sums.coalesce(1))
        if not self._create(f"bases/{number + 1:08d}", json.dumps({"table": table, "batches": sorted(batches)})):
            self._drop(table)
            return False
        for b in inside:
            self._drop(self._read(f"commits/{b}"))
        for old in self._names("bases")[-3:-2]:
            self._drop(json.loads(self._read(f"bases/{old}"))["table"])
        return True


def query(spark, sf_dir):
    """All documents inserted, with characters as a first count, revised to their tokens, deleted and inserted again.

    Each batch holds every document and is committed twice: the second commit changes nothing. Half-way the store is compacted.
    """
    counts = Saved(count_tokens(docs_table(spark, sf_dir)), "token-counts").df
    store = Rollup(spark, f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}")
    first = counts.withColumn("n_tokens", F.col("n_chars")).withColumn("op", F.lit("insert"))
    revised = counts.withColumns({"old_tokens": F.col("n_chars"), "old_chars": F.col("n_chars"), "op": F.lit("revise")})
    for batch, changes in (("load", first), ("recount", revised), ("remove", counts.withColumn("op", F.lit("delete"))), ("return", counts.withColumn("op", F.lit("insert")))):
        store.commit(batch, changes)
        store.commit(batch, changes)
        if batch == "recount":
            store.compact()
    return store.totals()
