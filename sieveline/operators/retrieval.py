"""Retrievers over query sets: queries in, (query_id, chunk_id, score, rank, retriever) out.

Small sides are broadcast only after their size was checked; ranks come from a
window that Spark limits per partition before it shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..errors import ConfigurationError
from ..functions.text import simple_terms
from ..registry import fusions, rerankers, retrievers

#: rows of a query side that may be broadcast
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast if it has at most ``rows`` rows, else as it is: an ordinary shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def top_k(scored: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The k best of each query by score, then id; ranks from 1. Scores are ordered at 9 digits, given at ``digits``."""
    w = W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    ranked = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(k, 0))
    return ranked.withColumn("score", F.round("score", digits))


def postings(chunks: DataFrame, terms: Callable[[Column], Column] = simple_terms) -> DataFrame:
    """The columns of ``chunks`` but text, with (term, tf, dl): one row per chunk and term."""
    keys = [c for c in chunks.columns if c != "text"]
    rows = chunks.select(*keys, terms(F.col("text")).alias("ts"))
    rows = rows.select(*keys, F.size("ts").alias("dl"), F.explode("ts").alias("term"))
    return rows.groupBy(*keys, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


#: query terms that go into the scan as literals, where the sorted postings let it skip row groups
PUSHED_TERMS = 1_000


def bm25_index_scores(queries: DataFrame, index: DataFrame, lengths: DataFrame, k1: float = 1.2, b: float = 0.75, terms: Callable[[Column], Column] = simple_terms, tf_cap: int | None = None) -> DataFrame:
    """``bm25_scores`` from an index: postings (chunk_id, term, tf, dl) and lengths (chunk_id, n_terms), both filtered alike.

    Only the postings of query terms are read; statistics come from the lengths.
    """
    wanted = small(query_terms(queries, terms))
    asked = [r[0] for r in wanted.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    hits = index.filter(F.col("term").isin(*asked)) if len(asked) <= PUSHED_TERMS else index.join(small(wanted.select("term").distinct()), "term", "left_semi")
    stats = lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("n_terms"), F.lit(0.0)).alias("avgdl"))
    return score_postings(wanted, hits.select("chunk_id", "term", "tf", "dl"), stats, k1, b, tf_cap)


def query_terms(queries: DataFrame, terms: Callable[[Column], Column] = simple_terms) -> DataFrame:
    """(query_id, term) without repeats: a repeated query word adds nothing."""
    return queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))


def bm25_scores(queries: DataFrame, chunks: DataFrame, k1: float = 1.2, b: float = 0.75, terms: Callable[[Column], Column] = simple_terms, tf_cap: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of every chunk with a query term.

    Statistics are those of ``chunks``: pass them filtered and N, length and
    frequencies follow the filter. Chunks without terms count in N and length.
    """
    wanted = query_terms(queries, terms)
    sent = _sent(wanted)
    rows = chunks.select("chunk_id", terms(F.col("text")).alias("ts"))
    stats = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("ts")), F.lit(0.0)).alias("avgdl"))
    hits = rows.select("chunk_id", F.size("ts").alias("dl"), F.explode("ts").alias("term"))
    # Only terms that some query has leave the scan, once: by chunk, so that counts and scores need no other shuffle.
    hits = hits.join(sent(wanted.select("term").distinct()), "term", "left_semi").repartition("chunk_id")
    tf = hits.groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))
    return score_postings(sent(wanted), tf, stats, k1, b, tf_cap, sent)


def _sent(df: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """``F.broadcast`` if ``df`` is small enough, for it and all that has no more rows, else nothing."""
    return F.broadcast if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lambda x: x


def score_postings(wanted: DataFrame, tf: DataFrame, stats: DataFrame, k1: float = 1.2, b: float = 0.75, tf_cap: int | None = None, sent: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """sent: broadcasts what has no more rows than ``wanted``."""
    df = tf.groupBy("term").agg(F.count(F.when(F.col("tf") > 0, 1)).alias("df"))  # reads tf, so that both sides of the join share one shuffle
    f = F.col("tf").cast("double") if tf_cap is None else F.least(F.col("tf"), F.lit(tf_cap)).cast("double")
    norm = F.lit(1 - b) + F.lit(float(b)) * F.col("dl") / F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("avgdl"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * f * F.lit(k1 + 1) / (f + F.lit(float(k1)) * norm)
    weighed = tf.join(sent(df), "term").crossJoin(F.broadcast(stats)).select("term", "chunk_id", weight.alias("w"))
    return weighed.join(wanted, "term").groupBy("query_id", "chunk_id").agg(F.sum("w").alias("score"))


@retrievers.plugin("bm25")
def bm25(queries: DataFrame, chunks: DataFrame, k: int = 10, **options) -> DataFrame:
    return top_k(bm25_scores(queries, chunks, **options), k).withColumn("retriever", F.lit("bm25"))


#: queries whose vectors are in memory together; rows, and queries beside them, of one matrix product; hits besides k a query before they are cut
QUERY_BLOCK, ROWS, TILE, PENDING = 4096, 2048, 512, 1 << 17


def nearest(queries: DataFrame, vectors: DataFrame, k: int, others: bool = False) -> DataFrame:
    """(query_id, chunk_id, score): by cosine, the k best rows of every task for each query, by score at 9 digits, then id.

    The queries are the stated set: their number is counted and they go in blocks
    of ``QUERY_BLOCK``, each one scan of ``vectors`` in matrix products of a fixed
    size. So memory holds one product and k hits a query, however large both
    sides are, and k rows a query and task reach the shuffle, not all pairs. A zero or null vector, or one of another size than the queries', has
    no score. others: a row is no hit of the query of its own id.
    """
    q = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).filter("vector is not null")
    n = -(-q.count() // QUERY_BLOCK)
    parts = [q.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == p) if n > 1 else q for p in range(max(1, n))]
    types = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {vectors.schema['chunk_id'].dataType.simpleString()}, score double"
    rows = vectors.select("chunk_id", F.col("vector").cast("array<double>").alias("vector"))
    out = None
    for part in parts:
        block = part.orderBy("query_id").toArrow()
        found = rows.mapInArrow(_best_of(block, k, others), types)
        out = found if out is None else out.unionByName(found)
    return out


def _matrix(column: pa.Array, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of the rows with a vector of the size and without zero length."""
    lens = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    size = int(lens.max(initial=0)) if size is None else size
    at = np.flatnonzero(lens == size) if size else np.zeros(0, np.int64)
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
    m = np.nan_to_num(flat.astype(float).reshape(len(at), max(1, size))) if len(at) else np.zeros((0, max(1, size)))
    norm = np.linalg.norm(m, axis=1)
    good = norm > 0
    return at[good], m[good] / norm[good, None]


class _Best:
    """The k best hits of each query so far: by score at 9 digits, then name."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -9.0)  # least: a rounded score below which a hit of the query can't count
        self.held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.pending = self.kept = 0

    def add(self, first: int, s: np.ndarray, names: pa.Array) -> None:
        """s: scores of queries from ``first`` on; the names ascend."""
        least = self.least[first : first + len(s)]
        good = s >= least[:, None] - 1e-9
        for row in np.flatnonzero(np.count_nonzero(good, axis=1) > self.k):
            at = np.flatnonzero(good[row])
            r = np.round(s[row, at], 9)
            if len(at) > 4 * self.k:
                some = np.flatnonzero(r >= np.partition(r, -self.k)[-self.k])
                at, r = at[some], r[some]
            best = np.argsort(-r, kind="stable")[: self.k]
            good[row] = False
            good[row, at[best]] = True
            least[row] = max(least[row], r[best[-1]])
        i, j = np.nonzero(good)
        if len(i):
            self.held.append(((i + first).astype(np.int32), s[i, j], names.take(pa.array(j))))
            self.pending += len(i)
        if self.pending > self.kept + PENDING:
            self.cut()

    def cut(self) -> pa.Table | None:
        if not self.held:
            return None
        i, s, names = zip(*self.held)
        t = pa.table({"i": np.concatenate(i), "s": np.concatenate(s), "name": pa.concat_arrays(names)})
        t = t.append_column("r", pa.array(-np.round(t["s"].to_numpy(), 9)))
        t = t.take(pc.sort_indices(t, [("i", "ascending"), ("r", "ascending"), ("name", "ascending")]))
        i = t["i"].to_numpy()
        place = np.arange(len(i)) - np.searchsorted(i, i)
        last = np.flatnonzero(place == self.k - 1)
        self.least[i[last]] = -t["r"].to_numpy()[last]
        t = t.filter(pa.array(place < self.k)).combine_chunks()
        self.held = [(t["i"].to_numpy(), t["s"].to_numpy(), t["name"].combine_chunks())]
        self.pending = self.kept = t.num_rows
        return t


def _best_of(block: pa.Table, k: int, others: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = block.column("query_id").combine_chunks()
        places, q = _matrix(block.column("vector").combine_chunks())
        ids = ids.take(pa.array(places))
        best = _Best(len(ids), k)
        for b in batches if len(ids) and k > 0 else ():
            for at in range(0, b.num_rows, ROWS):
                some = b.slice(at, ROWS)
                at, v = _matrix(some.column(1), q.shape[1])
                names = some.column(0).take(pa.array(at))
                order = pc.sort_indices(names)
                names, v = names.take(order), v[order.to_numpy()]
                own = pc.index_in(names, ids) if others else None
                for first in range(0, len(q), TILE):
                    s = q[first : first + TILE] @ v.T
                    if others:
                        row = pc.fill_null(own, -1).to_numpy(zero_copy_only=False) - first
                        col = np.flatnonzero((row >= 0) & (row < len(s)))
                        s[row[col], col] = -np.inf
                    best.add(first, s, names)
        if (t := best.cut()) is not None:
            out = pa.table({"query_id": ids.take(t["i"].combine_chunks()), "chunk_id": t["name"], "score": t["s"]})
            yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    return run


@retrievers.plugin("dense")
def dense(queries: DataFrame, vectors: DataFrame, k: int = 10, model_key: str | None = None, others: bool = False) -> DataFrame:
    if model_key is not None:
        vectors = vectors.filter(F.col("model_key") == model_key)
    return top_k(nearest(queries, vectors, k, others), k).withColumn("retriever", F.lit("dense"))


def weights_of(names: list[str], weights: dict[str, float] | None) -> dict[str, float]:
    """One weight per retriever, summing to 1; unnamed ones count 1."""
    raw = {n: float((weights or {}).get(n, 1.0)) for n in names}
    total = sum(raw.values())
    if any(v < 0 for v in raw.values()) or total <= 0:
        raise ConfigurationError("fusion weights must be non-negative and not all zero")
    return {n: v / total for n, v in raw.items()}


def _by_name(weights: dict[str, float]) -> Column:
    e = F.lit(None).cast("double")
    for n, v in weights.items():
        e = F.when(F.col("retriever") == n, F.lit(v)).otherwise(e)
    return e


def _fused(lists: DataFrame, part: Column, k: int) -> DataFrame:
    entry = F.sort_array(F.collect_list(F.struct("retriever", "score", "rank")))  # one entry a retriever
    g = lists.withColumn("_p", part).groupBy("query_id", "chunk_id").agg(F.sum("_p").alias("fused"), entry.alias("_e"))
    maps = lambda f: F.map_from_entries(F.transform("_e", lambda x: F.struct(x["retriever"], x[f])))
    g = g.select("query_id", "chunk_id", F.col("fused").alias("score"), maps("score").alias("component_scores"), maps("rank").alias("component_ranks"))
    return top_k(g, k, 8).withColumn("retriever", F.lit("hybrid"))


@fusions.plugin("rrf")
def rrf(lists: DataFrame, k: int = 10, weights: dict[str, float] | None = None, names: list[str] = ("dense", "bm25"), rrf_k: int = 60) -> DataFrame:
    """Sum of weight / (rrf_k + rank)."""
    if rrf_k < 1:
        raise ConfigurationError("rrf_k must be at least 1")
    return _fused(lists, _by_name(weights_of(list(names), weights)) / (F.lit(rrf_k) + F.col("rank")), k)


@fusions.plugin("weighted")
def weighted(lists: DataFrame, k: int = 10, weights: dict[str, float] | None = None, names: list[str] = ("dense", "bm25")) -> DataFrame:
    """Sum of weight * score scaled to 0..1 within a list; a list of equal scores counts 1."""
    w = W.partitionBy("query_id", "retriever")
    low, span = F.min("score").over(w), F.max("score").over(w) - F.min("score").over(w)
    scaled = F.when(span > 0, (F.col("score") - low) / span).otherwise(1.0)
    return _fused(lists.withColumn("_s", scaled), _by_name(weights_of(list(names), weights)) * F.col("_s"), k)


def hybrid(lists: dict[str, Callable[[int], DataFrame]], k: int = 10, fusion: str = "rrf", multiplier: int = 3, **options) -> DataFrame:
    """Each component gives k * multiplier hits, fused in one plan, cut to k after fusing."""
    names = list(lists)
    if len(set(names)) != len(names) or "hybrid" in names or not names:
        raise ConfigurationError("hybrid needs distinct components other than itself")
    cols = ["query_id", "chunk_id", "score", "rank", "retriever"]
    parts = [make(k * multiplier).select(*cols) for make in lists.values()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return fusions.get(fusion)(union, k=k, names=names, **options)


@rerankers.plugin("none")
def keep_order(ranked: DataFrame, k: int, **_) -> DataFrame:
    """The control condition: the first k as they are."""
    return ranked.filter(F.col("rank") <= k)


@rerankers.plugin("cross_encoder")
def cross_encoder(ranked: DataFrame, k: int, scorer: Callable[[list[str], list[str]], list[float]] | None = None, **_) -> DataFrame:
    """Orders by a model's score of (query, content), in Arrow batches; the first stage's score is kept once."""
    from ..errors import ProviderUnavailableError

    if scorer is None:
        raise ProviderUnavailableError("no cross-encoder model is installed; pass a scorer")
    @F.pandas_udf("double")
    def score(q: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(scorer(q.tolist(), c.tolist()), dtype="float64")

    first = F.col("retrieval_score") if "retrieval_score" in ranked.columns else F.col("score")
    rows = ranked.withColumn("retrieval_score", first).withColumn("score", score("query", "content")).drop("rank")
    return top_k(rows, k)


def candidates(k: int, reranker: str, top_n: int = 50) -> int:
    """How many hits retrieval must give."""
    return k if reranker in ("none", "off") else max(k, top_n)


def search(retrieve: Callable[[int], DataFrame], k: int = 10, reranker: str = "none", top_n: int = 50, **options) -> DataFrame:
    """Retrieval and optional reranking; k <= 0 gives nothing."""
    return rerankers.get(reranker)(retrieve(max(0, candidates(k, reranker, top_n))), k=max(0, k), **options)
