"""Operator 6: SimHash near-duplicates by tiled exact comparison.

1. Arrow batches of texts become 64-bit fingerprints (XXH64 of 4-word shingles,
   majority per bit).
2. Equal fingerprints collapse into one class with a count, so copies, however
   many, are one row from here on.
3. Two fingerprints within the radius of 4 agree on at least one of 5 bit bands
   (pigeonhole), so classes meet by (band, band value). Inside, fingerprints are
   sorted by population count and cut into tiles; a tile pair whose population
   counts differ by more than the radius is skipped, the others are compared
   exactly by numpy exclusive-or and bit counts. A pair that agrees on several
   bands counts in the first alone. A band value with more than ``HOT`` classes
   is cut into blocks, and pairs of blocks become separate groups.
4. Links give each class its number of near rows and, by connected components,
   the smallest doc_id reachable.

Defined cases: null and empty texts have fingerprint zero and link to each
other; repeated rows are copies of each other; a null doc_id never names a
component (null where no member has an id); an empty table gives an empty table;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved, connected_components, doc_text, docs_table, free_names, shuffle_parts, slices

RADIUS = 4
BANDS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
TILE = 1024
HOT = 60_000
GROUP_ROWS = 1 << 18  # band values of classes that a task compares, on average
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) < 4:
        return int.from_bytes(digest(joined, 42), "big")
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    ones, n = np.zeros(64, np.int64), len(words) - 3
    for a in range(0, n, CHUNK):
        b = min(n, a + CHUNK)
        raw = b"".join([digest(joined[s : e - 1], 42) for s, e in zip(starts[a:b], ends[a + 3 : b + 3])])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    return doc_text(docs).mapInArrow(_prints, "doc_id bigint, fp bigint")


def text_key():
    """Columns that tell rows apart by doc_id and text: equal in all three, two rows are the same document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64(text).alias("_h"), F.hash(text).alias("_g")]


def _keyed_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(3)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fp.view(np.int64))], ["_id", "_h", "_g", "fp"])


def _pairs(x: np.ndarray, y: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius; y None: pairs within x. Both are sorted by population count."""
    px = np.bitwise_count(x)
    py = px if y is None else np.bitwise_count(y)
    other = x if y is None else y
    for a in range(0, len(x), TILE):
        left = x[a : a + TILE]
        lo, hi = int(px[a]), int(px[min(len(x), a + TILE) - 1])
        for b in range(a if y is None else 0, len(other), TILE):
            if int(py[b]) > hi + radius:
                break
            if int(py[min(len(other), b + TILE) - 1]) < lo - radius:
                continue
            near = np.bitwise_count(left[:, None] ^ other[None, b : b + TILE]) <= radius
            if y is None and a == b:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            if len(i):
                yield i + a, j + b


def _links(fp: np.ndarray, n: np.ndarray, blk: np.ndarray, band: int, cross: bool, radius: int):
    """(index, near rows, root index) of each fingerprint of one band value that has a link counted here."""
    order = np.lexsort((np.bitwise_count(fp), blk)) if cross else np.argsort(np.bitwise_count(fp), kind="stable")
    fp, n = fp[order], n[order]
    cut = int(np.searchsorted(blk[order], blk.max())) if cross else 0
    near, root = np.zeros(len(fp), np.int64), np.arange(len(fp))
    for i, j in _pairs(fp[:cut], fp[cut:], radius) if cross else _pairs(fp, None, radius):
        j = j + cut
        x = fp[i] ^ fp[j]
        first = np.ones(len(i), bool)
        for shift, width in BANDS[:band]:
            first &= (x >> np.uint64(shift)) & np.uint64((1 << width) - 1) != 0
        i, j = i[first], j[first]
        near += np.bincount(i, n[j], len(fp)).astype(np.int64) + np.bincount(j, n[i], len(fp)).astype(np.int64)
        while True:
            p, q = root[i], root[j]
            if (p == q).all():
                break
            m = np.minimum(p, q)
            np.minimum.at(root, p, m)
            np.minimum.at(root, q, m)
            np.minimum.at(root, i, m)
            np.minimum.at(root, j, m)
            root = root[root]
    while not (root == root[root]).all():
        root = root[root]
    has = np.flatnonzero(near)
    return fp[has], near[has], fp[root[has]]


def _tiles(radius: int):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        key = pdf[["band", "key", "a", "b"]].to_numpy(np.int64)
        n, blk = pdf["n"].to_numpy(np.int64), pdf["blk"].to_numpy(np.int64)
        order = np.lexsort(key.T[::-1])
        key = key[order]
        cuts = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
        out = []
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
            if e - s > 1:
                at = order[s:e]
                found = _links(fp[at], n[at], blk[at], int(key[s, 0]), key[s, 2] != key[s, 3], radius)
                if len(found[0]):
                    out.append(found)
        if not out:
            return pd.DataFrame({"fp": pd.Series(dtype="int64"), "near": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})
        cat = [np.concatenate(x) for x in zip(*out)]
        return pd.DataFrame({"fp": cat[0].view(np.int64), "near": cat[1], "root": cat[2].view(np.int64)})

    return compare


def linked(classes: DataFrame, radius: int = RADIUS, hot: int = HOT, n_classes: int | None = None) -> DataFrame:
    """(fp, n) classes -> (fp, near, root) partial links: near sums to the rows of other classes within the radius, (fp, root) spans the components."""
    spark = classes.sparkSession
    bands = F.array(*[F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1).cast("bigint")).cast("int").alias("key")) for k, (s, w) in enumerate(BANDS)])
    rows = classes.select("fp", "n", F.explode(bands).alias("x")).select("fp", "n", "x.band", "x.key")
    # At most 4 * 2**13 + 2**12 band values, whatever the input: a bounded broadcast.
    big = rows.groupBy("band", "key").count().filter(F.col("count") > hot).select("band", "key", F.ceil(F.col("count") / hot).cast("int").alias("nb"))
    rows = rows.join(F.broadcast(big), ["band", "key"], "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("fp", "n", "band", "key", "blk", F.least("blk", "o").alias("a"), F.greatest("blk", "o").alias("b"))
    groups = max(16, 2 * shuffle_parts(spark), -(-len(BANDS) * (n_classes or classes.count()) // GROUP_ROWS))
    return rows.groupBy(F.pmod(F.xxhash64("band", "key", "a", "b"), F.lit(groups)).alias("grp")).applyInPandas(_tiles(radius), "fp bigint, near bigint, root bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, fp, n_near (other rows linked directly), component_id (smallest doc_id reachable)."""
    prints = Saved(fingerprints(docs), "simhash").df
    known = _components(prints, F.min("doc_id").alias("low"), radius)
    lowest = known.groupBy("comp").agg(F.min("low").alias("component_id"))
    known = known.join(lowest, "comp").select("fp", (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("n_near"), "component_id")
    return prints.join(known, "fp").select("doc_id", "fp", "n_near", "component_id")


def _components(prints: DataFrame, low, radius: int) -> DataFrame:
    """(fp, n, low, near, comp): each fingerprint's rows, their aggregate ``low``, near rows of others and component."""
    classes = prints.groupBy("fp").agg(F.count("*").alias("n"), low)
    links = Saved(linked(classes.select("fp", "n"), radius), "links").df
    near = links.groupBy("fp").agg(F.sum("near").alias("near"))
    comp = connected_components(links.select(F.col("fp").alias("a"), F.col("root").alias("b")))
    return classes.join(near, "fp", "left").join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))


def one_each(docs: DataFrame, radius: int = RADIUS, broadcast_rows: int = 500_000) -> DataFrame:
    """The rows, all columns kept, of one document of each component: the smallest doc_id, null being the largest, then the lowest hash of its text.

    Rows are judged by ``text_key``, so texts are hashed but never shuffled where
    the keys of the rows that go, and of kept rows that are there repeatedly, are
    few enough to broadcast (counted first); beyond that it is a shuffled join.
    Of repeated rows of a kept document one stays.
    """
    key = ["_id", "_h", "_g"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    prints = Saved(docs.select(*text_key(), text.alias("text")).mapInArrow(_keyed_prints, "_id bigint, _h bigint, _g int, fp bigint"), "simhash").df
    rank = F.struct(F.col("_id").isNull().alias("last"), *key)
    known = _components(prints, F.min(rank).alias("low"), radius)
    first = known.groupBy("comp").agg(F.min("low").alias("first"), F.sum("n").alias("rows"))
    # Only rows of components of several rows are looked at again.
    many = known.join(first.filter("rows > 1"), "comp").select("fp", "first")
    judged = keys = Saved(prints.join(many, "fp").groupBy(*key, "first").agg(F.count("*").alias("times")).withColumn("stays", rank == F.col("first")).filter("not stays or times > 1").select(*key, "stays"), "simhash-keys").df
    if judged.limit(broadcast_rows + 1).count() <= broadcast_rows:
        judged = F.broadcast(judged)
    names = free_names(docs, *key, "_stays")
    rows = docs.select("*", *[c.alias(n) for c, n in zip(text_key(), names)])
    match = F.lit(True)
    for n, k in zip(names, key):
        match = match & rows[n].eqNullSafe(judged[k])
    met = rows.join(judged, match, "left").select(*[rows[f"`{c}`"] for c in rows.columns], judged["stays"].alias(names[3]))
    alone = met.filter(F.col(names[3]).isNull()).select(*[f"`{c}`" for c in docs.columns])
    if keys.filter("stays").isEmpty():
        return alone
    again = met.filter(F.col(names[3])).dropDuplicates(names[:3]).select(*[f"`{c}`" for c in docs.columns])
    return alone.unionByName(again)


def query(spark, sf_dir):
    found = near_duplicates(docs_table(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("n_near").cast("bigint").alias("n_near"), F.col("component_id").cast("bigint").alias("component_id"))
