"""Operator 10: toxicity by nearest labelled examples under exact TF-IDF cosine.

1. A bounded sample of labelled rows (``MAX_EXAMPLES``, lowest hash first) gives
   the examples and, with all words that occur in them, the terms. Executors
   count the words; the driver sees counts, not texts.
2. One pass over all documents gives document frequencies, so the inverse
   frequencies cover the whole corpus. A term that speaks for toxicity beyond chance
   weighs ``1 + sqrt(chi square)`` times its inverse frequency, any other term
   its inverse frequency alone: with plain weights the topic drowns the signal.
3. Examples become unit vectors; equal ones collapse into a class with its
   labels. The classes are a block-max inverted index: postings in blocks of
   ``BLOCK`` classes with each term's largest weight in the block, terms of many
   classes as dense lists. A batch of texts goes first to each text's most
   promising block, then to every other block whose bound reaches the worst of the
   ``K`` nearest so far, so neighbours and cosines are exact.
4. Distance-weighted votes of the ``K`` nearest examples, and of the share of
   toxic examples as one more voter at distance 1, calibrated by a logistic
   fit to leave-one-out votes of the examples, are the score; the nearest
   example is the evidence.

Only rows whose crc32(doc_id as text) mod 5 is not 0 are learnt from. The score
depends on the text alone.

Defined cases: null and empty texts, and texts without any term, get the
calibrated score of the examples' share of toxic ones, and no evidence; a null
doc_id is never learnt from and not held out; a document with several labels
counts as toxic if one says so; null labels are ignored; with no labels of
either kind all scores are the share of toxic labels (0 without any); repeated
rows get one row each; equal cosines (at 9 digits) go by doc_id of the
example; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text, docs_table, slices

MAX_EXAMPLES = 6000
#: neighbours; least distance; weight of the share of toxic examples among their votes
K, EPS, PRIOR = 15, 0.02, 1.0
#: chi square that chance explains; what a term gains from the root of the rest
CHANCE, GAIN = 10.0, 2.0
#: classes in a block; share of the classes from which a term's list is dense; texts scored together
BLOCK, DENSE, BATCH = 256, 0.07, 512
DIGITS = 1e9
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Terms:
    """Term numbers and counts of texts."""

    def __init__(self, vocabulary: dict[str, int]):
        self.get = vocabulary.get

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(terms in order, how often each occurs)."""
        found = Counter(map(self.get, words(text)))
        found.pop(None, None)
        ids = np.fromiter(found, np.int64, len(found))
        order = np.argsort(ids)
        return ids[order], np.fromiter(found.values(), np.int64, len(found))[order]

    def present(self, text: str | None) -> list[int]:
        found = set(map(self.get, set(words(text))))
        found.discard(None)
        return list(found)


def signal(examples: list[np.ndarray], toxic: np.ndarray, size: int) -> np.ndarray:
    """1 + ``GAIN`` times the root of what chi square exceeds ``CHANCE`` by, for terms that are commoner in toxic examples; else 1."""
    with_, n = np.zeros((2, size)), np.array([(toxic == 0).sum(), toxic.sum()], float)
    for ids, y in zip(examples, toxic):
        with_[int(y), ids] += 1
    b, a = with_
    d, c = n[0] - b, n[1] - a
    low = (a + b) * (c + d) * n[0] * n[1]
    chi2 = np.divide(n.sum() * (a * d - b * c) ** 2, low, out=np.zeros(size), where=low > 0)
    return 1 + GAIN * np.sqrt(np.maximum(chi2 - CHANCE, 0)) * (a * n[0] > b * n[1])


def unit(tf: np.ndarray, weight: np.ndarray) -> np.ndarray:
    v = (1 + np.log(tf)) * weight
    norm = np.linalg.norm(v)
    return v / norm if norm else v


def _spread(lens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lens[i] - 1, one run after the other."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lens - starts, lens)


class BlockMax:
    """Unit vectors (terms, weights) as a block-max inverted index; exact nearest by cosine at 9 digits, then by rank."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], size: int, rank: np.ndarray):
        self.n = n = len(vectors)
        self.rank, self.place = rank, np.argsort(rank)
        self.bits = max(1, n.bit_length())
        lens = np.array([len(v[0]) for v in vectors], np.int64)
        term = np.concatenate([v[0] for v in vectors]) if n else np.zeros(0, np.int64)
        weight = np.concatenate([v[1] for v in vectors]).astype(np.float32) if n else np.zeros(0, np.float32)
        owner = np.repeat(np.arange(n), lens)
        often = np.bincount(term, minlength=size) > max(8, DENSE * n)
        self.dense = np.cumsum(often) - 1
        self.dense[~often] = -1
        self.lists = np.zeros((int(often.sum()), n), np.float32)
        d = often[term]
        self.lists[self.dense[term[d]], owner[d]] = weight[d]
        term, weight, owner = term[~d], weight[~d], owner[~d]
        blocks = max(1, -(-n // BLOCK))
        order = np.lexsort((owner, term, owner // BLOCK))
        self.owner, self.weight, block = (owner[order] % BLOCK).astype(np.int32), weight[order], owner[order] // BLOCK
        # Runs of one term in one block; a term's slot in a block leads to its run, slot 0 being empty.
        key = block * size + term[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.start = np.concatenate([[0], first])
        self.len = np.concatenate([[0], np.diff(np.concatenate([first, [len(key)]]))])
        self.slot = np.zeros((blocks, size), np.int32)
        self.slot[block[first], term[order][first]] = np.arange(1, len(first) + 1)
        self.top = np.concatenate([[0], np.maximum.reduceat(self.weight, first)]) if len(first) else np.zeros(1)
        self.dense_top = np.array([self.lists[:, b * BLOCK : (b + 1) * BLOCK].max(axis=1, initial=0) for b in range(blocks)], np.float64)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k nearest of each query, falling; -1 where there are fewer."""
        m, blocks = len(queries), len(self.slot)
        lens = np.array([len(q[0]) for q in queries], np.int64)
        row = np.repeat(np.arange(m), lens)
        term = np.concatenate([q[0] for q in queries]) if m else np.zeros(0, np.int64)
        weight = np.concatenate([q[1] for q in queries]) if m else np.zeros(0)
        d = self.dense[term]
        often = d >= 0
        heavy = np.zeros((m, len(self.lists)))
        heavy[row[often], d[often]] = weight[often]
        row, term, weight = row[~often], term[~often], weight[~often]
        slots = self.slot[:, term]
        bound = heavy @ self.dense_top.T
        for b in range(blocks):
            bound[:, b] += np.bincount(row, weight * self.top[slots[b]], m)
        limit = ((bound * DIGITS).astype(np.int64) + 2) << self.bits
        best = np.full((m, k), -1, np.int64)

        def visit(b: int, who: np.ndarray) -> None:
            """Scores some queries against a block; a key is the cosine at 9 digits, then the rank, the lower first."""
            width = min(self.n, (b + 1) * BLOCK) - b * BLOCK
            s = heavy[who] @ self.lists[:, b * BLOCK : b * BLOCK + width].astype(np.float64)
            at = np.full(m, -1, np.int64)
            at[who] = np.arange(len(who))
            used = (at[row] >= 0) & (slots[b] > 0)
            runs = slots[b][used]
            lens = self.len[runs]
            where = _spread(lens, self.start[runs])
            s += np.bincount(np.repeat(at[row[used]] * width, lens) + self.owner[where], np.repeat(weight[used], lens) * self.weight[where], len(who) * width).reshape(len(who), width)
            key = (np.rint(np.clip(s, 0, 1) * DIGITS).astype(np.int64) << self.bits) + (1 << self.bits) - 1 - self.rank[b * BLOCK : b * BLOCK + width]
            if width > k:
                key = -np.partition(-key, k - 1, axis=1)[:, :k]
            best[who] = -np.sort(-np.concatenate([best[who], key], axis=1), axis=1)[:, :k]

        done = np.zeros((m, blocks), bool)
        if self.n and m:
            favourite = bound.argmax(axis=1)
            for b in np.unique(favourite):
                who = np.flatnonzero(favourite == b)
                visit(int(b), who)
                done[who, b] = True
            for b in np.argsort(-bound.max(axis=0), kind="stable"):
                who = np.flatnonzero(~done[:, b] & (limit[:, b] >= best[:, -1]))
                if len(who):
                    visit(int(b), who)
        found = best >= 0
        rank = np.where(found, (1 << self.bits) - 1 - (best & ((1 << self.bits) - 1)), 0)
        return np.where(found, self.place[rank] if self.n else 0, -1), np.where(found, (best >> self.bits) / DIGITS, 0.0)


def _logit(p: np.ndarray | float) -> np.ndarray | float:
    return np.log((np.asarray(p) + 0.01) / (1.01 - np.asarray(p)))


def platt(votes: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic calibration of weighted votes, by damped Newton steps."""
    x, a, b = _logit(votes), 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = n * p * (1 - p) + 1e-9
        g = np.array([(n * (p - y) * x).sum() + 1e-3 * (a - 1), (n * (p - y)).sum() + 1e-3 * b])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


class Model:
    """Weights, index and calibration, made once and sent to the workers.

    examples: (doc_id, terms, counts, label) by doc_id, at most ``MAX_EXAMPLES``; idf: one number a term.
    """

    def __init__(self, examples: list[tuple[int, np.ndarray, np.ndarray, int]], idf: np.ndarray):
        ys = np.array([e[3] for e in examples], np.int64)
        self.weight = idf * signal([e[1] for e in examples], ys, len(idf)) if 0 < ys.sum() < len(ys) else idf
        groups: dict[tuple[bytes, bytes], list] = {}
        for doc_id, ids, tf, y in examples:
            g = groups.setdefault((ids.tobytes(), tf.tobytes()), [0, 0, doc_id, unit(tf, self.weight[ids]), ids])
            g[0] += 1
            g[1] += y
        # Like with like, so that blocks have tight bounds: by the strongest term, empty texts aside.
        rows = sorted((g for g in groups.values() if len(g[4])), key=lambda g: (-int(g[1] > 0), int(g[4][g[3].argmax()]), g[2]))
        self.n, self.pos, self.ids = (np.array([g[k] for g in rows], np.int64) for k in (0, 1, 2))
        self.index = BlockMax([(g[4], g[3]) for g in rows], len(idf), np.argsort(np.argsort(self.ids)))
        self.rate = float(ys.mean()) if len(ys) else 0.0
        self.both = 0 < ys.sum() < len(ys) and len(rows) > 0
        self.a, self.b = self._calibrated([(g[4], g[3]) for g in rows]) if self.both else (0.0, 0.0)

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]], own: np.ndarray | None = None, label: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Share of toxic weight among the nearest examples, and the nearest class or -1. own: a class that lends one example of ``label`` less."""
        places, cos = self.index.nearest(vectors, K + (own is not None))
        less = (places == own[:, None]) if own is not None else np.zeros(places.shape, bool)
        n = np.where(places >= 0, self.n[places] - less, 0).astype(float)
        pos = np.where(places >= 0, self.pos[places] - label * less, 0).astype(float)
        take = np.minimum(n, np.maximum(0, K - (np.cumsum(n, axis=1) - n)))
        w = np.divide(take, n, out=np.zeros_like(n), where=n > 0) / (1 - np.minimum(cos, 1) + EPS)
        return ((w * pos).sum(axis=1) + PRIOR * self.rate) / ((w * n).sum(axis=1) + PRIOR), places[:, 0]

    def _calibrated(self, vectors) -> tuple[float, float]:
        out: list[tuple[float, int, int]] = []
        for a in range(0, len(vectors), BATCH):
            own = np.arange(a, min(len(vectors), a + BATCH))
            for y, m in ((1, self.pos[own]), (0, (self.n - self.pos)[own])):
                some = own[m > 0]
                votes, _ = self.votes([vectors[k] for k in some], some, y)
                out += zip(votes.tolist(), [y] * len(some), m[m > 0].tolist())
        votes, ys, n = (np.array(x, float) for x in zip(*out))
        return platt(votes, ys, n)

    def score(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[int | None]]:
        """(score, doc_id of the nearest example or None) of each text's terms and counts."""
        votes, best = np.full(len(counts), self.rate), [None] * len(counts)
        some = [k for k, (ids, _) in enumerate(counts) if len(ids)]
        if some and self.index.n:
            found, places = self.votes([(ids, unit(tf, self.weight[ids])) for ids, tf in (counts[k] for k in some)])
            votes[some] = found
            for k, p in zip(some, places.tolist()):
                best[k] = int(self.ids[p])
        return (1 / (1 + np.exp(-(self.a * _logit(votes) + self.b))) if self.both else votes), best


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        found = [Counter(words(t.as_py())) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64())), b.column(2)], ["doc_id", "word", "tf", "toxic"])


def examples_of(rows: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> tuple[list[tuple[int, np.ndarray, np.ndarray, int]], dict[str, int]]:
    """The sample of labelled documents (doc_id, terms, counts, label) by doc_id, and the numbers of all their words."""
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held)
    # The bounded sample is fixed before any text is moved.
    chosen = marked.join(rows.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    small = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    got = small.mapInArrow(_counted, "doc_id bigint, word array<string>, tf array<bigint>, toxic int").toArrow().sort_by("doc_id")
    flat, counts = (got.column(c).combine_chunks().flatten() for c in ("word", "tf"))
    known = pc.unique(flat)
    known = known.take(pc.sort_indices(known))  # by bytes: the same numbers everywhere
    ids, tf = pc.index_in(flat, known).to_numpy(zero_copy_only=False).astype(np.int64), counts.to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.list_value_length(got.column("word").combine_chunks()).to_numpy(zero_copy_only=False)).tolist()
    out = []
    for i, y, start, end in zip(got.column("doc_id").to_pylist(), got.column("toxic").to_pylist(), [0, *ends], ends):
        order = np.argsort(ids[start:end])
        out.append((i, ids[start:end][order], tf[start:end][order], int(y > 0)))
    return out, {w: k for k, w in enumerate(known.to_pylist())}


def document_frequency(rows: DataFrame, vocabulary) -> tuple[np.ndarray, int]:
    """Documents with each term, over all of them, and how many there are; summed in the task, then by term. vocabulary: a broadcast."""
    size = len(vocabulary.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, df, n = Terms(vocabulary.value), np.zeros(size + 1, np.int64), 0
        for b in slices(batches):
            n += b.num_rows
            for t in b.column(0):
                df[terms.present(t.as_py())] += 1
        df[size] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], ["term", "n"])

    found = rows.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row a term of the sample
    df = np.zeros(size + 1, np.int64)
    df[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return df[:size], int(df[size])


def toxicity(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """(doc_id, held_out, score, predicted, nearest_example), one row per document."""
    context = docs.sparkSession.sparkContext
    rows = doc_text(docs)
    examples, vocabulary = examples_of(rows, labels, max_examples)
    known = context.broadcast(vocabulary)  # words of the sample alone
    df, total = document_frequency(rows, known)
    model = context.broadcast(Model(examples, np.log((1 + total) / (1 + df)) + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, m = Terms(known.value), model.value
        for b in slices(batches, BATCH):
            got, best = m.score([terms.counts(t.as_py()) for t in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64()), pa.array(best, pa.int64())], ["doc_id", "score", "nearest_example"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = rows.mapInArrow(score, "doc_id bigint, score double, nearest_example bigint")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "nearest_example")


def query(spark, sf_dir):
    return toxicity(docs_table(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
