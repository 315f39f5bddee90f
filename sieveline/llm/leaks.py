"""Operator 9: benchmark decontamination by latent semantic retrieval.

1. Terms are the benchmark's words. One pass turns every document into term
   numbers; document frequencies come from all of them. Words in more than
   ``MAX_DF`` of the documents carry no weight, but for the ``RARE`` rarest of
   each item, so that an item copied into very many documents keeps its own.
2. Passages (``2 * STEP`` words every ``STEP`` words) become TF-IDF vectors. A
   randomised SVD over the benchmark's items and all passages of all documents
   gives the latent space: random projections, power rounds and the final factor
   are sums over a table of the weighted words, added up by term in whole numbers
   of 1 / ``UNIT``, so that neither the order nor the partitions of the documents
   change it. An item's passage counts as much as ``ITEM_WEIGHT ** 2`` passages
   for every ``PER_DOCS`` documents, so that the items' share of the space
   doesn't shrink as the table grows.
3. Every passage of every document with at least 3 weighted words is projected and compared by cosine with all
   items (the stated query set, in blocks of ``ITEM_BLOCK``); all pairs from
   ``MIN_COSINE`` on that share ``MIN_TERMS`` weighted words (or all that the
   item has) are candidates, none is capped.
4. A candidate's longest common subsequence of words with the item, over the
   passage and as much text on either side as the item is long, must cover
   ``SURE`` of the item, or ``MAYBE`` of it together with ``ANSWER`` of its last
   sentence: so copies, edited copies and reordered ends are told from texts
   that only share vocabulary.
5. What the gates of step 3 pass over is found by an exact second path without
   weights: an item is looked for wherever a stretch of the document has
   ``MAYBE`` of its words, the least that step 4 can accept. So an item that is
   in most documents, or whose words are all frequent, is found like any other,
   and the result is that of step 4 at every passage.

Defined cases: null and empty texts and items match nothing; an item of fewer
than ``MIN_WORDS`` words can't be told from chance by its words, so it matches
only as a whole word sequence (share 1, answer found, null cosine); repeated
items each get their row; repeated documents each get theirs; a null doc_id is
a document like others; empty tables give an empty result; further columns are
ignored by ``matches`` and kept by ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved, doc_text, docs_table, shuffle_parts, slices

STEP, RANK, OVERSAMPLE, POWER = 16, 64, 16, 2
ITEM_BLOCK, COUNT_BLOCK, PAIRS, MIN_WORDS = 2048, 64, 1 << 16, 8
#: characters of items that a broadcast holds; a larger query set is searched in parts
PART_CHARS = 16 << 20
ITEM_WEIGHT, PER_DOCS, MAX_DF, RARE, MIN_TERMS, MIN_COSINE = 8.0, 500, 0.02, 6, 4, 0.42
SURE, MAYBE, ANSWER = 0.75, 0.55, 0.7
SEED = 7
#: steps of the sums behind the latent space; terms that travel together; passages worked on at once
UNIT, TERM_BLOCK, PASSAGES = 1 << 30, 16, 1024
CHUNK_WORDS = 1 << 16
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~¡¿«»‚‘’“”„…–—·•"
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str | None) -> list[str]:
    """White-space separated words in lower case without signs at their ends; what is signs alone drops out."""
    return [w for x in (text or "").lower().split() if (w := x.strip(_SIGNS))]


class Numbers:
    """Term numbers of a text's words, -1 for a word that is no term."""

    def __init__(self, vocabulary: dict[str, int]):
        self.get = (vocabulary | {"": -2}).get

    def of(self, text: str | None) -> np.ndarray:
        get = self.get
        ids = np.array([get(w.strip(_SIGNS), -1) for w in text.lower().split()] if text else [], np.int32)
        return ids[ids != -2]


class Counts:
    """How often each word occurs in each of some items, over the words of these items alone, so that the size follows the items' words."""

    def __init__(self, words: list[list[int]], longest: int):
        self.terms = np.unique(np.concatenate([np.array(w, np.int64) for w in words]))
        # Columns fill whole machine words; no sum over different words exceeds an item's length.
        self.table = np.zeros((len(self.terms), -(-len(words) // 8) * 8), np.min_scalar_type(longest))
        for k, w in enumerate(words):
            np.add.at(self.table[:, k], np.searchsorted(self.terms, w), 1)
        self.least = np.array([MAYBE * len(w) - 1e-6 for w in words])


class Items:
    """The benchmark: term numbers of each item, and of its last sentence as the answer."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        kept = [(i, w, t) for i, t in rows if len(w := words_of(t)) >= MIN_WORDS]
        short = [(i, w) for i, t in rows if 0 < len(w := words_of(t)) < MIN_WORDS]
        self.ids = [i for i, _, _ in kept]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws, _ in kept for w in ws}))}
        self.weighable = len(self.vocabulary)  # words of short items alone come after these
        for _, ws in short:
            for w in ws:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        number = lambda ws: [self.vocabulary[w] for w in ws]
        self.words = [number(w) for _, w, _ in kept]
        self.masks = [_masks(w) for w in self.words]
        self.longest = max(map(len, self.words), default=0)
        self.blocks = [Counts(self.words[a : a + COUNT_BLOCK], self.longest) for a in range(0, len(self.words), COUNT_BLOCK)]
        answers = [number(_answer(t)) for _, _, t in kept]
        self.answers = [(_masks(a), len(a)) for a in answers]
        # Short items are numbered after the others; those of one length by their words.
        self.short: dict[int, dict[tuple[int, ...], list[int]]] = {}
        weighted = [np.unique(w) for w in self.words]
        self.own = np.concatenate([k * len(self.vocabulary) + w for k, w in enumerate(weighted)]) if weighted else np.zeros(0, np.int64)
        self.own_item = np.repeat(np.arange(len(weighted)), [len(w) for w in weighted])
        for k, (_, w) in enumerate(short):
            self.short.setdefault(len(w), {}).setdefault(tuple(number(w)), []).append(len(self.ids) + k)
        self.all_ids = self.ids + [i for i, _ in short]

    def weights(self, df: np.ndarray, n: int) -> np.ndarray:
        """Inverse document frequencies, zero for terms that carry no weight."""
        idf = np.log((1 + n) / (1 + df)) + 1
        keep = df <= MAX_DF * max(n, 1)
        for w in self.words:
            keep[sorted(set(w), key=lambda t: (df[t], t))[:RARE]] = True
        keep[self.weighable :] = False
        return np.where(keep, idf, 0.0)


def _answer(text: str) -> list[str]:
    """Words of the last sentence that has at least three."""
    for s in reversed(_SENTENCE.split(text)):
        if len(w := words_of(s)) >= 3:
            return w
    return words_of(text)


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


def lcs(masks: dict[int, int], m: int, other: list[int]) -> int:
    """Longest common subsequence of a word list of length m and ``other``, a machine word of bits a step."""
    full = (1 << m) - 1
    v = full
    for w in other:
        if (mask := masks.get(w)) is not None:
            u = v & mask
            v = (v + u | v - u) & full
    return m - v.bit_count()


def passages(ids: list[np.ndarray], weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, step, kept positions' step number and term) of the words that carry weight: steps are numbered over all documents, one more a document so that none is its neighbour's."""
    steps = np.array([-(-len(x) // STEP) + 1 for x in ids], np.int64)
    begin = np.concatenate([[0], np.cumsum(steps)])
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    lens = np.array([len(x) for x in ids], np.int64)
    pos = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    step = np.repeat(begin[:-1], lens) + pos // STEP
    keep = flat >= 0
    keep[keep] = weight[flat[keep]] > 0
    return begin, step[keep], flat[keep]


def latent(step: np.ndarray, term: np.ndarray, emb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first step, unit latent vector) of each passage, two steps long, that has enough weighted words."""
    if not len(step):
        return np.zeros(0, np.int64), np.zeros((0, emb.shape[1]), np.float32)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(step)) + 1])
    at, terms = step[cut], np.diff(np.concatenate([cut, [len(step)]]))
    first = np.unique(np.concatenate([at - 1, at]))
    first = first[first >= 0]
    parts, n = [], np.zeros(len(first), np.int64)
    for d in (0, 1):
        k = np.minimum(np.searchsorted(at, first + d), len(at) - 1)
        parts.append(np.where(at[k] == first + d, k, -1))
        n += np.where(parts[d] >= 0, terms[k], 0)
    enough = n >= 3
    first = first[enough]
    sums = np.concatenate([np.add.reduceat(emb[term], cut, axis=0), np.zeros((1, emb.shape[1]), np.float32)])
    out = sums[parts[0][enough]] + sums[parts[1][enough]]
    norm = np.linalg.norm(out, axis=1)
    good = norm > 1e-6
    return first[good], out[good] / norm[good, None]


def shared_words(step: np.ndarray, term: np.ndarray, first: np.ndarray, item: np.ndarray, own: np.ndarray, size: int) -> np.ndarray:
    """Weighted words, repeats included, of each passage (its first step) that are the item's; own: item * size + term, in order."""
    a, b = np.searchsorted(step, first), np.searchsorted(step, first + 2)
    lens = b - a
    ends = np.cumsum(lens)
    where = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lens - a, lens)
    key = np.repeat(item, lens) * size + term[where]
    at = np.minimum(np.searchsorted(own, key), max(0, len(own) - 1))
    total = np.concatenate([[0], np.cumsum(own[at] == key)]) if len(own) else np.zeros(len(key) + 1, np.int64)
    return total[ends] - total[ends - lens]


def unit_rows(step: np.ndarray, term: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first entry of each passage and the end of all, term, value): unit TF-IDF rows of all passages with any weight, terms in order."""
    size = len(idf)
    key, n = np.unique(np.concatenate([step - 1, step]) * size + np.concatenate([term, term]), return_counts=True)
    first, term = np.divmod(key, size)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(first)) + 1, [len(key)]])
    value = n * idf[term]
    return cut, term, value / np.repeat(np.sqrt(np.add.reduceat(value * value, cut[:-1])), np.diff(cut))


class Gram:
    """A'A basis of passage rows A, as whole numbers of 1 / ``UNIT``: exact sums, whatever the order."""

    def __init__(self, basis: np.ndarray, idf: np.ndarray):
        self.basis, self.idf = basis, idf
        self.total = np.zeros(basis.shape, np.int64)
        self.alone = np.zeros(len(idf), np.int64)  # passages of one term, whose rows are that term's unit vector

    def add(self, step: np.ndarray, term: np.ndarray) -> None:
        if not len(step):
            return
        cut, term, value = unit_rows(step, term, self.idf)
        lens = np.diff(cut)
        self.alone += np.bincount(term[cut[:-1][lens == 1]], minlength=len(self.alone))
        several = np.repeat(lens > 1, lens)
        term, value, lens = term[several], value[several], lens[lens > 1]
        ends = np.cumsum(lens)
        for k in range(0, len(lens), PASSAGES):
            some = lens[k : k + PASSAGES]
            begin, end = ends[k] - some[0], ends[k + len(some) - 1]
            t, v = term[begin:end], value[begin:end, None]
            rows = np.add.reduceat(v * self.basis[t], np.cumsum(some) - some, axis=0)
            part = np.rint(v * np.repeat(rows, some, axis=0) * UNIT).astype(np.int64)
            order = np.argsort(t, kind="stable")
            t = t[order]
            at = np.concatenate([[0], np.flatnonzero(np.diff(t)) + 1])
            self.total[t[at]] += np.add.reduceat(part[order], at, axis=0)

    def sums(self) -> np.ndarray:
        return self.total + self.alone[:, None] * np.rint(self.basis * UNIT).astype(np.int64)


def numbered(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, ids): term numbers of all words as 32-bit integers, -1 for other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(vocabulary)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([numbers.of(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], ["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id bigint, ids binary")


def _read(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32) for x in column.to_pylist()]


def document_frequency(known: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Documents that have each term, over all of them, and how many there are; summed in the task, then by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(size + 1, np.int64), 0
        for b in slices(batches):
            n += b.num_rows
            for ids in _read(b.column(0)):
                df[np.unique(ids)] += 1  # -1 is counted in the last place
        df[size] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], ["term", "n"])

    df = np.zeros(size + 1, np.int64)
    for r in known.select("ids").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():  # one row a term of the query set
        df[r["term"]] = r["n"]
    return df[:size], int(df[size])


def weighted(known: DataFrame, idf: np.ndarray) -> DataFrame:
    """(step, term): ``passages`` of all documents, one row for about ``CHUNK_WORDS`` words of them."""

    def row(docs: list[np.ndarray]) -> pa.RecordBatch:
        _, step, term = passages(docs, idf)
        return pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32).tobytes()] if len(x) else [], pa.binary()) for x in (step, term)], ["step", "term"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, total = [], 0
        for b in slices(batches):
            for ids in _read(b.column(0)):
                docs.append(ids)
                total += len(ids)
                if total >= CHUNK_WORDS:
                    yield row(docs)
                    docs, total = [], 0
        yield row(docs)

    return known.select("ids").mapInArrow(run, "step binary, term binary")


def gram(rows: DataFrame, basis: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A'A basis over the passages of ``weighted``, in whole numbers of 1 / ``UNIT``; partial sums meet by term, and the driver gets one row a block of terms."""
    width = TERM_BLOCK * basis.shape[1]
    blocks = -(-len(idf) // TERM_BLOCK)

    def batch(at: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "part"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Gram(basis, idf)
        for b in batches:
            for step, term in zip(_read(b.column(0)), _read(b.column(1))):
                g.add(step.astype(np.int64), term.astype(np.int64))
        parts = np.split(g.sums(), range(TERM_BLOCK, len(idf), TERM_BLOCK))
        some = [k for k, p in enumerate(parts) if p.any()]
        for k in range(0, len(some), 64):
            yield batch(some[k : k + 64], [parts[i] for i in some[k : k + 64]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(part, np.int64)
                sums[k] = sums[k] + part if k in sums else part
        if sums:
            yield batch(list(sums), list(sums.values()))

    out = np.zeros((blocks, width), np.int64)
    parts = min(blocks, shuffle_parts(rows.sparkSession))
    for r in rows.mapInArrow(count, "block int, part binary").repartition(parts, "block").mapInArrow(add, "block int, part binary").collect():
        part = np.frombuffer(r["part"], np.int64)
        out[r["block"], : len(part)] = part
    return out.reshape(-1, basis.shape[1])[: len(idf)]


def latent_space(known: DataFrame, items: Items, idf: np.ndarray, n: int) -> np.ndarray:
    """Term embeddings (term, rank), weights included, by randomised SVD of the TF-IDF passages of all n documents."""
    size = len(idf)
    rank = min(size, RANK + OVERSAMPLE)
    # What the queries say must survive the reduction, so items weigh more than passages.
    _, *own = passages([np.array(w) for w in items.words], idf)
    weight = ITEM_WEIGHT**2 * max(1.0, n / PER_DOCS)

    def both(basis: np.ndarray) -> np.ndarray:
        g = Gram(basis, idf)
        g.add(*own)
        return (weight * g.sums() + gram(rows.df, basis, idf)) / UNIT

    rows = Saved(weighted(known, idf), "passages")
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, rank)))[0]
    for _ in range(POWER):
        q = np.linalg.qr(both(q))[0]
    small = q.T @ both(q)
    rows.drop()
    _, vectors = np.linalg.eigh((small + small.T) / 2)
    v = q @ vectors[:, ::-1][:, :RANK]
    return (v * idf[:, None]).astype(np.float32)


def _verify(items: Items, k: int, ids: np.ndarray, at: int) -> tuple[float, bool]:
    """(share of the item in the longest common subsequence, answer found) around a passage of the document."""
    own = items.words[k]
    m = len(own)
    around = ids[max(0, at - m) : at + 2 * STEP + m].tolist()
    if sum(map(set(around).__contains__, own)) < MAYBE * m:  # no longer subsequence than words in common
        return 0.0, False
    ratio = lcs(items.masks[k], m, around) / m
    if ratio < MAYBE:
        return ratio, False
    masks, n = items.answers[k]
    return ratio, lcs(masks, n, around) >= ANSWER * n


def stretches(ids: list[np.ndarray], items: Items) -> Iterator[tuple[int, int, int, int]]:
    """(document, first word, word after the last, item): stretches with ``MAYBE`` of an item's words, in any order.

    They overlap so that each text that ``_verify`` may look at lies in one, beginning in its first ``_stride`` words.
    """
    size, more = _stride(items), 2 * items.longest + 2 * STEP
    lens = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    base = np.cumsum(lens // size + 1) - lens // size - 1
    pos = (np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens))[flat >= 0]
    base_of, flat = np.repeat(base, lens)[flat >= 0], flat[flat >= 0].astype(np.int64)
    keys = []
    for back in range(-(-more // size) + 1):
        k = pos // size - back
        fits = (k >= 0) & (pos < (k + 1) * size + more)
        keys.append((base_of[fits] + k[fits]) * len(items.vocabulary) + flat[fits])
    keys = np.sort(np.concatenate(keys))
    if not len(keys):
        return
    block, term = np.divmod(keys[np.concatenate([[True], keys[1:] != keys[:-1]])], len(items.vocabulary))
    cut = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1])
    block = block[cut]
    for n, some in enumerate(items.blocks):
        at = np.minimum(np.searchsorted(some.terms, term), len(some.terms) - 1)
        rows = some.table.view(np.uint64)[at]
        rows[some.terms[at] != term] = 0
        shared = np.add.reduceat(rows, cut, axis=0).view(some.table.dtype)
        i, j = np.nonzero(shared[:, : len(some.least)] >= some.least)
        doc = np.searchsorted(base, block[i], side="right") - 1
        begin = (block[i] - base[doc]) * size
        yield from zip(doc.tolist(), begin.tolist(), (begin + size + more).tolist(), (n * COUNT_BLOCK + j).tolist())


def sequences(ids: list[np.ndarray], items: Items) -> Iterator[tuple[int, int]]:
    """(document, short item) wherever all words of the item follow each other; a pair can come repeatedly."""
    lens = np.array([len(x) + 1 for x in ids], np.int64)
    flat = np.concatenate([part for x in ids for part in (x, [-1])]).astype(np.int64)
    ends = np.cumsum(lens)
    size = max(1, len(items.vocabulary))
    for n, known in items.short.items():
        if n > len(flat):
            continue
        pairs = np.array([w[0] * size + w[-1] for w in known], np.int64)
        last = flat[n - 1 :]
        first = flat[: len(last)]
        at = np.flatnonzero((first >= 0) & (last >= 0))
        for p in at[np.isin(first[at] * size + last[at], pairs)].tolist():
            for k in known.get(tuple(flat[p : p + n].tolist()), ()):
                yield int(np.searchsorted(ends, p, side="right")), k


def _stride(items: Items) -> int:
    return max(128, 2 * items.longest)


def _cosine(ids: np.ndarray, at: int, emb: np.ndarray, query: np.ndarray) -> float:
    """Of one passage with an item; 0 where no word has weight."""
    words = ids[at : at + 2 * STEP]
    v = emb[words[words >= 0]].sum(axis=0)
    norm = float(np.linalg.norm(v))
    return float(v @ query) / norm if norm > 1e-6 else 0.0


def search(docs: list[np.ndarray], items: Items, emb: np.ndarray, queries: np.ndarray, weight: np.ndarray) -> list[dict[int, tuple[float | None, float, bool]]]:
    """For each document's term numbers: item number -> (cosine, share, answer found) of verified items."""
    out: list[dict[int, tuple[float | None, float, bool]]] = [{} for _ in docs]
    if not items.all_ids:
        return out

    size = max(1, len(items.vocabulary))
    heavy = weight[items.own % size] > 0
    own = items.own[heavy]
    need = np.minimum(MIN_TERMS, np.bincount(items.own_item[heavy], minlength=len(items.ids)))

    def part(rows: range) -> None:
        if items.short:
            for d, k in sequences([docs[r] for r in rows], items):
                out[rows[d]][k] = (None, 1.0, True)
        if not items.ids:
            return
        begin, step, term = passages([docs[r] for r in rows], weight)
        first, vec = latent(step, term, emb)
        doc = np.searchsorted(begin, first, side="right") - 1
        at = (first - begin[doc]) * STEP
        for a in range(0, len(queries), ITEM_BLOCK):
            for p in range(0, len(vec), 4096):
                cos = vec[p : p + 4096] @ queries[a : a + ITEM_BLOCK].T
                i, j = np.nonzero(cos >= MIN_COSINE)
                enough = np.concatenate([shared_words(step, term, first[p + i[q : q + PAIRS]], a + j[q : q + PAIRS], own, size) for q in range(0, len(i), PAIRS)] or [[]]) >= need[a + j]
                i, j = i[enough], j[enough]
                for d, w, k, c in zip(doc[p + i].tolist(), at[p + i].tolist(), (j + a).tolist(), cos[i, j].tolist()):
                    found = out[rows[d]]
                    best = found.get(k)
                    if best is None or best[1] < 1.0:
                        share, answer = _verify(items, k, docs[rows[d]], w)
                        if (share >= SURE or share >= MAYBE and answer) and (best is None or share > best[1]):
                            found[k] = (c, share, answer)
        for d, begin, end, k in stretches([docs[r] for r in rows], items):
            ids, found, m = docs[rows[d]], out[rows[d]], len(items.words[k])
            best = found.get(k)
            if best is not None and best[1] >= 1.0:
                continue
            near = ids[begin:end]
            near = near[near >= 0]
            if lcs(items.masks[k], m, near.tolist()) < MAYBE * m:  # no more in any part of it
                continue
            for w in range(-(-(begin + m) // STEP) * STEP if begin else 0, min(len(ids), begin + _stride(items) + m), STEP):
                share, answer = _verify(items, k, ids, w)
                if (share >= SURE or share >= MAYBE and answer) and (best is None or share > best[1]):
                    best = found[k] = (_cosine(ids, w, emb, queries[k]), share, answer)

    start = total = 0
    for r, ids in enumerate(docs):
        total += len(ids)
        if total >= CHUNK_WORDS or r == len(docs) - 1:
            part(range(start, r + 1))
            start, total = r + 1, 0
    return out


def _parts(benchmark: DataFrame, chars: int) -> list[DataFrame]:
    """The items in parts of about ``chars`` characters at most; one part for most query sets."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    n = -(-int(items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // chars)
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)] if n > 1 else [items]


def _prepared(docs: DataFrame, items: DataFrame):
    """The numbered documents, and a broadcast of all that a task needs, whose size follows the part of the query set alone."""
    rows = items.collect()
    items = Items([(r["item_id"], r["text"]) for r in rows])
    known = Saved(numbered(docs, items.vocabulary), "terms").df
    df, n = document_frequency(known, len(items.vocabulary))
    idf = items.weights(df, n)
    emb = latent_space(known, items, idf, n) if items.ids else np.zeros((0, 1), np.float32)
    queries = np.array([emb[w].sum(axis=0) for w in items.words], np.float32).reshape(len(items.ids), emb.shape[1])
    queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-9)
    return known, docs.sparkSession.sparkContext.broadcast((items, emb, queries, idf))


def matches(docs: DataFrame, benchmark: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_found): one row per document and benchmark item that it contains."""
    return reduce(DataFrame.unionByName, [_matches(docs, part) for part in _parts(benchmark, part_chars)])


def _matches(docs: DataFrame, part: DataFrame) -> DataFrame:
    known, shared = _prepared(doc_text(docs), part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, emb, queries, weight = shared.value
        for b in slices(batches):
            found = search(_read(b.column(1)), items, emb, queries, weight)
            got = [(i, items.all_ids[k], *v) for i, f in zip(b.column(0).to_pylist(), found) for k, v in sorted(f.items())]
            cols = list(zip(*got)) if got else [()] * 5
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "item_id", "cosine", "lcs_share", "answer_found"])

    return known.mapInArrow(run, "doc_id bigint, item_id bigint, cosine double, lcs_share double, answer_found boolean")


def clean(docs: DataFrame, benchmark: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """The rows, all columns kept, of documents that contain no benchmark item; judged in place, without a join."""
    return reduce(_clean, _parts(benchmark, part_chars), docs)


def _clean(docs: DataFrame, part: DataFrame) -> DataFrame:
    _, shared = _prepared(doc_text(docs), part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, emb, queries, weight = shared.value
        numbers = Numbers(items.vocabulary)
        for b in slices(batches):
            texts = b.column(b.schema.get_field_index("text"))
            found = search([numbers.of(t.as_py()) for t in texts], items, emb, queries, weight)
            yield b.filter(pa.array([not f for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir):
    return matches(docs_table(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
