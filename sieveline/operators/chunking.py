"""Chunkers: text in, spans (start, end in code points) out; identifiers and checksums are native columns.

A text is cut in Python, because a span's start depends on the one before, and
comes back as its chunks, in batches bounded by characters, never beside a copy
of the whole text; all else is expressions.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from ..functions.ids import checksum, chunk_id
from ..functions.text import TOKEN_COUNTERS
from ..registry import chunkers
from .embedding import Hashing, neighbour_distances

Range = tuple[int, int]
_PIECE = re.compile(r"\w+|[^\w\s]")


def approx_count(text: str) -> int:
    return sum(max(1, round(len(p) / 4)) if len(p) >= 6 else 1 for p in _PIECE.findall(text))


def ws_count(text: str) -> int:
    return len(text.split())


COUNTERS: dict[str, Callable[[str], int]] = {"approx": approx_count, "whitespace": ws_count}


@functools.cache
def _kinds() -> np.ndarray:
    """By code point: 0 space, 1 a sign, 2 part of a word, as Python's patterns have it."""
    every = "".join(map(chr, range(0x110000)))
    out = np.ones(len(every), np.uint8)
    for pattern, kind in ((r"\s+", 0), (r"\w+", 2)):
        for m in re.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of True start and stop."""
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return edge[::2], edge[1::2]


def _measured(text: str, count: Callable[[str], int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words start and stop; the tokens before each place of the text, right at borders of words or of single signs.

    The known counters add up over words, so one pass over the code points serves all spans.
    """
    kind = _kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    start, stop = _runs(kind > 0)
    tokens = np.zeros(len(kind) + 1, np.int64)
    if count is approx_count:
        tokens[1:] = kind == 1
        a, b = _runs(kind == 2)
        n = b - a
        tokens[a + 1] = np.where(n >= 6, (n + 1 + (n >> 2 & 1)) >> 2, 1)  # a quarter, half to even
    else:
        tokens[start + 1] = 1 if count is ws_count else [max(1, count(text[a:b])) for a, b in zip(start.tolist(), stop.tolist())]
    return start, stop, np.cumsum(tokens)


def _words(text: str, count: Callable[[str], int]) -> tuple[list[Range], list[int]]:
    """The words' spans and the prefix sums of their tokens."""
    start, stop, before = _measured(text, count)
    return list(zip(start.tolist(), stop.tolist())), [*before[start].tolist(), int(before[-1])]


def _sizes(text: str, spans: list[Range], count: Callable[[str], int]) -> list[int]:
    """Tokens of spans that cut no word."""
    at = np.array(spans)
    before = _measured(text, count)[2]
    return (before[at[:, 1]] - before[at[:, 0]]).tolist()


def _windows(total: list[int], first: int, end: int, size: int, overlap: int) -> list[Range]:
    """Windows, as word numbers, over the words from ``first`` to before ``end``; both walks are binary searches in the prefix sums."""
    out = []
    while first < end:
        last = max(first + 1, bisect_left(total, total[first] + size + 1, first, end + 1) - 1)
        out.append((first, last))
        if last >= end:
            break
        back = last
        if overlap:
            # The largest start from which at least ``overlap`` tokens are covered.
            back = bisect_left(total, total[last] - overlap + 1, 0, last + 1) - 1
        first = max(first + 1, min(back, last))
    return out


def fixed_spans(text: str, size: int, overlap: int, count: Callable[[str], int]) -> list[Range]:
    """Windows of whole words up to ``size`` tokens, the next one reaching back over ``overlap`` tokens."""
    words, total = _words(text, count)
    return [(words[a][0], words[b - 1][1]) for a, b in _windows(total, 0, len(words), size, overlap)]


_ABBREVIATED = frozenset("approx al ca cf ch co dept dr e.g eq est etc fig i.e inc jr ltd max min mr mrs ms no pp prof sr st vol vs".split())
_STOP = re.compile("[.!?]+[\"')\\]»”’]*(?=\\s)")
_PARAGRAPH = re.compile(r"\n[ \t]*\n")
_WORD_BACK = re.compile(r"[\w.]+")


def _ends_sentence(text: str, at: int) -> bool:
    m = _WORD_BACK.match(text[max(0, at - 80) : at][::-1])
    if not m:
        return True
    w = m.group()[::-1].lower().rstrip(".")
    return not (w in _ABBREVIATED or len(w) == 1 and w.isalpha() or w.isdigit())


def sentence_spans(text: str) -> list[Range]:
    """Sentences without the space around them. Abbreviations, initials and numbers don't end one; a blank line does."""
    cuts = {m.start() for m in _PARAGRAPH.finditer(text)}
    cuts |= {m.end() for m in _STOP.finditer(text) if _ends_sentence(text, m.start())}
    edges = [0, *sorted(c for c in cuts if 0 < c < len(text)), len(text)]
    out = []
    for a, b in zip(edges, edges[1:]):
        part = text[a:b]
        left = len(part) - len(part.lstrip())
        if left < len(part):
            out.append((a + left, a + len(part.rstrip())))
    return out


def packed_sentences(text: str, size: int, overlap_sentences: int, count: Callable[[str], int]) -> list[Range]:
    """Whole sentences up to ``size`` tokens; an oversized one stands alone."""
    sents = sentence_spans(text)
    weight = _sizes(text, sents, count) if sents else []
    out, first, n = [], 0, len(sents)
    while first < n:
        last, used = first + 1, weight[first]
        while last < n and used + weight[last] <= size:
            used += weight[last]
            last += 1
        out.append((sents[first][0], sents[last - 1][1]))
        if last == n:
            break
        first = max(last - overlap_sentences, first + 1)
    return out


def semantic_spans(text: str, embed: Callable[[list[str]], np.ndarray], percentile: float, buffer: int, max_size: int, min_sentences: int, count: Callable[[str], int], near: Callable[[list[str], int], np.ndarray] | None = None) -> list[Range]:
    """Groups of sentences between the widest gaps of meaning.

    A text of no more than ``min_sentences`` is one span over all of them.
    near: the vectors of all sentences with ``buffer`` ones on either side, in place of ``embed`` over the joined sentences.
    """
    sents = sentence_spans(text)
    n = len(sents)
    if n == 0:
        return []
    if n <= max(1, min_sentences):
        return [(sents[0][0], sents[-1][1])]
    words = [text[a:b] for a, b in sents]
    vectors = near(words, buffer) if near else embed([" ".join(words[max(0, i - buffer) : i + buffer + 1]) for i in range(n)])
    gap = neighbour_distances(vectors)
    limit = float(np.quantile(gap, percentile))
    groups, start = [], 0
    for i in range(1, n):
        if gap[i - 1] > limit and i - start >= min_sentences:
            groups.append((start, i))
            start = i
    groups.append((start, n))
    size = _sizes(text, sents, count)
    out, todo = [], groups[::-1]
    while todo:
        a, b = todo.pop()
        if sum(size[a:b]) > max_size and b - a > 1:
            cut = a + 1 + int(np.argmax(gap[a : b - 1]))
            todo += [(cut, b), (a, cut)]
        else:
            out.append((sents[a][0], sents[b - 1][1]))
    return out


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigurationError(message)


@chunkers.plugin("fixed")
def fixed(chunk_size: int = 512, overlap: int = 64, counter: str = "approx"):
    _check(chunk_size > 0 and 0 <= overlap < chunk_size, "overlap must be at least 0 and below chunk_size")
    count = COUNTERS[counter]
    return lambda t: fixed_spans(t, chunk_size, overlap, count)


@chunkers.plugin("sentence")
def sentence(chunk_size: int = 512, overlap_sentences: int = 1, counter: str = "approx"):
    _check(chunk_size > 0 and overlap_sentences >= 0, "chunk_size must be positive, overlap_sentences not negative")
    count = COUNTERS[counter]
    return lambda t: packed_sentences(t, chunk_size, overlap_sentences, count)


@chunkers.plugin("semantic")
def semantic(breakpoint_percentile: float = 0.95, buffer_size: int = 1, max_chunk_size: int = 1024, min_sentences: int = 1, counter: str = "approx", dimensions: int = 384):
    _check(0 < breakpoint_percentile < 1 and buffer_size >= 0 and min_sentences >= 1, "semantic chunking options out of bounds")
    count = COUNTERS[counter]

    def cut(text: str) -> list[Range]:
        model = Hashing.shared(dimensions)
        return semantic_spans(text, model.embed, breakpoint_percentile, buffer_size, max_chunk_size, min_sentences, count, model.windows)

    return cut


#: code points that Python's patterns and Java's class alike
_PLAIN = np.isin(np.arange(0x2060), [*range(0x1C), *range(0x20, 0x85), *range(0x86, 0xA0), *range(0xA1, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)])


def _counter_of(text: str, counter: str) -> Callable[[int, int], int | None]:
    """Tokens of a span as the native expression has them; none where that has to count: other code points, a cut word."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if cp.max(initial=0) >= len(_PLAIN) or not _PLAIN[cp].all():
        return lambda a, b: None
    before, end = _measured(text, COUNTERS[counter])[2], len(text)
    whole = lambda a, b: (a == 0 or text[a - 1].isspace()) and (b == end or text[b].isspace())
    return lambda a, b: int(before[b] - before[a]) if whole(a, b) else None


#: texts taken out of Arrow together; characters of chunks after which a batch goes back
TEXTS, CHARS = 256, 1 << 20


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    """(id, text) of the rows with a text."""
    for b in batches:
        for at in range(0, b.num_rows, TEXTS):
            some = b.slice(at, TEXTS)
            yield from ((i, t) for i, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist()) if t)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """rows: each with its number of characters in front."""
    held, n = [], 0
    for size, *row in rows:
        held.append(row)
        n += size
        if n > CHARS or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_SPAN = pa.schema([("document_id", pa.string()), ("position", pa.int32()), ("content", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("_n", pa.int32())])


def _spans_of(cut: Callable[[str], list[Range]], counter: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for i, t in _texts(batches):
            tokens = _counter_of(t, counter)
            yield from ((e - s, i, k, t[s:e], s, e, tokens(s, e)) for k, (s, e) in enumerate(cut(t)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(rows(batches), _SPAN)

    return run


def with_chunks(docs: DataFrame, cut: Callable[[str], list], id_col: str = "id", text_col: str = "content", counter: str = "approx", name: str = "fixed") -> DataFrame:
    """One row per chunk: document_id, position, content, start_char, end_char, token_count, checksum, chunk_id, chunker."""
    if getattr(cut, "levels", False):
        return _with_levels(docs, cut, id_col, text_col, counter).withColumn("chunker", F.lit(name))
    texts = docs.select(F.col(id_col).cast("string"), F.col(text_col))
    rows = texts.mapInArrow(_spans_of(cut, counter), "document_id string, position int, content string, start_char int, end_char int, _n int")
    return _identified(rows, counter).withColumn("chunker", F.lit(name))


def _identified(rows: DataFrame, counter: str) -> DataFrame:
    rows = rows.withColumn("token_count", F.coalesce("_n", TOKEN_COUNTERS[counter](F.col("content")))).drop("_n").withColumn("checksum", checksum(F.col("content")))
    return rows.withColumn("chunk_id", chunk_id(F.col("document_id"), F.col("position"), F.col("checksum")))


def hierarchical_spans(text: str, parent_size: int, child_size: int, overlap: int, count: Callable[[str], int]) -> list[tuple[Range, list[Range]]]:
    """Each parent's span with those of its children."""
    words, total = _words(text, count)
    span = lambda a, b: (words[a][0], words[b - 1][1])
    return [(span(a, b), [span(*w) for w in _windows(total, a, b, child_size, overlap)]) for a, b in _windows(total, 0, len(words), parent_size, 0)]


@chunkers.plugin("hierarchical")
def hierarchical(parent_size: int = 2048, chunk_size: int = 512, overlap: int = 64, counter: str = "approx"):
    _check(0 <= overlap < chunk_size < parent_size, "sizes must be parent > child > overlap")
    count = COUNTERS[counter]

    def cut(text: str) -> list[tuple[Range, list[Range]]]:
        return hierarchical_spans(text, parent_size, chunk_size, overlap, count)

    cut.levels = True
    return cut


_PART = {"position": "int", "content": "string", "start_char": "int", "end_char": "int", "chunk_level": "string", "parent_index": "int", "child_count": "int", "_n": "int"}
_PARTS = pa.list_(pa.struct([(k, pa.string() if t == "string" else pa.int32()) for k, t in _PART.items()]))


def _levels_of(cut: Callable[[str], list[tuple[Range, list[Range]]]], counter: str):
    """A row for each parent: itself, then its children. Children take the first positions of a document, parents the ones after."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for i, t in _texts(batches):
            found = cut(t)
            at, total, tokens = 0, sum(len(kids) for _, kids in found), _counter_of(t, counter)
            for k, ((a, b), kids) in enumerate(found):
                own = [(total + k, t[a:b], a, b, "parent", k, len(kids), tokens(a, b)), *((at + j, t[s:e], s, e, "child", k, None, tokens(s, e)) for j, (s, e) in enumerate(kids))]
                at += len(kids)
                yield sum(p[3] - p[2] for p in own), i, own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(rows(batches), pa.schema([("document_id", pa.string()), ("_all", _PARTS)]))

    return run


def _with_levels(docs: DataFrame, cut: Callable[[str], list], id_col: str, text_col: str, counter: str) -> DataFrame:
    """A child's parent_id is made in its parent's row, once for all children: nothing is joined."""
    texts = docs.select(F.col(id_col).cast("string"), F.col(text_col))
    rows = texts.mapInArrow(_levels_of(cut, counter), f"document_id string, _all array<struct<{', '.join(f'{k}: {t}' for k, t in _PART.items())}>>")
    first = F.col("_all")[0]
    rows = rows.select("document_id", chunk_id(F.col("document_id"), first["position"], checksum(first["content"])).alias("_parent"), F.explode("_all").alias("_s"))
    child = F.when(F.col("_s.chunk_level") == "child", F.col("_parent")).alias("parent_id")
    return _identified(rows.select("document_id", *[F.col(f"_s.{k}").alias(k) for k in _PART], child), counter)


def hierarchical_chunks(docs: DataFrame, parent_size: int = 2048, child_size: int = 512, overlap: int = 64, id_col: str = "id", text_col: str = "content", counter: str = "approx") -> DataFrame:
    """Both levels as rows: those of ``with_chunks`` with chunk_level, parent_index, child_count and a child's parent_id."""
    return _with_levels(docs, hierarchical(parent_size, child_size, overlap, counter), id_col, text_col, counter)
