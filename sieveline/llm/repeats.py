"""Operator 2: suffix-array dedup of every byte in a repeated 100-byte string.

A byte goes if some 100-byte string over it also starts earlier (smaller doc_id,
or earlier in the same document); strings are judged on the input. No suffix
array of the whole corpus is built: strings that can't be equal never meet.

1. Documents are grouped into blocks by hash. Each 100-byte window is owned by
   its minimizer, the least hash among its 32-byte substrings, so equal windows
   have equal minimizers. A run of windows with one owner is a segment. A block
   sends its distinct segments, about one in 35 bytes, in packed arrays twice: by
   segment, and, one entry a minimizer however many segments it has there, by
   minimizer.
2. The shard of a segment tells those that are equal to an earlier one: all their
   windows go. The shard of a minimizer tells whether it has different segments,
   as at borders of passages: then the first of each kind is contested. So a
   segment or minimizer with a third of all text meets as one entry a block.
3. Contested segments are cut into classes of windows by where the minimizer
   lies, and their bytes go to the shard of what all windows of a class share
   (66 bytes or more). A minimizer of more than ``HOT_KINDS`` kinds is cut into
   narrow classes of three windows, which share 98 bytes: two bytes are left to
   differ, so the pieces of a context are bounded however many documents have
   the passage, and spread over all shards. Each shard collapses equal pieces,
   and of those that share a context with another it builds a suffix array by
   induced sorting and the permuted common prefixes; neighbours in the array with
   a common prefix of 100 are equal windows, of which all but the first go.
4. Blocks take the verdicts together and cut the texts.

Copies never multiply: equal segments collapse in the block before anything is
sent, and nothing lists pairs. Segments are compared by 96 bits of hash.

Defined cases: null and empty texts and texts under 100 bytes lose nothing;
rows with one doc_id are ordered by text, equal rows in any order, a null
doc_id comes last; an empty table gives an empty table; further columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_table, plan_bytes, shuffle_parts
from .suffix_array import permuted_lcp, suffix_array

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1  # grams in a window
CLASSES = ((0, 34), (34, SPAN))  # windows by the minimizer's offset
NARROW = tuple((lo, min(SPAN, lo + 3)) for lo in range(0, SPAN, 3))
PIECE = 1 << 18
HOT_KINDS = 1000
#: bytes of input, at most, that a block holds and that a shard answers for
BLOCK_BYTES, SHARD_BYTES = 64 << 20, 128 << 20
NO_ID = np.iinfo(np.int64).max
_U = np.uint64
_C = [_U(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_BASE = 0xA24BAED4963EE407


def _powers() -> tuple[np.ndarray, np.ndarray]:
    size = PIECE + 2 * LENGTH
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.ones(size, np.uint64)
        p[1:] = _U(b)
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_POW: list = []


def _grams(buf: np.ndarray) -> np.ndarray:
    """64-bit hash of each 32-byte substring."""
    n = len(buf) - GRAM + 1
    words = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,)).copy()
    h = words[:n] * _C[0]
    for k in (1, 2, 3):
        h ^= h >> _U(29)
        h += words[8 * k : 8 * k + n]
        h *= _C[k]
    h ^= h >> _U(32)
    h *= _C[4]
    h ^= h >> _U(29)
    return h


def runs_of(data: np.ndarray, offsets: np.ndarray):
    """Segments of concatenated documents: (first window, one past the last, minimizer's position, its hash, segment hash)."""
    if not _POW:
        _POW.extend(_powers())
    power, inverse = _POW
    n = len(data)
    blocked = np.zeros(n + 1, np.int32)  # windows that would leave their document
    lows = np.maximum(offsets[:-1], offsets[1:] - LENGTH + 1)
    np.add.at(blocked, lows, 1)
    np.add.at(blocked, offsets[1:], -1)
    bad = np.cumsum(blocked[:-1]) > 0
    out = []
    for a in range(0, max(0, n - LENGTH + 1), PIECE):
        b = min(n - LENGTH + 1, a + PIECE)  # window starts a..b
        h = _grams(data[a : b + LENGTH - 1])
        key = (h >> _U(20) << _U(20)) | np.arange(len(h), dtype=np.uint64)
        m, w = key, 1
        while 2 * w <= SPAN:
            m = np.minimum(m[: len(m) - w], m[w:])
            w *= 2
        m = np.minimum(m[: b - a], m[SPAN - w : SPAN - w + b - a])
        own = (m & _U((1 << 20) - 1)).astype(np.int64)
        own[bad[a:b]] = -1
        cut = np.flatnonzero(own[1:] != own[:-1]) + 1
        s = np.concatenate([[0], cut])
        e = np.concatenate([cut, [b - a]])
        good = own[s] >= 0
        s, e = s[good], e[good]
        if len(s):
            p = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(h * power[: len(h)], out=p[1:])
            seg = (p[e + SPAN - 1] - p[s]) * inverse[s]
            seg ^= (e - s).astype(np.uint64) * _C[0]
            out.append((s + a, e + a, own[s] + a, h[own[s]], seg))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


class Block:
    """The documents of one block in order, as one array of bytes, and its segments."""

    def __init__(self, table: pa.Table):
        ids, texts = table.column("id").to_pylist(), table.column("text").cast(pa.binary()).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (NO_ID if ids[i] is None else ids[i], texts[i]))
        self.ids = [ids[i] for i in order]
        self.keys = np.array([NO_ID if ids[i] is None else ids[i] for i in order], np.int64)
        self.texts = [texts[i] for i in order]
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in self.texts])]).astype(np.int64)
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        self.start, self.end, self.at, self.gram, self.seg = runs_of(self.data, self.offsets)
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1
        # Runs are in order, so the first of each equal pair is the earliest.
        rank = np.lexsort((np.arange(len(self.seg)), self.seg, self.gram))
        g, s = self.gram[rank], self.seg[rank]
        new = np.ones(len(rank), bool)
        new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
        self.first = np.zeros(len(rank), bool)
        self.first[rank[new]] = True

    def keys_of(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits that stand for a segment and its minimizer."""
        a = (self.seg[runs] ^ (self.gram[runs] >> _U(23))) * _C[2] + self.gram[runs]
        b = (self.gram[runs] ^ (self.seg[runs] >> _U(31))) * _C[3] + self.seg[runs]
        return (a ^ (a >> _U(29))) * _C[4], (b >> _U(32)).astype(np.uint32)

    def minimizers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each minimizer, its kinds of segments here, the segment if there is one kind, and of each first segment the minimizer's place."""
        runs = np.flatnonzero(self.first)
        grams, place, kinds = np.unique(self.gram[runs], return_inverse=True, return_counts=True)
        seg = np.zeros(len(grams), np.uint64)
        seg[place] = self.seg[runs]
        seg[kinds > 1] = 0
        return grams, kinds, seg, place


def _pack(*arrays: np.ndarray) -> bytes:
    return np.int64(len(arrays[0])).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _unpack(raw: bytes, *types) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def _gather(table: pa.Table, *types) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows' block ids, one an entry, and their packed arrays end to end."""
    parts = [_unpack(x, *types) for x in table.column("payload").to_pylist()]
    block = np.repeat(np.array(table.column("block").to_pylist(), np.int64), [len(p[0]) for p in parts])
    return block, [np.concatenate(x) for x in zip(*parts)]


def _rows(name: str, keys: np.ndarray, block, *arrays: np.ndarray) -> pa.Table:
    """One row per key: (key, block, payload); block: one for all, or one an entry, then rows are per block and block is the key."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    cuts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]]) if len(k) else np.zeros(1, np.int64)
    out_k, payload = [], []
    for s, e in zip(cuts[:-1], cuts[1:]):
        out_k.append(int(k[s]))
        payload.append(_pack(*[a[order[s:e]] for a in arrays]))
    cols = {name: pa.array(out_k, pa.int64())}
    if name != "block":
        cols["block"] = pa.array([block] * len(out_k), pa.int64())
    return pa.table(cols | {"payload": pa.array(payload, pa.binary())})


_SENT = "shard bigint, by string, block bigint, payload binary"
_TOLD = "block bigint, by string, payload binary"
SEGMENT, MINIMIZER, PIECE_OF = "segment", "minimizer", "piece"


def _tagged(rows: pa.Table, by: str) -> pa.Table:
    names = rows.column_names
    return pa.table([rows.column(0), pa.array([by] * rows.num_rows, pa.string()), *rows.columns[1:]], [names[0], "by", *names[1:]])


def _announce(shards: int):
    def run(table: pa.Table) -> pa.Table:
        b, block = Block(table), table.column("block")[0].as_py()
        r = np.flatnonzero(b.first)
        x, y = b.keys_of(r)
        own = _rows("shard", ((x >> _U(7)) % _U(shards)).astype(np.int64), block, x, y, b.keys[b.doc[r]], r.astype(np.uint32))
        grams, kinds, seg, _ = b.minimizers()
        every = _rows("shard", ((grams >> _U(7)) % _U(shards)).astype(np.int64), block, grams, seg, np.minimum(kinds, 65535).astype(np.uint16), np.arange(len(grams), dtype=np.uint32))
        return pa.concat_tables([_tagged(own, SEGMENT), _tagged(every, MINIMIZER)])

    return run


CONTESTED, HOT = 1, 2


def _answer(hot: int):
    def run(table: pa.Table) -> pa.Table:
        by = table.column("by")[0].as_py()
        return _tagged(_earlier(table) if by == SEGMENT else _differing(table, hot), by)

    return run


def _earlier(table: pa.Table) -> pa.Table:
    """(block, packed run) of each segment that is equal to an earlier one."""
    block, (x, y, doc, run) = _gather(table, np.uint64, np.uint32, np.int64, np.uint32)
    order = np.lexsort((run, block, doc, y, x))
    again = np.zeros(len(order), bool)
    again[1:] = (x[order][1:] == x[order][:-1]) & (y[order][1:] == y[order][:-1])
    at = order[again]
    return _rows("block", block[at], None, run[at])


def _differing(table: pa.Table, hot: int) -> pa.Table:
    """(block, packed place and verdict) of each minimizer with different segments; hot if it has more than ``hot`` a block summed up."""
    block, (gram, seg, kinds, place) = _gather(table, np.uint64, np.uint64, np.uint16, np.uint32)
    order = np.argsort(gram, kind="stable")
    g, s, n = gram[order], seg[order], kinds[order].astype(np.int64)
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    group = np.cumsum(new) - 1
    other = np.zeros(len(g), bool)
    other[1:] = ~new[1:] & (s[1:] != s[:-1])
    total = np.bincount(group, n)
    differ = np.bincount(group, other | (n > 1)) > 0
    verdict = np.where(differ, np.where(total > hot, HOT, CONTESTED), 0)[group].astype(np.uint8)
    told = verdict > 0
    at = order[told]
    return _rows("block", block[at], None, place[at], verdict[told])


def _split_told(told: pa.Table) -> dict[str, list[bytes]]:
    out: dict[str, list[bytes]] = {SEGMENT: [], MINIMIZER: [], PIECE_OF: []}
    for by, raw in zip(told.column("by").to_pylist(), told.column("payload").to_pylist()):
        out[by].append(raw)
    return out


def _contest(shards: int):
    """The bytes of contested segments, by class and shared context."""

    def run(key, docs: pa.Table, told: pa.Table) -> pa.Table:
        rows: list[tuple[int, bytes]] = []
        said = _split_told(told)
        if docs.num_rows and said[MINIMIZER]:
            b = Block(docs)
            runs, place = np.flatnonzero(b.first), b.minimizers()[3]
            verdict = np.zeros(int(place.max()) + 1, np.uint8)
            for raw in said[MINIMIZER]:
                at, v = _unpack(raw, np.uint32, np.uint8)
                verdict[at] = v
            verdict = verdict[place]
            gone = np.zeros(len(b.first), bool)
            for raw in said[SEGMENT]:
                gone[_unpack(raw, np.uint32)[0]] = True
            verdict[gone[runs]] = 0
            for v, classes in ((CONTESTED, CLASSES), (HOT, NARROW)):
                if len(r := runs[verdict == v]):
                    rows += _pieces(b, r, shards, classes)
        block = docs.column("block")[0].as_py() if docs.num_rows else 0
        cols = [*zip(*rows)] or [(), ()]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array([PIECE_OF] * len(rows), pa.string()), pa.array([block] * len(rows), pa.int64()), pa.array(cols[1], pa.binary())], ["shard", "by", "block", "payload"])

    return run


def _pieces(b: Block, runs: np.ndarray, shards: int, classes) -> list[tuple[int, bytes]]:
    data = b.data
    power = np.multiply.accumulate(np.full(LENGTH, _U(_BASE), np.uint64))
    out = []
    for c, (lo, hi) in enumerate(classes):
        # Windows from start to stop have the minimizer lo to hi-1 bytes in.
        start = np.maximum(b.start[runs], b.at[runs] - hi + 1)
        stop = np.minimum(b.end[runs], b.at[runs] - lo + 1)
        has = start < stop
        if not has.any():
            continue
        r, s, e, p = runs[has], start[has], stop[has], b.at[runs][has]
        width = LENGTH - (hi - 1 - lo)
        shared = data[(p - lo)[:, None] + np.arange(width)[None, :]].astype(np.uint64)
        ctx = ((shared + _U(1)) * power[:width]).sum(axis=1, dtype=np.uint64)
        ctx ^= ctx >> _U(31)
        ctx = (ctx * _C[1]) ^ b.gram[r] ^ _U(c + len(classes))
        out.append((ctx, b.keys[b.doc[r]], r, s, e))
    ctx, doc, r, s, e = (np.concatenate(x) for x in zip(*out))
    rows = []
    for shard, at in _split(((ctx >> _U(9)) % _U(shards)).astype(np.int64)):
        text = b"".join([data[x : y + LENGTH - 1].tobytes() for x, y in zip(s[at].tolist(), e[at].tolist())])
        rows.append((shard, _pack(ctx[at], doc[at], r[at].astype(np.uint32), (s[at] - b.start[r[at]]).astype(np.uint8), (e[at] - s[at]).astype(np.uint8)) + text))
    return rows


def _split(shard: np.ndarray):
    """(shard, indices) of each shard that occurs."""
    order = np.argsort(shard, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        yield int(shard[at[0]]), at


_PIECE_TYPES = (np.uint64, np.int64, np.uint32, np.uint8, np.uint8)
_HEAD = sum(np.dtype(t).itemsize for t in _PIECE_TYPES)


def _settle(table: pa.Table) -> pa.Table:
    """(block, packed run, first window, windows) of repeats among the pieces of one shard."""
    raws = table.column("payload").to_pylist()
    block, (ctx, doc, run, off, wins) = _gather(table, *_PIECE_TYPES)
    texts: list[bytes] = []
    for raw in raws:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        w = _unpack(raw, *_PIECE_TYPES)[4]
        at = 8 + n * _HEAD
        for k in w.tolist():
            texts.append(raw[at : at + k + LENGTH - 1])
            at += k + LENGTH - 1
    order = np.lexsort((off, run, block, doc, ctx))
    cuts = np.flatnonzero(np.diff(ctx[order])) + 1
    gone: list[tuple[int, int, int]] = []  # piece, first window, windows
    pieces: list[int] = []
    for group in np.split(order, cuts):
        if len(group) > 1:
            seen: dict[bytes, int] = {}
            for i in group.tolist():
                if seen.setdefault(texts[i], i) != i:
                    gone.append((i, 0, int(wins[i])))
            if len(seen) > 1:
                pieces += seen.values()
    if pieces:
        gone += _equal_windows([texts[i] for i in pieces], np.array(pieces), wins, doc, block, run, off)
    if not gone:
        return _tagged(_rows("block", np.zeros(0, np.int64), None), PIECE_OF)
    i, w, n = (np.array(x) for x in zip(*gone))
    return _tagged(_rows("block", block[i], None, run[i], (off[i] + w).astype(np.uint8), n.astype(np.uint8)), PIECE_OF)


def _equal_windows(texts, piece, wins, doc, block, run, off) -> list[tuple[int, int, int]]:
    """Repeated windows by suffix array: all but the earliest of each class of equal ones."""
    size = np.array([len(t) for t in texts])
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    raw = np.frombuffer(b"\0".join(texts) + b"\0\0", np.uint8)
    t = raw + np.uint8(2) if len(raw) and raw.max() < 254 else raw.astype(np.uint16) + np.uint16(2)  # UTF-8 has no byte from 254 on
    t[begin + size] = 1  # a separator, then the sentinel
    t[-1] = 0
    sa = suffix_array(t)
    plcp = permuted_lcp(t, sa, LENGTH)
    w = wins[piece].astype(np.int64)
    starts = np.repeat(begin - np.concatenate([[0], np.cumsum(w)[:-1]]), w) + np.arange(w.sum())
    owner = np.full(len(t), -1, np.int64)
    owner[starts] = np.repeat(np.arange(len(piece)), w)
    # Classes in the array: a common prefix below the length starts a new one; suffixes that aren't windows have none of it.
    cls = np.cumsum(plcp[sa] < LENGTH)
    at = sa[owner[sa] >= 0]
    cls = cls[owner[sa] >= 0]
    p = piece[owner[at]]
    k = at - begin[owner[at]]
    order = np.lexsort((off[p] + k, run[p], block[p], doc[p], cls))
    again = np.zeros(len(order), bool)
    again[1:] = cls[order][1:] == cls[order][:-1]
    found = order[again]
    return list(zip(p[found].tolist(), k[found].tolist(), [1] * len(found)))


def _cut(key, docs: pa.Table, told: pa.Table) -> pa.Table:
    """The removed bytes and digest of each document of a block."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    types = [pa.int64()] * 4 + [pa.string()]
    if not docs.num_rows:
        return pa.table([pa.array([], t) for t in types], names)
    b = Block(docs)
    edge = np.zeros(len(b.data) + 1, np.int32)
    whole = ~b.first
    said = _split_told(told)
    for raw in said[PIECE_OF]:
        r, w, n = (x.astype(np.int64) for x in _unpack(raw, np.uint32, np.uint8, np.uint8))
        np.add.at(edge, b.start[r] + w, 1)
        np.add.at(edge, b.start[r] + w + n + LENGTH - 1, -1)
    for raw in said[SEGMENT]:
        whole[_unpack(raw, np.uint32)[0]] = True
    r = np.flatnonzero(whole)
    np.add.at(edge, b.start[r], 1)
    np.add.at(edge, b.end[r] + LENGTH - 1, -1)
    gone = np.cumsum(edge[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(gone)])
    rise = gone.copy()
    rise[1:] &= ~gone[:-1]
    inner = b.offsets[(b.offsets > 0) & (b.offsets < len(gone))]
    rise[inner] = gone[inner]
    spans = np.concatenate([[0], np.cumsum(rise)])
    o = b.offsets
    removed, n_spans = total[o[1:]] - total[o[:-1]], spans[o[1:]] - spans[o[:-1]]
    digest = []
    for i, text in enumerate(b.texts):
        kept = text if not removed[i] else b.data[o[i] : o[i + 1]][~gone[o[i] : o[i + 1]]].tobytes()
        digest.append(hashlib.sha256(kept).hexdigest())
    return pa.table([pa.array(x, t) for x, t in zip((b.ids, np.diff(o), removed, n_spans, digest), types)], names)


def repeats(docs: DataFrame, blocks: int | None = None, shards: int | None = None, hot: int = HOT_KINDS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per input row.

    blocks and shards follow ``spark.sql.shuffle.partitions`` (4 and 2 a
    partition) and the input's size (``BLOCK_BYTES``, ``SHARD_BYTES``) unless given;
    they decide sizes of tasks, never results.
    """
    parts, size = shuffle_parts(docs.sparkSession), plan_bytes(docs)
    blocks, shards = blocks or max(4 * parts, -(-size // BLOCK_BYTES)), shards or max(2 * parts, -(-size // SHARD_BYTES))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), text.alias("text"))
    rows = rows.select("id", "text", F.pmod(F.xxhash64(F.coalesce("id", F.xxhash64("text"))), F.lit(blocks)).alias("block"))
    grouped = lambda: rows.groupBy("block")
    said = grouped().applyInArrow(_announce(shards), _SENT)
    told = said.groupBy("shard", "by").applyInArrow(_answer(hot), _TOLD)
    sent = grouped().cogroup(told.groupBy("block")).applyInArrow(_contest(shards), _SENT)
    settled = sent.groupBy("shard").applyInArrow(_settle, _TOLD)
    both = told.filter(F.col("by") == SEGMENT).unionByName(settled)
    return grouped().cogroup(both.groupBy("block")).applyInArrow(_cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def query(spark, sf_dir):
    return repeats(docs_table(spark, sf_dir))


def sql(table: str = "documents") -> str:
    """The same rows in DuckDB, from every window's text in hexadecimal."""
    return f"""
    WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM {table}),
    w AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) AS s FROM (SELECT doc_id, h, unnest(range(0, n - {LENGTH - 1})) AS i FROM t))),
    d AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH}, TRUE) AS fresh FROM w WHERE k > 1),
    g AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM d),
    r AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM g GROUP BY doc_id, g),
    e AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a FROM (SELECT doc_id, a, b FROM r UNION ALL SELECT doc_id, n, n FROM t)),
    p AS (SELECT doc_id, string_agg(substr(h, 2 * f + 1, 2 * (e.a - f)), '' ORDER BY f) AS kept FROM e JOIN t USING (doc_id) GROUP BY doc_id),
    c AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
    SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM t JOIN p USING (doc_id) LEFT JOIN c USING (doc_id)"""
