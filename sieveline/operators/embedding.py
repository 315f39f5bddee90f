"""Embedders: a registry of ``texts -> matrix`` models run in Arrow batches, and vector expressions."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import DimensionMismatchError, EmbeddingError, ProviderUnavailableError
from ..registry import embedders
from ..retry import retry

_WORD = re.compile(r"\w+")
#: USD per million tokens of remote models; local models cost nothing.
#: model of a provider where none is named
MODELS = {"hash": "hash-v1", "sentence_transformers": "all-MiniLM-L6-v2", "openai": "text-embedding-3-small"}
PRICES = {"openai:text-embedding-3-small": 0.02, "openai:text-embedding-3-large": 0.13, "openai:text-embedding-ada-002": 0.10}


def l2_normalize(v: Column) -> Column:
    """A zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def cosine_similarity(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def neighbour_distances(m: np.ndarray) -> list[float]:
    """1 - cosine of each row and the next; 1 where either is zero. Every product is a dot product of two vectors, so that equal rows differ in no bit."""
    dot = lambda a, b: np.matmul(a[:, None, :], b[:, :, None])[:, 0, 0]
    norm = np.sqrt(dot(m, m))
    size = norm[:-1] * norm[1:]
    return (1.0 - np.divide(dot(m[:-1], m[1:]), size, out=np.zeros(len(size)), where=size > 0)).tolist()


#: words that a worker remembers; hashed features in memory together
KNOWN_WORDS, FEATURES = 250_000, 1 << 18
#: texts taken out of Arrow together
TEXTS = 256


class _Made(dict):
    """Makes what it doesn't have."""

    def __init__(self, make: Callable[[str], int]):
        self.make = make

    def __missing__(self, key: str) -> int:
        n = self[key] = self.make(key)
        return n


_WEIGHTS = np.array([1.0, -1.0, 0.35, -0.35])


class Hashing:
    """Words and character n-grams hashed with a sign into ``dimensions``.

    The features of known words lie in one flat array, so a text is gathered from
    it as a whole and summed up, feature by feature, in the order of its words.
    """

    provider, model = "hash", "hash-v1"
    _shared: dict[int, Hashing] = {}

    def __init__(self, dimensions: int = 384, ngram: int = 3, **_):
        self.dimensions, self.ngram = dimensions, ngram
        self._forget()

    def _forget(self) -> None:
        self._known, self._grams = _Made(self._learn), _Made(lambda g: self._code("c:" + g, 2))
        self._codes, self._start = array("i"), array("q", [0])

    @classmethod
    def shared(cls, dimensions: int) -> Hashing:
        if dimensions not in cls._shared:
            cls._shared[dimensions] = cls(dimensions)
        return cls._shared[dimensions]

    def _code(self, feature: str, kind: int) -> int:
        """The slot and, in the last two bits, the place of its weight in ``_WEIGHTS``."""
        d = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest())
        return (d >> 32) % self.dimensions << 2 | kind | (not d >> 24 & 1)

    def _learn(self, w: str) -> int:
        codes, n = self._codes, self.ngram
        codes.append(self._code("w:" + w, 0))
        if len(w) > n:
            marked, grams = f"^{w}$", self._grams
            codes.extend([grams[marked[i : i + n]] for i in range(len(w) + 3 - n)])
        self._start.append(len(codes))
        return len(self._start) - 2

    def _features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(codes, features before each word and in all)."""
        ids = np.fromiter(map(self._known.__getitem__, words), np.int64, len(words))
        start = np.frombuffer(self._start, np.int64)
        at, ends = _ranges(start[ids], start[ids + 1])
        return np.frombuffer(self._codes, np.int32)[at], ends

    def embed(self, texts: list[str]) -> np.ndarray:
        return self.windows(texts, 0)

    def windows(self, parts: list[str], buffer: int) -> np.ndarray:
        """The vector of each part together with ``buffer`` ones on either side, as of their texts joined by spaces."""
        n = len(parts)
        out = np.zeros((n, self.dimensions))
        a = 0
        while a < n:  # parts a to b, and the buffer beside them, as far as their characters go
            left, b, size = max(0, a - buffer), a, 0
            while b < n and (b == a or size < FEATURES // 2):
                size += len(parts[b] or "") * (2 * buffer + 1)
                b += 1
            self._sum(parts[left : b + buffer], a - left, buffer, out[a:b])
            a = b
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    def _sum(self, parts: list[str], skip: int, buffer: int, out: np.ndarray) -> None:
        if len(self._known) > KNOWN_WORDS or len(self._grams) > KNOWN_WORDS or len(self._codes) > 20 * KNOWN_WORDS:
            self._forget()
        split = [_WORD.findall((t or "").lower()) for t in parts]
        codes, ends = self._features([w for words in split for w in words])
        ends = ends[np.cumsum([0, *map(len, split)])]  # features before each part
        i = np.arange(len(out)) + skip
        first, last = ends[np.maximum(0, i - buffer)], ends[np.minimum(len(parts), i + buffer + 1)]
        if buffer:
            codes = codes[_ranges(first, last)[0]]
        row = np.repeat(np.arange(len(out)) * self.dimensions, last - first)
        out[:] = np.bincount(row + (codes >> 2), _WEIGHTS[codes & 3], out.size).reshape(out.shape)


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The whole numbers from each first to before its last, one range after the other; how many come before each range, and in all."""
    ends = np.concatenate([[0], np.cumsum(last - first)])
    return np.arange(ends[-1]) + np.repeat(first - ends[:-1], last - first), ends


embedders.register("hash", Hashing)


class Passed:
    """A model given as a function ``texts -> vectors``, called with up to ``batch_size`` texts, again after a TransientError; its vectors are checked and scaled to length 1."""

    def __init__(self, provider: str, encode: Callable[[list[str]], object], dimensions: int, model: str | None = None, batch_size: int = 256):
        self.provider, self.model, self.dimensions, self.encode, self.batch_size = provider, model or MODELS.get(provider, provider), dimensions, encode, max(1, batch_size)

    def embed(self, texts: list[str]) -> np.ndarray:
        parts = [np.zeros((0, self.dimensions))]
        for a in range(0, len(texts), self.batch_size):
            some = [t or "" for t in texts[a : a + self.batch_size]]
            got = np.asarray(retry(lambda s=some: self.encode(s)), dtype=float)
            if got.ndim != 2 or len(got) != len(some):
                raise EmbeddingError(f"{self.provider} gave {len(got)} vectors for {len(some)} texts")
            if got.shape[1] != self.dimensions:
                raise DimensionMismatchError(self.dimensions, got.shape[1])
            parts.append(got)
        out = np.concatenate(parts)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


def _passed(provider: str, package: str):
    def make(dimensions: int = 384, encode: Callable[[list[str]], object] | None = None, model: str | None = None, batch_size: int = 256, **_):
        if encode is None:
            raise ProviderUnavailableError(f"{provider} needs a function texts -> vectors (encode=), as the package {package} isn't installed")
        return Passed(provider, encode, dimensions, model, batch_size)

    return make


embedders.register("sentence_transformers", _passed("sentence_transformers", "sentence-transformers"))
embedders.register("openai", _passed("openai", "openai"))


def embed(text: Column, provider: str = "hash", **options) -> Column:
    """array<double> per text; the model is built once per Python worker. options: dimensions, model, batch_size, encode."""
    embedders.create(provider, **options)  # what is missing is told here, not by a worker

    size = options.get("batch_size") or 256
    step = size * max(1, TEXTS // size)

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = embedders.create(provider, **options)
        for b in batches:
            out = np.zeros((len(b), model.dimensions))
            for at in range(0, len(b), step):  # the texts leave Arrow a few at a time
                m = model.embed(b.slice(at, step).to_pylist())
                if m.shape[1] != model.dimensions:
                    raise DimensionMismatchError(model.dimensions, m.shape[1])
                out[at : at + len(m)] = m
            yield pa.ListArray.from_arrays(np.arange(len(b) + 1, dtype=np.int32) * model.dimensions, out.ravel())

    return run(text)


def model_key(provider: str, model: str | None = None) -> str:
    """The name under which vectors are stored and searched."""
    return f"{provider}:{model or MODELS.get(provider, provider)}"
