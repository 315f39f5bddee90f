"""Settings: defaults, then a YAML file with ``${VAR}``, then environment variables, then arguments; checked once."""

from __future__ import annotations

import copy
import dataclasses
import logging
import os
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from .errors import ConfigurationError
from .registry import chunkers, embedders, fusions, rerankers, retrievers

ENV_PREFIX = "SIEVELINE_"
FILE_NAMES = ("sieveline.yaml", "sieveline.yml")
_VAR = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?:(:?-)([^}]*))?\}")
SECRET = re.compile(r"(?i)password|secret|token|api_?key|authorization")


@dataclass
class StoreSettings:
    path: str = "./knowledge"
    buckets: int = 16  # of a new store: about one a few gigabytes of documents


@dataclass
class EmbeddingSettings:
    provider: str = "hash"
    model: str | None = None  # the provider's usual one
    dimensions: int = 384
    batch_size: int = 256
    api_key: str | None = None


@dataclass
class ChunkingSettings:
    strategy: str = "fixed"
    chunk_size: int = 512
    overlap: int = 64
    overlap_sentences: int = 1
    breakpoint_percentile: float = 0.95
    buffer_size: int = 1
    max_chunk_size: int = 1024
    min_sentences: int = 1
    parent_size: int = 2048


@dataclass
class LexicalSettings:
    k1: float = 1.2
    b: float = 0.75
    analyzer: str = "simple"


@dataclass
class HybridSettings:
    dense: float = 0.65
    bm25: float = 0.35
    fusion: str = "rrf"
    rrf_k: int = 60
    multiplier: int = 3
    components: list[str] = field(default_factory=lambda: ["dense", "bm25"])


@dataclass
class RetrievalSettings:
    default: str = "dense"
    top_k: int = 10


@dataclass
class RerankingSettings:
    enabled: bool = False
    strategy: str = "none"
    top_n: int = 50
    batch_size: int = 32
    max_length: int = 512


@dataclass
class LoggingSettings:
    level: str = "WARNING"
    json: bool = False


@dataclass
class Settings:
    store: StoreSettings = field(default_factory=StoreSettings)
    embedding: EmbeddingSettings = field(default_factory=EmbeddingSettings)
    chunking: ChunkingSettings = field(default_factory=ChunkingSettings)
    lexical: LexicalSettings = field(default_factory=LexicalSettings)
    hybrid: HybridSettings = field(default_factory=HybridSettings)
    retrieval: RetrievalSettings = field(default_factory=RetrievalSettings)
    reranking: RerankingSettings = field(default_factory=RerankingSettings)
    logging: LoggingSettings = field(default_factory=LoggingSettings)


def interpolate(value: Any, env: dict[str, str] | None = None) -> Any:
    """``${A}`` must be set; ``${A-x}`` gives x if unset, ``${A:-x}`` also if empty."""
    env = os.environ if env is None else env
    if isinstance(value, dict):
        return {k: interpolate(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [interpolate(v, env) for v in value]
    if not isinstance(value, str):
        return value

    def one(m: re.Match) -> str:
        name, kind, default = m.groups()
        got = env.get(name)
        if got is None or kind == ":-" and not got:
            if kind is None:
                raise ConfigurationError(f"environment variable {name} is not set")
            return default
        return got

    return _VAR.sub(one, value)


def find_config(start: str | None = None) -> Path | None:
    """The path in the environment, else the nearest file from here up."""
    if given := os.environ.get(ENV_PREFIX + "CONFIG"):
        return Path(given)
    here = Path(start or os.getcwd()).resolve()
    return next((p / n for p in (here, *here.parents) for n in FILE_NAMES if (p / n).is_file()), None)


def _cast(kind: Any, value: Any, name: str) -> Any:
    try:
        if kind in ("bool", bool) and isinstance(value, str):
            return {"true": True, "1": True, "false": False, "0": False}[value.lower()]
        if kind in ("int", int):
            return int(value)
        if kind in ("float", float):
            return float(value)
    except (KeyError, TypeError, ValueError):
        raise ConfigurationError(f"{name}: {value!r} is not of kind {kind}") from None
    return value.split(",") if kind == "list[str]" and isinstance(value, str) else value


def load_settings(path: str | None = None, overrides: dict[str, dict] | None = None, env: dict[str, str] | None = None) -> Settings:
    import yaml

    env = dict(os.environ) if env is None else env
    file = Path(path) if path else find_config()
    tree: dict[str, dict] = {}
    if file is not None:
        if not file.is_file():
            raise ConfigurationError(f"no config file {file}")
        tree = interpolate(yaml.safe_load(file.read_text("utf-8")) or {}, env)
        if not isinstance(tree, dict):
            raise ConfigurationError(f"{file} must hold sections")
    from_env: dict[str, dict] = {}
    for k, v in env.items():
        if k.startswith(ENV_PREFIX) and "__" in k:
            section, _, name = k[len(ENV_PREFIX) :].lower().partition("__")
            from_env.setdefault(section, {})[name] = v
    return merged(Settings(), tree, from_env, overrides or {})


def merged(base: Settings, *layers: dict[str, dict]) -> Settings:
    """A copy of the settings with layers of sections over it, later ones first, checked."""
    s = copy.deepcopy(base)
    for layer in layers:
        for section, values in layer.items():
            if not hasattr(s, section) or not isinstance(values, dict):
                raise ConfigurationError(f"unknown section {section}")
            part = getattr(s, section)
            kinds = {f.name: f.type for f in dataclasses.fields(part)}
            for name, v in values.items():
                if name not in kinds:
                    raise ConfigurationError(f"unknown setting {section}.{name}")
                setattr(part, name, _cast(kinds[name], v, f"{section}.{name}"))
    check(s)
    return s


def check(s: Settings) -> None:
    c, h = s.chunking, s.hybrid
    for ok, why in (
        (c.chunk_size >= 16, "chunking.chunk_size is at least 16"),
        (0 <= c.overlap < c.chunk_size, "chunking.overlap is below chunk_size"),
        (c.parent_size > c.chunk_size, "chunking.parent_size is above chunk_size"),
        (0 < c.breakpoint_percentile < 1, "chunking.breakpoint_percentile is between 0 and 1"),
        (0 <= s.lexical.k1 <= 10 and 0 <= s.lexical.b <= 1, "lexical.k1 is 0 to 10, lexical.b 0 to 1"),
        (h.dense >= 0 and h.bm25 >= 0 and h.dense + h.bm25 > 0, "hybrid weights are not negative and not both 0"),
        (1 <= h.multiplier <= 20 and h.rrf_k >= 1, "hybrid.multiplier is 1 to 20, rrf_k at least 1"),
        (len(set(h.components)) == len(h.components) and "hybrid" not in h.components, "hybrid.components are distinct and not hybrid"),
        (1 <= s.retrieval.top_k <= 1000, "retrieval.top_k is 1 to 1000"),
        (s.store.buckets >= 1, "store.buckets is at least 1"),
        (2 <= s.embedding.dimensions <= 16000, "embedding.dimensions is 2 to 16000"),
        (s.logging.level.upper() in logging.getLevelNamesMapping(), "logging.level is a name that Python's logging knows"),
    ):
        if not ok:
            raise ConfigurationError(why)
    for registry, name in ((embedders, s.embedding.provider), (fusions, h.fusion), (rerankers, s.reranking.strategy)):
        registry.get(name)
    chunkers.get(c.strategy)
    for name in (*h.components, *([s.retrieval.default] if s.retrieval.default != "hybrid" else [])):
        retrievers.get(name)


def redacted(values: dict[str, Any]) -> dict[str, Any]:
    """For logs: what is named like a secret is hidden."""
    return {k: redacted(v) if isinstance(v, dict) else "***" if v and SECRET.search(k) else v for k, v in values.items()}
