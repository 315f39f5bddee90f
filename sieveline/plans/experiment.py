"""Configuration-driven sweeps: retrieval at the greatest depth once per strategy, every k judged from it, artefacts written once."""

from __future__ import annotations

import csv
import io
import json
import subprocess
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import merged
from ..errors import ConfigurationError
from ..functions.text import approx_tokens
from ..log import logger
from ..operators.embedding import PRICES, model_key
from ..operators.metrics import METRICS, evaluate, mean_by_run
from ..sources.datasets import QuerySet, load_query_set, resolve_labels, resolved
from .context import Context

#: sections that an experiment may set, and what in them names the sweep instead
OVERRIDES, AXES = ("chunking", "embedding", "hybrid", "lexical", "reranking", "retrieval"), ("strategies", "strategy", "default", "enabled", "models")
STAGES = ("total_ms", "embedding_ms", "retrieval_ms", "fusion_ms", "reranking_ms")
INDEX_TIME = {"chunking.strategies": "chunking strategy", "embedding.models": "embedding model"}


@dataclass
class Experiment:
    name: str
    dataset: str
    strategies: list[str] = field(default_factory=lambda: ["dense"])
    rerankers: list[str] = field(default_factory=lambda: ["off"])
    top_k: list[int] = field(default_factory=lambda: [10])
    hypothesis: str | None = None
    overrides: dict = field(default_factory=dict)

    @property
    def runs(self) -> int:
        return len(self.strategies) * len(self.rerankers) * len(self.top_k)


def _many(v) -> list:
    return [] if v is None else list(v) if isinstance(v, (list, tuple)) else [v]


def load_experiment(path: str) -> Experiment:
    import yaml

    p = Path(path)
    raw = yaml.safe_load(p.read_text("utf-8")) if p.is_file() else None
    if not isinstance(raw, dict):
        raise ConfigurationError(f"{path} must be a file with sections")
    for dotted, what in INDEX_TIME.items():
        section, key = dotted.split(".")
        if key in (raw.get(section) or {}):
            raise ConfigurationError(f"{dotted}: another {what} needs another index; run one experiment for each")
    ret, rer = raw.get("retrieval") or {}, raw.get("reranking") or {}
    off = lambda v: "off" if v is False or v is None else str(v)  # noqa: E731  YAML reads off as false
    rerankers = [off(v) for v in _many(rer.get("strategies"))] or [off(rer.get("strategy")) if rer.get("enabled") else "off"]
    dataset = (raw.get("dataset") or {}).get("path")
    if not dataset:
        raise ConfigurationError("dataset.path is missing")
    e = Experiment(str(raw.get("name") or p.stem), str(dataset), [str(v) for v in _many(ret.get("strategies") or ret.get("default"))] or ["dense"], rerankers, [int(v) for v in _many(raw.get("top_k"))] or [10], raw.get("hypothesis"))
    own = {s: {k: x for k, x in v.items() if k not in AXES} for s, v in raw.items() if s in OVERRIDES and isinstance(v, dict)}
    e.overrides = {s: v for s, v in own.items() if v}
    if len(set(e.strategies)) < len(e.strategies) or any(k < 1 for k in e.top_k):
        raise ConfigurationError("strategies are distinct and top_k positive")
    return e


def run_id(strategy: str, reranker: str, k: int) -> str:
    return f"{strategy}__rerank-{reranker}__k{k}"


def provenance() -> dict[str, str | bool]:
    git = lambda *a: subprocess.run(["git", *a], capture_output=True, text=True, check=False).stdout.strip()
    return {"commit": git("rev-parse", "HEAD"), "dirty": bool(git("status", "--porcelain"))}


def notes(dataset: QuerySet, provider: str, dirty: bool) -> list[str]:
    out = []
    if dataset.meta["kind"] != "curated":
        out.append("The query set is not curated: figures check the machinery, not quality.")
    if len(dataset.queries) < 50:
        out.append("Fewer than 50 queries: high latency percentiles mean little.")
    if provider == "hash":
        out.append("Hashed embeddings carry spelling, not meaning.")
    if dirty:
        out.append("The working tree had changes that no commit holds.")
    if not dataset.graded:
        out.append("Judgements are binary, so gains do not tell degrees.")
    return out


def cost_of(tokens: int | None, key: str) -> float | None:
    """USD; 0 for a local model, None if the price is unknown."""
    if key.startswith(("hash:", "sentence_transformers:")):
        return 0.0
    return round(tokens * PRICES[key] / 1e6, 8) if tokens is not None and key in PRICES else None


def run(context: Context, experiment: Experiment, dataset: QuerySet | None = None) -> dict:
    """All points of a sweep, under the settings with the experiment's own over them.

    Each strategy and reranker searches once, at the greatest depth, and every k is
    judged from those hits. Queries that fail have their error recorded and are left
    out of the means; a strategy without any answer has an error, and the others go on.
    """
    if experiment.overrides:
        context = Context(context.spark, merged(context.settings, experiment.overrides), context.encode)
    data = dataset or load_query_set(experiment.dataset)
    size = context.store.health()
    if not size["chunks"]:
        raise ConfigurationError("the index is empty; ingest first")
    queries, judged = data.tables(context.spark)
    docs = context.store.read("documents")
    names = list({k for q in data.queries for k in q["relevant"]})
    if data.granularity == "document":
        # Only documents that some label could name come to the driver.
        ends = list({n.rsplit("/", 1)[-1] for n in names})
        known = docs.select("id", "source_id").filter(F.regexp_extract("source_id", r"([^/]+)$", 1).isin(*ends))
        named = resolve_labels(names, [(r["id"], r["source_id"]) for r in known.collect()])
        labels = context.spark.createDataFrame([(d, n) for n, d in named.items()], "document_id string, label string")
    else:
        have = {r[0] for r in context.store.read("chunks").filter(F.col("chunk_id").isin(*names)).select("chunk_id").collect()}
        if set(names) - have:
            raise ConfigurationError(f"unknown chunks {sorted(set(names) - have)[:5]}")
        labels = None
    runs, deepest = [], max(experiment.top_k)
    tokens = queries.agg(F.coalesce(F.sum(approx_tokens(F.col("text"))), F.lit(0)).alias("n")).first()["n"]
    key = model_key(context.settings.embedding.provider, context.settings.embedding.model)
    for strategy in experiment.strategies:
        embeds = strategy == "dense" or strategy == "hybrid" and "dense" in context.settings.hybrid.components
        for reranker in experiment.rerankers:
            hits, failed, timing = found(context, queries, strategy, deepest, reranker)
            for k in experiment.top_k:
                point = {"run_id": run_id(strategy, reranker, k), "strategy": strategy, "reranker": reranker, "k": k, "error": None, "metrics": {}, "failed_queries": failed}
                point |= {"latency": {s: summary([v]) for s, v in timing.items() if v or s == "total_ms"}, "query_tokens": tokens if embeds else 0, "cost_usd": cost_of(tokens, key) if embeds else 0.0}
                if hits is None:
                    point["error"] = next(iter(failed.values()), "no query")
                else:
                    keyed = resolved(hits, labels) if labels is not None else hits.withColumn("key", F.col("chunk_id"))
                    errors = context.spark.createDataFrame(list(failed.items()), "query_id string, error string")
                    rows = evaluate(keyed.select("query_id", "key", "rank"), judged, (k,)).withColumn("run_id", F.lit(point["run_id"])).join(F.broadcast(errors), "query_id", "left")
                    for r in mean_by_run(rows).collect():
                        point["metrics"][f"{r['metric']}@{r['k']}"] = r["value"]
                runs.append(point)
    made = provenance()
    return {"experiment": asdict(experiment), "dataset": {"checksum": data.checksum, "queries": len(data.queries), **data.meta}, "corpus": size, "provenance": made, "notes": notes(data, context.settings.embedding.provider, bool(made["dirty"])), "runs": runs, "finished_at": datetime.now(timezone.utc).isoformat()}


def found(context: Context, queries: DataFrame, strategy: str, k: int, reranker: str) -> tuple[DataFrame | None, dict[str, str], dict[str, float]]:
    """(hits, errors by query, milliseconds by stage) of all queries at once; if that fails, of each alone, so that one bad query costs only itself."""
    timing: dict[str, float] = {}
    try:
        return context.search(queries, strategy, k, reranker=reranker, timing=timing), {}, timing
    except Exception as e:
        logger("experiment").warning("the batch failed, its queries are tried one by one", extra={"fields": {"strategy": strategy, "error": str(e).splitlines()[0]}})
    hits, failed = None, {}
    for r in queries.collect():  # the query set, read from a file on the driver
        one, alone = context.spark.createDataFrame([r], queries.schema), {}
        try:
            got = context.search(one, strategy, k, reranker=reranker, timing=alone)
            hits = got if hits is None else hits.unionByName(got)
            for s, v in alone.items():
                timing[s] = round(timing.get(s, 0.0) + v, 3)
        except Exception as e:
            failed[r["query_id"]] = str(e).splitlines()[0]
    return hits, failed, timing


def summary(samples: list[float]) -> dict[str, float]:
    """Percentiles, mean and range at 3 digits; one sample a batch of queries."""
    q = np.quantile(samples, (0.5, 0.95, 0.99)) if samples else np.zeros(3)
    values = dict(zip(("p50", "p95", "p99"), q.tolist())) | {"mean": float(np.mean(samples or [0])), "low": min(samples, default=0.0), "high": max(samples, default=0.0)}
    return {k: round(v, 3) for k, v in values.items()}


def metrics_csv(result: dict) -> str:
    """One line a run; blank where unknown."""
    names = [f"{m}@{k}" for k in sorted({r["k"] for r in result["runs"]}) for m in METRICS]
    out = io.StringIO()
    w = csv.writer(out)
    stages = [s for s in STAGES if any(s in r["latency"] for r in result["runs"])]
    times = [(s, p) for s in stages for p in ("p50", "p95", "p99")]
    w.writerow(["run_id", "strategy", "reranker", "k", *names, *(f"{s.removesuffix('_ms')}_{p}_ms" for s, p in times), "query_tokens", "cost_usd", "failed_queries", "error"])
    for r in result["runs"]:
        quality = (f"{r['metrics'][n]:.6f}" if n in r["metrics"] else "" for n in names)
        spent = (f"{r['latency'][s][p]:.3f}" if s in r["latency"] else "" for s, p in times)
        w.writerow([r["run_id"], r["strategy"], r["reranker"], r["k"], *quality, *spent, r["query_tokens"], "" if r["cost_usd"] is None else f"{r['cost_usd']:.8f}", len(r["failed_queries"]), r["error"] or ""])
    return out.getvalue()


def report_md(result: dict) -> str:
    """Quality by k with the best in bold where there is a choice, time per batch, provenance and caveats."""
    e = result["experiment"]
    lines = [f"# {e['name']}", "", *([f"Hypothesis: {e['hypothesis']}", ""] if e["hypothesis"] else [])]
    for k in sorted({r["k"] for r in result["runs"]}):
        rows = [r for r in result["runs"] if r["k"] == k]
        names = [f"{m}@{k}" for m in METRICS]
        best = {n: max((r["metrics"][n] for r in rows if n in r["metrics"]), default=None) for n in names}
        cell = lambda r, n: "–" if n not in r["metrics"] else f"**{r['metrics'][n]:.4f}**" if len(rows) > 1 and r["metrics"][n] == best[n] else f"{r['metrics'][n]:.4f}"
        lines += [f"## Quality at {k}", "", "| run | " + " | ".join(names) + " |", "|---" * (len(names) + 1) + "|"]
        lines += [f"| {r['strategy']}, {r['reranker']} | " + " | ".join(cell(r, n) for n in names) + " |" for r in rows] + [""]
    stages = [s for s in STAGES if any(s in r["latency"] for r in result["runs"])]
    lines += ["## Milliseconds per batch of queries (p50 / p95 / p99)", "", "| run | " + " | ".join(stages) + " | tokens | USD |", "|---" * (len(stages) + 3) + "|"]
    spent = lambda r, s: " / ".join(f"{r['latency'][s][p]:.0f}" for p in ("p50", "p95", "p99")) if s in r["latency"] else "–"
    price = lambda r: "unknown" if r["cost_usd"] is None else f"{r['cost_usd']:.8f}"
    lines += [f"| {r['run_id']} | " + " | ".join(spent(r, s) for s in stages) + f" | {r['query_tokens']} | {price(r)} |" for r in result["runs"]] + [""]
    lines += [*(f"* {r['run_id']} failed: {r['error']}" for r in result["runs"] if r["error"]), *(f"* {r['run_id']}: {len(r['failed_queries'])} queries failed and are left out" for r in result["runs"] if r["failed_queries"] and not r["error"]), ""]
    lines += ["## Provenance", "", f"* commit {result['provenance']['commit'] or 'unknown'}", f"* query set {result['dataset']['checksum']}", f"* corpus {json.dumps(result['corpus'])}", "", "## Caveats", "", *(f"* {n}" for n in result["notes"]), "", "## Analysis", "", "(to be written)", ""]
    return "\n".join(lines)


def write_artefacts(result: dict, root: str) -> Path:
    """A new folder every time."""
    import yaml

    day = datetime.now(timezone.utc).strftime("%Y-%m-%d")
    base, n = f"{day}-{result['experiment']['name']}", 1
    folder = Path(root, "results", base)
    while folder.exists():
        n += 1
        folder = Path(root, "results", f"{base}-{n}")
    folder.mkdir(parents=True)
    (folder / "config.yaml").write_text(yaml.safe_dump(result["experiment"]), "utf-8")
    (folder / "results.json").write_text(json.dumps(result, indent=2), "utf-8")
    (folder / "metrics.csv").write_text(metrics_csv(result), "utf-8")
    (folder / "report.md").write_text(report_md(result), "utf-8")
    return folder


def against_baseline(baseline: dict, current: dict, threshold: float = 0.02) -> dict:
    """Regressions and improvements beyond an absolute threshold; another query set can't be compared."""
    if baseline["dataset"]["checksum"] != current["dataset"]["checksum"]:
        raise ConfigurationError("baseline and run used different query sets")
    b, c = ({r["run_id"]: r["metrics"] for r in x["runs"]} for x in (baseline, current))
    deltas = [{"run_id": i, "metric": m, "base": v, "now": c[i][m], "delta": round(c[i][m] - v, 9)} for i in b.keys() & c.keys() for m, v in b[i].items() if m in c[i]]
    down = [d for d in deltas if d["delta"] < -threshold]
    return {"passed": not down, "regressions": down, "improvements": [d for d in deltas if d["delta"] > threshold], "missing": sorted(b.keys() - c.keys()), "added": sorted(c.keys() - b.keys())}


def read_baseline(path: str) -> dict:
    try:
        x = json.loads(Path(path).read_text("utf-8"))
        return x if {"runs", "dataset"} <= x.keys() else {}[path]
    except (OSError, ValueError, KeyError, AttributeError) as e:
        raise ConfigurationError(f"{path} is no result file") from e
