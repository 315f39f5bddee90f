"""``python -m sieveline.cli``: ingest, search, status, documents, experiment, benchmark, report, migrate, init, version."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .config import load_settings
from .errors import EngineError
from .log import configure
from .operators.filters import SearchFilters
from .registry import connectors

VERSION = "0.1.0"
TEMPLATE = "store:\n  path: ./knowledge\nembedding:\n  provider: hash\n  dimensions: 384\nchunking:\n  strategy: fixed\nretrieval:\n  default: hybrid\n"


def _context(args):
    from pyspark.sql import SparkSession

    from .plans.context import Context

    spark = SparkSession.builder.appName("sieveline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    settings = load_settings(args.config)
    configure(settings.logging)
    return Context(spark, settings)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("sieveline")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    sub.add_parser("connectors")
    sub.add_parser("status")
    sub.add_parser("migrate")
    sub.add_parser("report").add_argument("results")
    sub.add_parser("init").add_argument("folder", nargs="?", default=".")
    i = sub.add_parser("ingest")
    i.add_argument("path")
    i.add_argument("--force", action="store_true")
    i.add_argument("--no-prune", action="store_true")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--top-k", type=int)
    s.add_argument("--strategy")
    s.add_argument("--rerank")
    s.add_argument("--source-type", action="append", default=[])
    s.add_argument("--file-type", action="append", default=[])
    s.add_argument("--author", action="append", default=[])
    s.add_argument("--repository", action="append", default=[])
    s.add_argument("--tag", action="append", default=[])
    s.add_argument("--json", action="store_true")
    s.add_argument("--chars", type=int, default=160)
    d = sub.add_parser("documents")
    d.add_argument("--limit", type=int, default=20)
    d.add_argument("--offset", type=int, default=0)
    d.add_argument("--id")
    for name in ("experiment", "benchmark"):
        e = sub.add_parser(name)
        e.add_argument("path")
        e.add_argument("--root", default="experiments")
        if name == "benchmark":
            e.add_argument("--baseline", required=True)
            e.add_argument("--threshold", type=float, default=0.02)
    args = p.parse_args(argv)
    try:
        return _run(args)
    except EngineError as e:
        print(e, file=sys.stderr)
        return 1


def _run(args) -> int:
    if args.command == "version":
        print(VERSION)
        return 0
    if args.command == "connectors":
        print("\n".join(connectors.names()))
        return 0
    if args.command == "init":
        target = Path(args.folder, "sieveline.yaml")
        if target.exists():
            print(f"{target} is there already", file=sys.stderr)
            return 1
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(TEMPLATE, "utf-8")
        return 0
    if args.command == "report":
        from .plans import experiment as X

        print(X.report_md(X.read_baseline(args.results)))
        return 0
    c = _context(args)
    if args.command == "migrate":
        print(json.dumps({"snapshot": c.store.current()}))  # tables carry their schemas; nothing is to be altered
        return 0
    if args.command == "status":
        print(json.dumps(c.store.health()))
        return 0
    if args.command == "ingest":
        report = c.ingest(connectors.create("filesystem", spark=c.spark, root=args.path), "filesystem", args.force, not args.no_prune)
        got = {r["outcome"]: r["n"] for r in report.groupBy("outcome").count().withColumnRenamed("count", "n").collect()}
        print(json.dumps(got))
        return int("failed" in got)
    if args.command == "search":
        from pyspark.sql import functions as F

        from .functions.text import preview

        q = c.spark.createDataFrame([("q", args.query)], "query_id string, text string")
        f = SearchFilters(source_types=tuple(args.source_type), file_types=tuple(t.lower().lstrip(".") for t in args.file_type), authors=tuple(args.author), repositories=tuple(args.repository), tags=tuple(args.tag))
        hits = c.search(q, args.strategy, args.top_k, f, args.rerank).orderBy("rank")
        for r in hits.select("rank", "score", "document_title", preview(F.col("content"), args.chars).alias("text")).collect():
            print(json.dumps(r.asDict(), ensure_ascii=False) if args.json else f"{r['rank']:>3} {r['score']:.4f} {r['document_title']}: {r['text']}")
        return 0
    if args.command == "documents":
        from .plans.store import listing

        docs = c.store.read("documents")
        if docs is None:
            return 0
        rows = docs.filter(docs["id"] == args.id) if args.id else listing(docs, args.limit, args.offset)
        for r in rows.select("id", "source_type", "source_id", "title").collect():
            print(json.dumps(r.asDict(), ensure_ascii=False))
        return 0
    from .plans import experiment as X

    result = X.run(c, X.load_experiment(args.path))
    print(X.write_artefacts(result, args.root))
    if args.command == "benchmark":
        verdict = X.against_baseline(X.read_baseline(args.baseline), result, args.threshold)
        print(json.dumps(verdict, indent=2))
        return int(not verdict["passed"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
