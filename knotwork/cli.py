"""Command line: init, import-file, import-directory, search, get-document, get-entity, get-related-documents, stats, export-kg."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame

from knotwork.config import Config
from knotwork.engine import Engine
from knotwork.operators import graph
from knotwork.plans.pipeline import import_totals
from knotwork.runtime import session, staged
from knotwork.sources.files import DEFAULT_EXTENSIONS, read_documents
from knotwork.sources.store import Store, export_json, network_document


def shown(df: DataFrame, form: str) -> Iterator[str]:
    """Rows as lines of text, of a JSON list or of a Markdown table; they are fetched partition by partition."""
    rows = (r.asDict(recursive=True) for r in df.toLocalIterator())
    if form == "json":
        yield "["
        for n, r in enumerate(rows):
            yield ("," if n else "") + json.dumps(r, ensure_ascii=False, default=str)
        yield "]"
    elif form == "markdown":
        yield "| " + " | ".join(df.columns) + " |"
        yield "|" + "---|" * len(df.columns)
        for r in rows:
            yield "| " + " | ".join(str(v) for v in r.values()) + " |"
    else:
        for r in rows:
            yield ", ".join(f"{k}: {v}" for k, v in r.items())


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="knotwork")
    p.add_argument("--store")
    p.add_argument("--config")
    p.add_argument("--format", choices=("text", "json", "markdown"), default="text")
    p.add_argument("--output")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init").add_argument("--force", action="store_true")
    sub.add_parser("import-file").add_argument("path")
    d = sub.add_parser("import-directory")
    d.add_argument("path")
    d.add_argument("--flat", action="store_true")
    d.add_argument("--extensions", default=",".join(DEFAULT_EXTENSIONS))
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--limit", type=int, default=5)
    s.add_argument("--alpha", type=float, help="0: keywords only, 1: vectors only")
    s.add_argument("--no-graph", action="store_true")
    for name, arg in (("get-document", "document_id"), ("get-entity", "text"), ("get-related-documents", "text")):
        sub.add_parser(name).add_argument(arg)
    sub.add_parser("stats")
    e = sub.add_parser("export-kg")
    e.add_argument("path")
    e.add_argument("--one-file", action="store_true")
    return p


def run(args: argparse.Namespace, spark) -> Iterable[str]:
    """The lines of the answer of a command."""
    config = Config.load(args.config)
    store = Store(spark, args.store or config.store)
    engine = Engine(spark, store.path, config)
    c = args.command
    if c == "init":
        engine.create(args.force)
        return ["ready"]
    if c in ("import-file", "import-directory"):
        kinds = tuple(args.extensions.split(",")) if c == "import-directory" else (*DEFAULT_EXTENSIONS, "csv", "xlsx")
        docs = staged(read_documents(spark, args.path, kinds, recursive=not getattr(args, "flat", False)), "files")
        return shown(import_totals(store, engine.add_documents(docs)), args.format)
    if c == "search":
        q = spark.createDataFrame([("0", args.query)], "query_id string, text string")
        hits = engine.search(q, args.limit, args.alpha, use_graph=not args.no_graph)
        return shown(hits.orderBy("rank").select("rank", "document_id", "result_type"), args.format)
    if c == "get-document":
        return shown(engine.get_document(args.document_id)[0].select("chunk_index", "content"), args.format)
    if c == "get-entity":
        return shown(engine.get_entity(args.text)[1].select("direction", "type", "neighbour_text", "neighbour_type", "confidence"), args.format)
    if c == "get-related-documents":
        return shown(engine.get_entity(args.text)[0].select("document", "text", "type"), args.format)
    if c == "stats":
        return shown(engine.statistics().distinct().orderBy("metric"), args.format)
    nodes = store.read("nodes")
    n, e = graph.export_nodes(nodes), graph.export_edges(store.read("edges"), nodes)
    if args.one_file:
        with open(args.path, "w", encoding="utf-8") as out:
            out.write(network_document(n, e))
    else:
        export_json(n, f"{args.path}/nodes")
        export_json(e, f"{args.path}/edges")
    return [f"exported to {args.path}"]


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    lines = run(args, session("knotwork"))
    if args.output:
        with open(args.output, "w", encoding="utf-8") as out:
            out.writelines(f"{x}\n" for x in lines)
    else:
        for x in lines:
            print(x)
    return 0


if __name__ == "__main__":
    sys.exit(main())
