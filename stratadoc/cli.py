"""A thin command line over the engine: put, get, list, query, fields, values, hide, override, ingest, sync, watch, stats,
compact, server, config, version."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame

from stratadoc import __version__
from stratadoc.api import Engine
from stratadoc.config import Access, Client, Config
from stratadoc.functions.canonical import parse_json
from stratadoc.operators import ingest
from stratadoc.plans.planner import envelope
from stratadoc.sources.store import VERSION, human_bytes


def count_lines(rows: list[dict], indent: str = "") -> Iterator[str]:
    for r in rows:
        yield f"{indent}{r['count']}\t{r.get('field', json.dumps(r.get('value')))}"
        yield from count_lines(r.get("values") or [], indent + "  ")


def list_lines(engine: Engine, args: argparse.Namespace) -> DataFrame:
    """The lines of a list, of each of its queries in turn."""
    queries = [ingest.friendly_query(parse_json(q)) for q in args.queries]
    if len(queries) > 1:
        return engine.lists(args.namespace, queries).selectExpr("record_id line")
    return engine.records(args.namespace, queries[0] if queries else {}).selectExpr("record_id line")


def run(engine: Engine, args: argparse.Namespace) -> Iterator[str]:
    ns, pretty = args.namespace, lambda x: json.dumps(x, indent=2, sort_keys=True, default=str)
    query = lambda: ingest.friendly_query(parse_json(args.query)) if args.query else {}
    if args.command == "get":
        if args.field and ingest.is_entity_alias(args.field):
            yield pretty(engine.entity(ns, args.id))
        else:
            yield pretty(engine.by_field(ns, args.field, args.id) if args.field else engine.record(ns, args.id))
    elif args.command == "list":
        for r in list_lines(engine, args).toLocalIterator():
            yield r.line
    elif args.command == "query":
        for r in envelope(engine.records(ns, query()), ns).selectExpr("to_json(struct(*)) j").toLocalIterator():
            yield pretty(json.loads(r.j))
    elif args.command == "fields":
        yield from count_lines(engine.fields_response(ns, query())["fields"] or [])
    elif args.command == "values":
        yield from count_lines(engine.values_response(ns, args.names, query())["fields"])
    elif args.command == "put":
        yield pretty(ingest.insert_one(engine.store, ns, ingest.fill_in(ingest.document_text(args.document))))
    elif args.command == "hide":
        yield pretty(ingest.hide(engine.store, ns, args.id))
    elif args.command == "override":
        yield pretty(ingest.override(engine.store, ns, args.id, ingest.document_text(args.document)))
    elif args.command == "ingest":
        from stratadoc.sources.jsonl import text_lines

        yield pretty(ingest.ingest_lines(engine.store, ns, text_lines(engine.spark, args.path)).summary())
    elif args.command == "sync":
        from stratadoc.streaming.sync import sync_directory

        done = sync_directory(engine.store, ns, args.path)
        yield pretty({**done.summary(), "errors": done.errors} if done else {"new": 0})
    elif args.command == "watch":
        from stratadoc.streaming.sync import watch_directory

        watch_directory(engine.store, ns, args.path, args.checkpoint).awaitTermination()
    elif args.command == "compact":
        yield pretty({"base": engine.store.compact(), "deleted_folders": engine.store.clean()})
    elif args.command == "server":
        from stratadoc.server import make_server

        make_server(engine, args.host, args.port).serve_forever()
    elif args.command == "config":
        yield from config_lines()
    elif args.command == "version":
        yield f"stratadoc {__version__}, store layout {VERSION}"
    elif args.command == "stats":
        out = engine.stats(ns)
        yield pretty({**out, "table_bytes": {k: human_bytes(v) for k, v in out["table_bytes"].items()}})


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratadoc", description=__doc__)
    p.add_argument("--root", required=True, help="folder of the store, on any file system of Spark")
    p.add_argument("--namespace", default="main")
    p.add_argument("--semantics", default="reference", choices=("reference", "intended"))
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list").add_argument("queries", nargs="*")
    for name in ("query", "fields"):
        sub.add_parser(name).add_argument("query", nargs="?")
    values = sub.add_parser("values")
    values.add_argument("names", nargs="+")
    values.add_argument("--query")
    get = sub.add_parser("get")
    get.add_argument("id")
    get.add_argument("--field")
    sub.add_parser("put").add_argument("document")
    sub.add_parser("hide").add_argument("id")
    over = sub.add_parser("override")
    over.add_argument("id")
    over.add_argument("document")
    for name in ("ingest", "sync", "watch"):
        s = sub.add_parser(name)
        s.add_argument("path")
        if name == "watch":
            s.add_argument("--checkpoint", required=True)
    for name in ("stats", "compact", "config", "version"):
        sub.add_parser(name)
    server = sub.add_parser("server")
    server.add_argument("--host", default="127.0.0.1")
    server.add_argument("--port", type=int, default=8000)
    return p


def config_files() -> list[Path]:
    """Where clients and limits may be configured, the first that is there counts."""
    return [Path.cwd() / ".stratadoc.json", Path.home() / ".config" / "stratadoc" / "config.json"]


def config_lines() -> Iterator[str]:
    for path in config_files():
        yield f"\t[{'exists' if path.exists() else 'missing'}]\t{path}"


def load_config(args: argparse.Namespace) -> Config:
    """The first configuration file's clients and host, and the command line's namespace and semantics."""
    path = next((p for p in config_files() if p.exists()), None)
    found = json.loads(path.read_text()) if path else {}
    clients = tuple(Client(c["name"], c["secret"], {ns: Access(**a) for ns, a in c.get("access", {}).items()}) for c in found.get("clients", ()))
    return Config(namespaces=tuple(dict.fromkeys([args.namespace, *found.get("namespaces", ())])), clients=clients, semantics=args.semantics, accept_host=found.get("accept_host"))


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("stratadoc").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, args.root, load_config(args))
    for line in run(engine, args):
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
