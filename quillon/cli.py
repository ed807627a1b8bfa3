"""``python -m quillon.cli``: ``build-index DIR [CORPUS...]``, ``do-query DIR [COMMANDS]``, ``main CORPUS...`` and ``search DIR``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from quillon.engine import Engine
from quillon.sources.corpus import parse_jsonl, read_commands, read_jsonl

DEMO = ["hello", "the", "to be", "one two three", "nosuchword"]


def one(engine: Engine, line: str) -> int:
    """The number for one command line."""
    cmd, _, rest = line.rstrip("\n").partition("\t")
    query = rest.split("\t")[0]
    if cmd in ("COUNT", "TOP_10_COUNT"):
        return engine.count(query)
    if cmd == "TOP_10":
        return 1
    print("UNSUPPORTED", file=sys.stderr)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillon")
    commands = parser.add_subparsers(dest="what", required=True)
    build = commands.add_parser("build-index")
    build.add_argument("dir")
    build.add_argument("corpus", nargs="*", help="JSON lines; standard input if absent")
    ask = commands.add_parser("do-query")
    ask.add_argument("dir")
    ask.add_argument("commands", nargs="?", help="file of COMMAND<TAB>query lines; standard input if absent")
    demo = commands.add_parser("main", help="build an index, restore it, and show some searches")
    demo.add_argument("dir")
    demo.add_argument("corpus", nargs="*", help="JSON lines; standard input if absent")
    show = commands.add_parser("search", help="restore an index, and show a count and some searches")
    show.add_argument("dir")
    for p in (demo, show):
        p.add_argument("--query", action="append", help="instead of the queries shown by default; may be repeated")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quillon").getOrCreate()
    engine = Engine(spark, args.dir)
    if args.what in ("build-index", "main"):
        engine.index_frame(read_jsonl(spark, args.corpus) if args.corpus else parse_jsonl(spark, sys.stdin))
        engine.save()
        if args.what == "build-index":
            return 0
    if args.what in ("main", "search"):
        engine.restore()
        queries = args.query or DEMO
        if args.what == "search":
            print(f"{queries[0]}: {engine.count(queries[0])}", flush=True)
        for query in queries:
            print(f"{query}: {', '.join(engine.search(query))}", flush=True)
        return 0
    engine.restore(cache=not args.commands)
    if args.commands:
        for row in engine.run(read_commands(spark, args.commands)).orderBy("id").toLocalIterator():
            print(row.result, flush=True)
    else:
        for line in sys.stdin:
            print(one(engine, line), flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
