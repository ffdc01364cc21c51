"""Command line: run queries on a stored database, import graphs, or read lines from a terminal."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .errors import GqlError
from .lang.nodes import show
from .lang.parser import parse
from .session import Database, Result
from .sources.graph import read_manifest


def shown(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, str):
        return f"'{value}'"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(shown, value)) + "]"
    return str(value)


def print_result(result: Result, explain: bool = False) -> None:
    if result.df is None or not result.df.columns:
        if result.affected_elements:
            print(f"{result.affected_elements} elements changed")
        return
    if explain:
        result.df.explain("formatted")
        return
    cells = [result.columns] + [[shown(v) for v in r] for r in result.rows()]
    widths = [max(len(r[i]) for r in cells) for i in range(len(result.columns))]
    for i, r in enumerate(cells):
        print(" | ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip())
        if not i:
            print("-+-".join("-" * w for w in widths))


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="trellisgraph")
    parser.add_argument("--database", help="folder of a stored database")
    commands = parser.add_subparsers(dest="command")
    run = commands.add_parser("run")
    run.add_argument("--query")
    run.add_argument("--file")
    run.add_argument("--explain", action="store_true")
    run.add_argument("--dump-ast", action="store_true")
    load = commands.add_parser("import")
    load.add_argument("graph")
    load.add_argument("manifest")
    commands.add_parser("checkpoint")
    options = parser.parse_args(arguments)
    if options.command == "run" and options.dump_ast:
        text = options.query or open(options.file).read()  # noqa: SIM115
        print("".join(show(s) for s in parse(text)))
        return 0
    spark = SparkSession.builder.appName("trellisgraph").getOrCreate()
    session = Database(spark, options.database).session()
    try:
        if options.command == "import":
            session.create_graph(options.graph, read_manifest(spark, options.manifest))
        elif options.command == "checkpoint":
            session.database.checkpoint()
        elif options.command == "run":
            for result in session.run(options.query or open(options.file).read()):  # noqa: SIM115
                print_result(result, options.explain)
        else:
            return repl(session)
    except GqlError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


def repl(session) -> int:
    lines: list[str] = []
    for line in sys.stdin:
        lines.append(line)
        if not line.rstrip().endswith(";"):
            continue
        try:
            for result in session.run("".join(lines)):
                print_result(result)
        except GqlError as e:
            print(f"error: {e}", file=sys.stderr)
        lines = []
    return 0


if __name__ == "__main__":
    sys.exit(main())
