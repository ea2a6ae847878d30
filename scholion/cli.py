"""Command line: query, populate, process, download and listings."""

from __future__ import annotations

import argparse
import ast
import random
import sys
from importlib import import_module

from scholion import debug
from scholion.plans.processes import PROCESSES, SCHEMAS
from scholion.session import local_session
from scholion.sources.all import SOURCES
from scholion.sources.errors import UserError
from scholion.sources.sinks import import_table, write_rows

VERSION = "0.1.0"


#: What a sample expression may be made of: comparisons, arithmetic, constants, and calls and names of a short list.
_PARTS = (ast.Expression, ast.BoolOp, ast.BinOp, ast.UnaryOp, ast.Compare, ast.IfExp, ast.Constant, ast.Name, ast.Load, ast.Call, ast.Attribute, ast.Subscript, ast.Slice, ast.Tuple, ast.List, ast.boolop, ast.operator, ast.unaryop, ast.cmpop)
_CALLS = {"len": len, "min": min, "max": max, "int": int, "str": str}
_METHODS = {"endswith", "startswith", "lower", "upper", "find", "count", "split", "strip", "isdigit"}


def sampler(expression: str | None):
    """A predicate over ``data`` from an expression such as ``random.random() < 0.01`` or ``'2021' in data``.

    Known are ``data``, ``random.random()``, a few functions and methods of texts; anything else is an error, found by
    walking the expression's tree. Random numbers repeat from run to run, and nobody else's are touched.
    """
    if not expression:
        return None
    try:
        tree = ast.parse(expression, "sample", "eval")
    except SyntaxError as e:
        raise UserError(f"Invalid sample expression: {e.msg}.") from e
    for node in ast.walk(tree):
        known = isinstance(node, _PARTS)
        if isinstance(node, ast.Name):
            known = node.id in {"data", "random", *_CALLS}
        elif isinstance(node, ast.Attribute):
            of_random = isinstance(node.value, ast.Name) and node.value.id == "random"
            known = node.attr == "random" if of_random else node.attr in _METHODS
        elif isinstance(node, ast.BinOp):
            known = not isinstance(node.op, (ast.Pow, ast.LShift))
        if not known:
            raise UserError(f"A sample expression may not hold '{ast.unparse(node)}'.")
    code = compile(tree, "sample", "eval")
    names = {"__builtins__": {}, "random": random.Random("scholion"), **_CALLS}
    return lambda data: bool(eval(code, names, {"data": data}))  # noqa: S307  of checked parts only


def _source(args):
    if args.source not in SOURCES:
        raise UserError(f"Unknown data source name: '{args.source}'.")
    spark = local_session(args.cores, progress=args.progress)
    return SOURCES[args.source](spark, args.location, sampler(getattr(args, "sample", None)), getattr(args, "attach", None))


def _text(inline: str | None, file: str | None) -> str | None:
    if file:
        with open(file, encoding="utf-8") as f:
            return f.read().strip().rstrip(";")
    return inline.strip().rstrip(";") if inline else None


def query(args) -> None:
    sql = _text(args.query, args.query_file)
    with _source(args) as source:
        result = source.query(sql, args.partition)
        if args.explain:
            result.explain("formatted")
            return
        write_rows(result, args.output, args.header, args.field_separator, args.encoding)


def populate(args) -> None:
    with _source(args) as source:
        source.populate(args.database, args.columns, _text(args.row_selection, args.row_selection_file))


def process(args) -> None:
    if args.process not in PROCESSES:
        raise UserError(f"Unknown process name: '{args.process}'.")
    PROCESSES[args.process](local_session(args.cores, progress=args.progress), args.database)


def download(args) -> None:
    with _source(args) as source:
        module, _, name = args.fetch.partition(":")
        source.download(args.database, args.target, getattr(import_module(module), name), args.sql_query)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="scholion", description=__doc__)
    top.add_argument("--cores", default="*", help="local cores to use")
    top.add_argument("-d", "--debug", default="", metavar="TOPIC,TOPIC", help="; ".join(f"{k}: {v}" for k, v in debug.TOPICS.items()))
    top.add_argument("-p", "--progress", action="store_true", help="show the progress of stages")
    sub = top.add_subparsers(dest="command", required=True)

    def source(name: str, help_: str, f):
        p = sub.add_parser(name, help=help_)
        p.set_defaults(run=f)
        p.add_argument("source", help="name of a data source")
        p.add_argument("location", nargs="?", help="its folder, archive or file")
        p.add_argument("-s", "--sample", help="expression over data that keeps a container")
        p.add_argument("-a", "--attach", action="append", metavar="NAME:PATH", help="database to attach")
        return p

    p = source("query", "run SQL on a source", query)
    which = p.add_mutually_exclusive_group(required=True)
    which.add_argument("-q", "--query")
    which.add_argument("-Q", "--query-file")
    p.add_argument("-P", "--partition", action="store_true", help="run the query on each container")
    p.add_argument("-H", "--header", action="store_true")
    p.add_argument("-F", "--field-separator", default=",")
    p.add_argument("-E", "--encoding", default="utf-8")
    p.add_argument("-o", "--output")
    p.add_argument("--explain", action="store_true", help="show the plan instead")

    p = source("populate", "write chosen rows and columns to a database", populate)
    p.add_argument("-d", "--database", required=True)
    p.add_argument("-c", "--columns", nargs="*", help="table.column or table.*")
    which = p.add_mutually_exclusive_group()
    which.add_argument("-r", "--row-selection")
    which.add_argument("-R", "--row-selection-file")

    p = source("download", "fetch a source's data", download)
    p.add_argument("-d", "--database")
    p.add_argument("--sql-query")
    p.add_argument("--fetch", required=True, help="module:function that gives the codes of an ISSN")
    p.add_argument("-t", "--target", required=True)

    p = sub.add_parser("process", help="link or normalise a database")
    p.set_defaults(run=process)
    p.add_argument("process")
    p.add_argument("-d", "--database", required=True)

    p = sub.add_parser("import", help="make a table of a delimited file")
    p.set_defaults(run=lambda a: import_table(local_session(a.cores, progress=a.progress), a.file, a.database, a.table, a.schema, a.field_separator))
    p.add_argument("file")
    p.add_argument("table")
    p.add_argument("-d", "--database", required=True)
    p.add_argument("--schema", help="columns and types, as in CREATE TABLE")
    p.add_argument("-F", "--field-separator", default=",")

    def listing(name: str, help_: str, lines, argument: str | None = None):
        p = sub.add_parser(name, help=help_)
        if argument:
            p.add_argument(argument)
        p.set_defaults(run=lambda a: print("\n".join(lines(a))))

    def schema_of(name: str) -> list[str]:
        if name not in SOURCES:
            raise UserError(f"Unknown data source name: '{name}'.")
        return [t.ddl() for t in SOURCES[name].tables]

    def process_schema(name: str) -> list[str]:
        if name not in SCHEMAS:
            raise UserError(f"Unknown process name: '{name}'.")
        return [SCHEMAS[name]]

    listing("list-sources", "names of the data sources", lambda a: sorted(SOURCES))
    listing("list-processes", "names of the processes", lambda a: sorted(PROCESSES))
    listing("list-source-schema", "tables of a source", lambda a: schema_of(a.name), "name")
    listing("list-process-schema", "tables a process makes", lambda a: process_schema(a.name), "name")
    listing("list-complete-schema", "all tables", lambda a: [x for s in SOURCES for x in schema_of(s)] + [x for s in SCHEMAS for x in process_schema(s)])
    listing("version", "the version", lambda a: [VERSION])
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        debug.set_flags([x for x in args.debug.split(",") if x])
        with debug.timed(args.command):
            args.run(args)
    except (UserError, debug.UnknownTopic) as e:
        print(f"scholion: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
