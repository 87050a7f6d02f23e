"""python -m lumenlog: check programs, run one, ask a running one."""

from __future__ import annotations

import argparse
import json
import sys
import time
import urllib.error
import urllib.request

from .lang.diagnostics import ProgramError
from .lang.loader import load_file
from .plans.rewrite import rewrite
from .plans.strata import stratify
from .plans.typing import check


def parse_source(text: str) -> tuple[str | None, str, dict[str, str]]:
    """[REL=]PROVIDER[:k=v;...]"""
    name, _, settings = text.partition(":")
    relation, eq, provider = name.partition("=")
    config = dict(p.partition("=")[::2] for p in settings.split(";") if p)
    return (relation, provider, config) if eq else (None, name, config)


def do_check(paths: list[str]) -> int:
    if not paths:
        print("no programs", file=sys.stderr)
        return 2
    bad = 0
    for path in paths:
        try:
            typed = check(load_file(path))
            strata = stratify(rewrite(typed.program))
            print(f"{path}: ok, {len(typed.program.rules)} rules in {len(strata)} strata")
        except ProgramError as e:
            bad += 1
            print(f"{path}:\n{e}", file=sys.stderr)
    return int(bad > 0)


def do_run(args: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    from .engine import Engine, served
    from .serve.http import serve
    from .serve.state import Service
    from .sources.sinks import change_lines, print_sizes, write_csv
    from .streaming.changes import difference

    builder = SparkSession.builder.appName("lumenlog").config("spark.sql.session.timeZone", "UTC")
    spark = (builder.master(f"local[{args.workers}]") if args.workers else builder).getOrCreate()
    engine = Engine(spark)
    for s in args.source:
        relation, provider, config = parse_source(s)
        engine.add_source(provider, config, relation)
    try:
        engine.load_file(args.program)
    except ProgramError as e:
        print(e, file=sys.stderr)
        return 1
    if args.facts or args.out or args.no_serve and not args.watch:
        done = {n: df for n, df in engine.evaluate(facts=args.facts, delimiter=args.delimiter).items() if n in served(engine.program)}
        print_sizes(done) if not args.out else write_csv(done, args.out)
        return 0
    listeners: list = []
    if args.print:
        last: dict = {}

        def tell(_, frames, dirty):
            for n in served(engine.program):
                if n in dirty:
                    old = last.get(n, frames[n].limit(0))
                    for line in change_lines(n, ((tuple(r)[:-1], r[-1]) for r in difference(frames[n], old).toLocalIterator())):
                        print(line, flush=True)
                    last[n] = frames[n]

        listeners.append(tell)
    base = engine.run(listeners)
    roots = tuple(s.config["root"] for s, _ in engine.sources() if "root" in s.config)
    server = None if args.no_serve else serve(Service(base, engine.program, not args.no_publish, roots, args.program), args.addr)
    try:
        while True:
            time.sleep(args.interval)
            engine.poll()
    except KeyboardInterrupt:
        return 0
    finally:
        if server:
            server.shutdown()


def do_query(args: argparse.Namespace) -> int:
    path = f"/relations/{args.relation}" if args.relation else "/relations"
    try:
        with urllib.request.urlopen(f"http://{args.addr}{path}") as answer:
            told = json.load(answer)
    except urllib.error.HTTPError as e:
        print(json.load(e).get("error", e), file=sys.stderr)
        return 1
    except OSError as e:
        print(f"{args.addr}: {e}", file=sys.stderr)
        return 1
    if args.json:
        print(json.dumps(told))
    elif args.relation:
        for row in told["rows"]:
            print(", ".join(row))
        print(f"{told['count']} rows", file=sys.stderr)
    else:
        for r in told["relations"]:
            print(f"{r['count']}\t{r['name']}")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lumenlog", description=__doc__)
    to = parser.add_subparsers(dest="command", required=True)
    run = to.add_parser("run", help="evaluate a program; serve it unless told otherwise")
    run.add_argument("program")
    run.add_argument("-s", "--source", action="append", default=[], help="[REL=]PROVIDER[:k=v;...]")
    run.add_argument("-w", "--workers", type=int, help="threads of a local Spark; else the session's own master")
    run.add_argument("--addr", default="127.0.0.1:7777")
    run.add_argument("--interval", type=float, default=1.0, help="seconds between looks at the sources")
    run.add_argument("--facts", help="a folder of facts files")
    run.add_argument("--delimiter", default=",")
    run.add_argument("--out", help="a folder for CSV results")
    run.add_argument("--no-serve", action="store_true")
    run.add_argument("--watch", action="store_true", help="with --no-serve, go on looking for changes")
    run.add_argument("--print", action="store_true", help="print changes of served relations")
    run.add_argument("--no-publish", action="store_true")
    to.add_parser("check", help="parse, type and stratify").add_argument("programs", nargs="*")
    query = to.add_parser("query", help="ask a running engine")
    query.add_argument("relation", nargs="?")
    query.add_argument("--addr", default="127.0.0.1:7777")
    query.add_argument("--json", action="store_true")
    args = parser.parse_args(argv)
    return do_check(args.programs) if args.command == "check" else do_run(args) if args.command == "run" else do_query(args)
