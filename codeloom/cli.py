"""The command line: python -m codeloom.cli COMMAND."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from codeloom import render
from codeloom.plans import project

QUERY_HELP = """terms, joined by blanks: name:X kind:X, and at most one of callers:X callees:X
extends:X subclasses:X requires:PATH dependents:PATH methods:X; * stands for all"""


def _positive(text: str) -> int:
    if not text.isdigit() or int(text) < 1:
        raise argparse.ArgumentTypeError("must be a positive integer")
    return int(text)


def _port(text: str) -> int:
    if not text.isdigit() or int(text) > 65535:
        raise argparse.ArgumentTypeError("must be an integer from 0 to 65535")
    return int(text)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="codeloom", description="Code graphs on Spark")
    out.add_argument("--version", action="version", version="0.1.0")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, help_text: str, root: str = "?") -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=help_text, description=help_text)
        if root:
            c.add_argument("root", nargs=None if root == "1" else root, default=None)
        if name in render.FORMATS:
            formats = list(render.FORMATS[name])
            c.add_argument("--format", choices=formats, default=formats[0])
        return c

    command("init", "write a project's configuration", root="1")
    command("status", "counts and pending changes").add_argument("--project-root")
    command("sample", "some indexed symbols").add_argument("--limit", type=_positive, default=20)
    q = command("query", QUERY_HELP, root="")
    q.add_argument("expression", nargs="+")
    q.add_argument("--depth", type=_positive, default=1)
    q.add_argument("--project-root")
    for name, help_text in (("impact", "what depends on a file or symbol"), ("explain", "a report on a file or symbol")):
        c = command(name, help_text, root="")
        c.add_argument("input")
        c.add_argument("--depth", type=_positive, default=2)
        c.add_argument("--project-root")
    s = command("serve", "an HTTP service for viewers")
    s.add_argument("--port", type=_port, default=0)
    i = command("index", "parse everything anew")
    i.add_argument("--force", action="store_true")
    i.add_argument("--quiet", action="store_true")
    command("sync", "refresh by content hash").add_argument("--quiet", action="store_true")
    return out


def _session() -> SparkSession:
    cores = str(min(8, os.cpu_count() or 1))
    spark = SparkSession.builder.master(f"local[{cores}]").appName("codeloom").config("spark.sql.shuffle.partitions", cores).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    root = getattr(args, "root", None) or getattr(args, "project_root", None) or os.getcwd()
    quiet = getattr(args, "quiet", False)
    progress = (lambda _: None) if quiet else (lambda m: print(f"[{args.command}] {m}", file=sys.stderr))
    try:
        spark = spark or _session()
        if args.command == "serve":
            from codeloom import serve

            server = serve.start(spark, root, port=args.port)
            print(f"serving on {server.url}", flush=True)
            server.join()
            return 0
        result = {
            "init": lambda: project.init_project(spark, root),
            "status": lambda: project.project_status(spark, root),
            "sample": lambda: project.sample_project(spark, root, args.limit),
            "query": lambda: project.query_project(spark, root, " ".join(args.expression), args.depth),
            "impact": lambda: project.impact_project(spark, root, args.input, args.depth),
            "explain": lambda: project.explain_project(spark, root, args.input, args.depth),
            "index": lambda: project.index_project(spark, root, args.force, progress),
            "sync": lambda: project.sync_project(spark, root, progress),
        }[args.command]()
    except (OSError, ValueError, LookupError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if not quiet:
        print(render.FORMATS[args.command][args.format](result))
    return 0


if __name__ == "__main__":
    sys.exit(main())
