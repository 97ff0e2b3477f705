"""Command line: python -m wayfold.cli --db PATH COMMAND ..."""

from __future__ import annotations

import argparse
import importlib
import os
import shutil
import sys
import tempfile
from datetime import date


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wayfold")
    p.add_argument("--db", default="wayfold-store")
    p.add_argument("--in-memory", action="store_true")
    p.add_argument("--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def conditions(q):
        q.add_argument("--before", type=date.fromisoformat)
        q.add_argument("--after", type=date.fromisoformat)
        q.add_argument("--filter")

    def image(q):
        conditions(q)
        q.add_argument("--color")
        q.add_argument("--gradient")
        q.add_argument("--width", type=int, default=1024)
        q.add_argument("--output", required=True)

    q = sub.add_parser("activities")
    conditions(q)
    q.add_argument("--count", action="store_true")
    q = sub.add_parser("import")
    q.add_argument("path")
    q.add_argument("--reset", action="store_true")
    q.add_argument("--trim", type=float)
    q.add_argument("--join")
    q = sub.add_parser("tile")
    q.add_argument("tile")
    image(q)
    q = sub.add_parser("render")
    q.add_argument("--bounds", required=True)
    q.add_argument("--height", type=int, default=1024)
    image(q)
    q = sub.add_parser("serve")
    q.add_argument("--host", default="127.0.0.1")
    q.add_argument("--port", type=int, default=8080)
    for flag in ("upload", "render", "fetch", "cors"):
        q.add_argument(f"--{flag}", action="store_true")
    q.add_argument("--strava-webhook", action="store_true")
    q.add_argument("--client", action="append", default=[], metavar="SOURCE=MODULE:FUNCTION", help="a client that POST /fetch/SOURCE calls")
    q.add_argument("--detail", metavar="MODULE:FUNCTION", help="the webhook's client for an activity's details")
    q = sub.add_parser("fetch")
    q.add_argument("source")
    q.add_argument("--client", required=True, metavar="MODULE:FUNCTION", help="a function of a date that yields (name, content)")
    q.add_argument("--lookback", type=int, default=30)
    q = sub.add_parser("mask")
    m = q.add_subparsers(dest="action")
    a = m.add_parser("add")
    a.add_argument("name")
    a.add_argument("latlng")
    a.add_argument("radius", type=float)
    m.add_parser("remove").add_argument("name")
    m.add_parser("list")
    return p


def client(name: str):
    """The function that MODULE:FUNCTION names."""
    module, _, function = name.partition(":")
    try:
        return getattr(importlib.import_module(module), function)
    except (ImportError, AttributeError, ValueError) as e:
        raise ValueError(f"no client {name!r}: {e}") from e


def run(args: argparse.Namespace, spark, out=sys.stdout) -> int:
    from wayfold.engine import Engine

    reading = args.command in ("activities", "tile", "render")
    if args.in_memory and reading:
        raise ValueError("nothing to read from a store in memory")
    if args.in_memory:
        own = tempfile.mkdtemp()
        try:
            return _command(args, Engine(spark, own), out)
        finally:
            shutil.rmtree(own, ignore_errors=True)
    return _command(args, Engine(spark, args.db if "://" in args.db else os.path.abspath(args.db), create=not reading), out)


def _command(args: argparse.Namespace, engine, out) -> int:
    from wayfold.functions.geo import parse_point

    some = {k: getattr(args, k) for k in ("before", "after", "filter") if getattr(args, k, None) is not None}
    if args.command == "activities":
        if args.count:
            print(engine.count(**some), file=out)
        else:
            for r in engine.json_lines(**some).toLocalIterator():
                print(r[0], file=out)
    elif args.command == "import":
        got = engine.import_path(os.path.realpath(args.path), os.path.realpath(args.join) if args.join else None, args.trim, args.reset)
        print(", ".join(f"{n} {k}" for k, n in got.items()), file=out)
    elif args.command in ("tile", "render"):
        look = {"color": args.color, "gradient": args.gradient, "width": args.width}
        data = engine.tile(args.tile, **look, **some) if args.command == "tile" else engine.render(args.bounds, height=args.height, **look, **some)
        if data is None:
            raise ValueError("no stored zoom serves this tile")
        with open(args.output, "wb") as f:
            f.write(data)
    elif args.command == "mask":
        if args.action == "add":
            engine.store.add_mask(args.name, *parse_point(args.latlng), args.radius)
        elif args.action == "remove":
            engine.store.remove_mask(args.name)
        else:
            for line in engine.mask_lines():
                print(line, file=out)
    elif args.command == "serve":
        from wayfold.serve import server

        sources = {k: client(v) for k, _, v in (x.partition("=") for x in args.client)}
        detail = client(args.detail) if args.detail else None
        server(engine, args.host, args.port, sources, detail, upload=args.upload, render=args.render, fetch=args.fetch, webhook=args.strava_webhook, cors=args.cors).serve_forever()
    elif args.command == "fetch":
        print(f"{engine.fetch(client(args.client), date.today(), args.lookback)} from {args.source}", file=out)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("wayfold").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if not args.verbose:
        spark.sparkContext.setLogLevel("ERROR")
    try:
        return run(args, spark)
    except (ValueError, KeyError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
