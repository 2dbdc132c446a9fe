"""Command line: build, search, blast, stats, watch, serve, rpc."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession

from codestrata.project import Project


def session(name: str = "codestrata") -> SparkSession:
    """A session with the engine's defaults; a cluster's own settings win."""
    return SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="codestrata")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("build", "search", "blast", "stats", "watch", "serve", "rpc"):
        command = commands.add_parser(name)
        command.add_argument("--project", "-p", default=".")
        command.add_argument("--store")
        if name == "search":
            command.add_argument("--query", "-q", required=True)
            command.add_argument("--mode", default="hybrid", choices=["auto", "hybrid", "keyword", "semantic"])
        if name == "blast":
            command.add_argument("--file", "-f", required=True)
        if name == "serve":
            command.add_argument("--port", type=int, default=8000)
        if name == "watch":
            command.add_argument("--interval", type=float, default=2.0)
    args = parser.parse_args(argv)
    spark = session()
    project = Project(spark, args.project, args.store)
    show = lambda x: print(json.dumps(x, indent=2, default=str))
    if args.command == "build":
        show(project.build())
    elif args.command == "search":
        show(project.search(args.query, args.mode))
    elif args.command == "blast":
        show(project.blast(args.file))
    elif args.command == "stats":
        show(project.stats())
    elif args.command == "watch":
        from codestrata.streaming.watch import Watcher

        watcher = Watcher(spark, project, args.interval)
        query = watcher.start()
        try:
            query.awaitTermination()
        except KeyboardInterrupt:
            watcher.stop()
    elif args.command == "serve":
        from codestrata.server import make_server

        server = make_server(project, args.port)
        print(f"http://127.0.0.1:{args.port}")
        try:
            server.serve_forever()
        except KeyboardInterrupt:
            server.shutdown()
            time.sleep(0.1)
    else:
        from codestrata.rpc import Server

        Server(project).run()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
