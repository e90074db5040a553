"""Command line: ``python -m arrowfen serve | init | show config | show metrics``."""

from __future__ import annotations

import argparse
import json
import os

from .config import AppConfig, load_config
from .functions.embed import embedder, remembered, retried


def main() -> None:
    top = argparse.ArgumentParser(prog="arrowfen")
    commands = top.add_subparsers(dest="command", required=True)
    run = commands.add_parser("serve", help="answer HTTP requests")
    run.add_argument("--port", type=int, default=int(os.environ.get("PORT", "6333")))
    init = commands.add_parser("init", help="write a settings file")
    init.add_argument("path", nargs="?", default="arrowfen.json")
    commands.add_parser("show").add_argument("what", choices=["config", "metrics"])
    args = top.parse_args()
    if args.command == "init":
        with open(args.path, "x") as f:
            json.dump(AppConfig().shown(), f, indent=2)
        return
    config = load_config()
    if args.command == "show" and args.what == "config":
        print(json.dumps(config.shown(), indent=2))
        return
    from pyspark.sql import SparkSession

    from .service import Service, serve

    provider = os.environ.get("EMBEDDING_PROVIDER")
    own = remembered(retried(embedder(provider, os.environ.get("EMBEDDING_MODEL", ""), os.environ.get("EMBEDDING_BASE_URL"), os.environ.get("EMBEDDING_API_KEY")))) if provider else None
    service = Service(SparkSession.builder.appName("arrowfen").getOrCreate(), os.path.abspath(config.data_dir), config, own)
    if args.command == "show":
        print(json.dumps(service.handle("GET", "/api/metrics")[1], indent=2))
        return
    serve(service, args.port, "0.0.0.0").serve_forever()


if __name__ == "__main__":
    main()
