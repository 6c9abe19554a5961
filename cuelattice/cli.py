"""Command line: index, status, doctor, search, reconstruct and serve over a repository's workspace.

Embedder, planner and store are those that the configuration names (see
:mod:`cuelattice.factories`); the model ``hash-sha256-d32`` is the offline
embedder and the chat model ``rule`` the planner without a model.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys

from . import factories
from .config import ConfigError, resolve
from .server import serve


def configure_logging(verbose: bool = False) -> None:
    """Log to stderr; called again, it only sets the level."""
    log = logging.getLogger("cuelattice")
    if not any(getattr(h, "_ours", False) for h in log.handlers):
        handler = logging.StreamHandler(sys.stderr)
        handler.setFormatter(logging.Formatter("%(levelname)s %(name)s: %(message)s"))
        handler._ours = True
        log.addHandler(handler)
    log.setLevel(logging.DEBUG if verbose else logging.INFO)


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="cuelattice", description="Graph memory of a code repository")
    parser.add_argument("-v", "--verbose", action="store_true", help="log details")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("index", help="build or update the index").add_argument("repo")
    for name, text in (("status", "what is indexed"), ("doctor", "check the setup"), ("serve", "answer read tools over stdio")):
        sub.add_parser(name, help=text).add_argument("--repo", default=".")
    for name, text in (("search", "nearest cues"), ("reconstruct", "walk the graph")):
        p = sub.add_parser(name, help=text)
        p.add_argument("query")
        p.add_argument("-k", type=int, default=5)
        p.add_argument("--repo", default=".")
        if name == "reconstruct":
            p.add_argument("--budget", type=int, default=3)
    return parser


def main(argv: list[str] | None = None, spark=None, planner=None, out=print, env=os.environ) -> int:
    args = build_parser().parse_args(argv)
    configure_logging(args.verbose)
    from . import service as sv
    from .index import index_repository

    config = resolve(env, args.repo)
    manifest = config.workspace.load_manifest()
    if args.command == "doctor":
        checks = sv.doctor(config.workspace, manifest, config.embed_model)
        out(sv.render_doctor(checks))
        return 0 if all(c.ok for c in checks) else 1
    try:
        spark = spark or _session()
        store = factories.store(spark, config)
        if args.command == "status":
            out(sv.render_status(config.embed_model, config.embed_dim, store.indexed_files, manifest))
            return 0
        embedder = factories.embedder(config)
        if args.command == "index":
            out(sv.render_stats(index_repository(store, args.repo, embedder.column, embedder.model, embedder.dimensions)))
            return 0
        needs_planner = args.command == "reconstruct" or config.settings.llm_model
        planner = planner or (factories.planner(config.settings) if needs_planner else None)
    except (ConfigError, RuntimeError, ValueError) as e:
        out(f"error: {e}")
        return 2
    service = sv.Service(store.graph, embedder.embed, planner, factories.references(spark, config), getattr(args, "k", 5))
    if args.command == "serve":
        serve(service)
    elif args.command == "search":
        out(sv.render_search(service.search(args.query, args.k)))
    else:
        out(sv.render_reconstruct(service.reconstruct(args.query, args.budget)))
    return 0


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("cuelattice").getOrCreate()


if __name__ == "__main__":
    sys.exit(main())
