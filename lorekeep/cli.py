"""The command line. Exit codes: 0 done, 1 failed, 2 wrong usage."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from lorekeep import __version__, api
from lorekeep.embed import build_embedder, declared_dim
from lorekeep.errors import ConfigError, LorekeepError
from lorekeep.plans import config as configs
from lorekeep.plans import ingest
from lorekeep.plans.config import Collection, Config
from lorekeep.plans.search import SearchEngine, SearchRequest
from lorekeep.plans.store import Store
from lorekeep.render import FORMATS, render, render_collections, render_status
from lorekeep.sources.archives import archive_kind


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lorekeep")
    top.add_argument("--config-dir", default=os.path.expanduser("~/.lorekeep"))
    top.add_argument("--version", action="version", version=f"lorekeep v{__version__}")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("init", help="create the configuration and empty tables")
    commands.add_parser("version")
    commands.add_parser("update-all", help="bring every collection up to date")
    formats = argparse.ArgumentParser(add_help=False)
    formats.add_argument("--format", choices=FORMATS, default="human")
    collection = commands.add_parser("collection").add_subparsers(dest="action", required=True)
    add = collection.add_parser("add")
    add.add_argument("path")
    add.add_argument("--name")
    add.add_argument("--description")
    collection.add_parser("list", parents=[formats])
    search = commands.add_parser("search").add_subparsers(dest="mode", required=True)
    for mode in ("fts", "vector", "hybrid"):
        one = search.add_parser(mode, parents=[formats])
        one.add_argument("query")
        one.add_argument("-c", "--collections", "--collection", action="append", default=[])
        one.add_argument("-n", "--limit", type=int, default=20)
        one.add_argument("--chunks", action="store_true")
    use = commands.add_parser("vector").add_subparsers(dest="action", required=True).add_parser("use")
    use.add_argument("model")
    use.add_argument("-y", "--yes", action="store_true")
    get = commands.add_parser("get")
    get.add_argument("collection")
    get.add_argument("path")
    get.add_argument("--chunk", type=int)
    get.add_argument("--chunk-end", type=int)
    get.add_argument("-f", "--no-size-limit", action="store_true")
    commands.add_parser("status", parents=[formats])
    return top


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(arguments)
    if args.command == "version":
        print(f"lorekeep v{__version__}")
        return 0
    try:
        return run(args, spark)
    except LorekeepError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def run(args: argparse.Namespace, spark: SparkSession | None) -> int:
    place = os.path.abspath(args.config_dir)
    if args.command == "collection" and args.action == "add":
        return _add(args, place)
    spark = spark or SparkSession.builder.appName("lorekeep").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, f"file://{place}/index")
    if args.command == "init":
        os.makedirs(place, exist_ok=True)
        if not os.path.exists(os.path.join(place, configs.FILE)):
            configs.save(place, Config())
        config = configs.load(place)
        store.create(config.model, declared_dim(config.model, None) if config.model in _presets() else build_embedder(config.model, config.endpoint).dim)
        return 0
    config = configs.load(place)
    if args.command == "collection":
        print(render_collections(api.collection_list(store, config), args.format), end="")
    elif args.command == "status":
        print(render_status(api.status(store, config), args.format), end="")
    elif args.command == "get":
        span = api.parse_span(args.chunk, args.chunk_end)
        text = api.get_chunks(store, config, args.collection, args.path, *span) if span else api.get_document(store, config, args.collection, args.path)
        print(api.check_size(text, 0 if args.no_size_limit else config.cli_max_bytes), end="")
    elif args.command == "search":
        return _search(args, spark, store, config)
    elif args.command == "update-all":
        return _summary(ingest.update_all(spark, store, config, build_embedder(config.model, config.endpoint)))
    elif args.command == "vector":
        return _use(args, place, spark, store, config)
    return 0


def _presets() -> set[str]:
    from lorekeep.embed import PRESETS

    return set(PRESETS)


def _add(args: argparse.Namespace, place: str) -> int:
    config = configs.load(place)
    path = os.path.expanduser(args.path)
    if not os.path.exists(path):
        raise ConfigError(f"{args.path} does not exist")
    if not os.path.isdir(path) and not archive_kind(path):
        raise ConfigError(f"{args.path} is neither a directory nor an archive")
    if not args.name and not os.path.isdir(path):
        raise ConfigError("an archive needs --name")
    name = configs.validate_collection_name(args.name or os.path.basename(os.path.abspath(path)))
    if name in config.collections:
        raise ConfigError(f"collection {name} is there already")
    config.collections[name] = Collection(args.path if args.path.startswith("~") else os.path.abspath(path), args.description)
    configs.save(place, config)
    return 0


def _search(args: argparse.Namespace, spark: SparkSession, store: Store, config: Config) -> int:
    names = tuple(n for given in args.collections for n in given.split(",") if n)
    request = SearchRequest(args.query, names, args.limit, "chunk" if args.chunks else "doc")
    engine = SearchEngine(spark, store, config)
    engine.validate(request)  # before a model is loaded
    found = engine.fts(request) if args.mode == "fts" else getattr(engine, args.mode)(request, build_embedder(config.model, config.endpoint))
    print(render(found, args.format, color=sys.stdout.isatty() and "NO_COLOR" not in os.environ), end="")
    return 0


def _use(args: argparse.Namespace, place: str, spark: SparkSession, store: Store, config: Config) -> int:
    configs.validate_embedding_model(args.model)
    manifest = store.manifest()
    if ingest.model_action(config.model, args.model, manifest.embedding_model, manifest.ranges) == "none":
        print("nothing to do", file=sys.stderr)
        return 0
    if not args.yes and (not sys.stdin.isatty() or input("All chunks are built anew. Go on? [y/N] ").lower() not in ("y", "yes")):
        print("not confirmed; --yes goes on without asking", file=sys.stderr)
        return 1
    embedder = build_embedder(args.model, config.endpoint)
    config.model = args.model
    configs.save(place, config)
    return _summary(ingest.switch_model(spark, store, config, embedder))


def _summary(s: ingest.UpdateSummary) -> int:
    print(f"new {s.new}, updated {s.updated}, skipped {s.skipped}, removed {s.removed}, failed {s.failed}", file=sys.stderr)
    for name in s.unreadable:
        print(f"unreadable: {name}", file=sys.stderr)
    return int(bool(s.failed or s.unreadable))


if __name__ == "__main__":
    sys.exit(main())
