"""The configuration as YAML, checked when it is read and replaced as a whole when it is written."""

from __future__ import annotations

import os
import re
from dataclasses import asdict, dataclass, field
from typing import Any

import yaml

from lorekeep.embed import DEFAULT_MODEL, classify
from lorekeep.errors import ConfigError, UnsupportedModel

FILE = "config.yml"
DEFAULT_ENDPOINT = "http://localhost:11434"
MEMORY_MB, PARALLELISM, MOST_PARALLEL, MAX_BYTES = 8192, 8, 1024, 1 << 20


@dataclass
class Collection:
    path: str
    description: str | None = None


@dataclass
class Config:
    model: str = DEFAULT_MODEL
    endpoint: str = DEFAULT_ENDPOINT
    collections: dict[str, Collection] = field(default_factory=dict)
    memory_limit_mb: int = MEMORY_MB
    embed_parallelism: int = PARALLELISM
    cli_max_bytes: int = MAX_BYTES
    mcp_max_bytes: int = MAX_BYTES

    def parallelism(self) -> int:
        """0 stands for one at a time; large numbers are cut."""
        return min(self.embed_parallelism, MOST_PARALLEL)


def validate_collection_name(name: str) -> str:
    if not name:
        raise ConfigError("collection name must not be empty")
    if len(name.encode()) > 64:
        raise ConfigError(f"collection name {name!r} must be 64 characters or fewer")
    if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
        raise ConfigError(f"collection name {name!r} must contain only ASCII letters, digits, '-' or '_'")
    return name


def validate_embedding_model(model: str) -> str:
    try:
        classify(model)
    except UnsupportedModel as e:
        raise ConfigError(str(e)) from e
    return model


def _section(tree: dict[str, Any], name: str) -> dict[str, Any]:
    found = tree.get(name) or {}
    if not isinstance(found, dict):
        raise ConfigError(f"{name} must be a mapping")
    return found


def _count(section: dict[str, Any], key: str, default: int) -> int:
    value = section.get(key, default)
    if not isinstance(value, int) or isinstance(value, bool) or value < 0:
        raise ConfigError(f"{key} must be a whole number, 0 or more")
    return value


def parse(text: str) -> Config:
    try:
        tree = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(f"not YAML: {e}") from e
    if not isinstance(tree, dict):
        raise ConfigError("the configuration must be a mapping")
    embedding, runtime, get = (_section(tree, k) for k in ("embedding", "runtime", "get"))
    if not isinstance(embedding.get("model"), str):
        raise ConfigError("embedding.model is missing")
    collections = {}
    for name, entry in sorted(_section(tree, "collections").items()):
        if not isinstance(entry, dict) or not isinstance(entry.get("path"), str):
            raise ConfigError(f"collection {name} has no path")
        collections[validate_collection_name(str(name))] = Collection(entry["path"], entry.get("description"))
    return Config(
        validate_embedding_model(embedding["model"]), _section(embedding, "ollama").get("endpoint", DEFAULT_ENDPOINT), collections,
        _count(runtime, "memory_limit_mb", MEMORY_MB), _count(runtime, "embed_parallelism", PARALLELISM), _count(get, "cli_max_bytes", MAX_BYTES), _count(get, "mcp_max_bytes", MAX_BYTES),
    )


def dump(config: Config) -> str:
    embedding: dict[str, Any] = {"model": config.model}
    if config.endpoint != DEFAULT_ENDPOINT:
        embedding["ollama"] = {"endpoint": config.endpoint}
    entries = {n: {k: v for k, v in asdict(c).items() if v is not None} for n, c in sorted(config.collections.items())}
    tree = {
        "collections": entries, "embedding": embedding,
        "runtime": {"memory_limit_mb": config.memory_limit_mb, "embed_parallelism": config.embed_parallelism},
        "get": {"cli_max_bytes": config.cli_max_bytes, "mcp_max_bytes": config.mcp_max_bytes},
    }
    return yaml.safe_dump(tree, sort_keys=False, allow_unicode=True)


def load(directory: str) -> Config:
    path = os.path.join(directory, FILE)
    try:
        with open(path, encoding="utf-8") as f:
            return parse(f.read())
    except OSError as e:
        raise ConfigError(f"cannot read {path}: {e.strerror}") from e


def save(directory: str, config: Config) -> None:
    path = os.path.join(directory, FILE)
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        f.write(dump(config))
    os.replace(path + ".tmp", path)
