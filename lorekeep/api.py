"""What callers and tools use: search, get_document, list_collections, status."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lorekeep import __version__
from lorekeep.embed import Embedder
from lorekeep.errors import ChunkNotFound, IndexOutOfSync, InvalidChunkRange, LorekeepError, NotFound, PayloadTooLarge, SchemaMetadataMissing, UnknownCollection
from lorekeep.operators import reading
from lorekeep.plans.config import Config
from lorekeep.plans.search import SearchEngine, SearchRequest
from lorekeep.plans.store import Store
from lorekeep.render import CollectionRow, StatusReport, as_dict


def parse_span(chunk: int | None, chunk_end: int | None) -> tuple[int, int | None] | None:
    """No start and no end: the whole document."""
    if chunk is None:
        if chunk_end is not None:
            raise InvalidChunkRange(None, chunk_end)
        return None
    if chunk_end is not None and chunk_end < chunk:
        raise InvalidChunkRange(chunk, chunk_end)
    return chunk, chunk_end


def check_size(content: str, limit: int) -> str:
    """G5."""
    size = len(content.encode())
    if limit and size > limit:
        raise PayloadTooLarge(size, limit)
    return content


def _declared(config: Config, collection: str) -> None:
    if collection not in config.collections:
        raise UnknownCollection(collection)


def get_document(store: Store, config: Config, collection: str, path: str) -> str:
    _declared(config, collection)
    found = reading.document(store.table("sources", collections=[collection]), collection, path).head(1)
    if not found:
        raise NotFound(collection, path)
    return found[0]["content"]


def get_chunks(store: Store, config: Config, collection: str, path: str, first: int, last: int | None = None) -> str:
    _declared(config, collection)
    store.check_layout(config.model)
    here = (F.col("collection") == collection) & (F.col("path") == path)
    manifest = store.manifest()
    chunks, sources = (store.table(t, manifest, [collection]).where(here) for t in ("chunks", "sources"))
    found = reading.chunk_spans(chunks, sources, first, last).head(1)
    if not found:
        if chunks.where(F.col("chunk_sequence") == first).head(1):
            raise IndexOutOfSync(collection, path)
        raise ChunkNotFound(collection, path, first)
    if found[0]["text"] is None:
        raise IndexOutOfSync(collection, path)
    return found[0]["text"]


def collection_list(store: Store, config: Config) -> list[CollectionRow]:
    rows = [(n, c.path, c.description) for n, c in config.collections.items()]
    configured = store.spark.createDataFrame(rows, "name string, path string, description string")
    return [CollectionRow(r["name"], r["path"], r["description"], r["document_count"]) for r in reading.collection_list(configured, store.table("sources")).collect()]


def status(store: Store, config: Config) -> StatusReport:
    manifest = store.manifest()
    absent = [k for k in ("embedding_model", "vector_dim") if getattr(manifest, k) is None]
    if absent:
        raise SchemaMetadataMissing(absent)
    row = reading.status(store.table("chunks", manifest), store.table("sources", manifest)).first()
    return StatusReport(__version__, manifest.embedding_model, manifest.vector_dim, len(config.collections), row["chunks"], row["sources"])


class Tools:
    """The three tools, taking and returning dictionaries; errors come back with their code."""

    def __init__(self, spark: SparkSession, store: Store, config: Config, embedder: Embedder):
        self.spark, self.store, self.config, self.embedder = spark, store, config, embedder

    def _guarded(self, call: Any) -> dict[str, Any]:
        try:
            return call()
        except LorekeepError as e:
            return {"error": e.as_dict()}

    def search(self, query: str, mode: str = "hybrid", collections: list[str] | None = None, k: int = 20, level: str = "doc") -> dict[str, Any]:
        def call() -> dict[str, Any]:
            request = SearchRequest(query, tuple(collections or ()), k, level)
            engine = SearchEngine(self.spark, self.store, self.config)
            return as_dict(engine.fts(request) if mode == "fts" else getattr(engine, mode)(request, self.embedder))

        return self._guarded(call)

    def get_document(self, collection: str, path: str, chunk: int | None = None, chunk_end: int | None = None) -> dict[str, Any]:
        def call() -> dict[str, Any]:
            span = parse_span(chunk, chunk_end)
            text = get_chunks(self.store, self.config, collection, path, *span) if span else get_document(self.store, self.config, collection, path)
            return {"collection": collection, "path": path, "content": check_size(text, self.config.mcp_max_bytes)}

        return self._guarded(call)

    def list_collections(self) -> dict[str, Any]:
        return self._guarded(lambda: {"collections": [c.__dict__ for c in collection_list(self.store, self.config)]})
