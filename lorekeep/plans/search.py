"""Requests, the three modes, and responses."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.embed import Embedder
from lorekeep.errors import EmptyQuery, IndexOutdated, InvalidLimit, UnknownCollection
from lorekeep.functions.text import fts_snippet, head_snippet
from lorekeep.operators import bm25, ranking, vector_index
from lorekeep.plans.config import Config
from lorekeep.plans.store import Store

LEVELS = ("doc", "chunk")


@dataclass(frozen=True)
class SearchRequest:
    query: str
    collections: tuple[str, ...] = ()
    limit: int = 20
    level: str = "doc"


@dataclass(frozen=True)
class Hit:
    """A document (matched_chunks) or a chunk (chunk_sequence)."""

    collection: str
    path: str
    score: float
    snippet: str
    chunk_count: int
    matched_chunks: int | None = None
    chunk_sequence: int | None = None


@dataclass(frozen=True)
class SearchResponse:
    query: str
    mode: str
    level: str
    collections: tuple[str, ...]
    limit: int
    total: int
    hits: tuple[Hit, ...]


class SearchEngine:
    """Search over one version of a store; nothing is read before a request is valid."""

    def __init__(self, spark: SparkSession, store: Store, config: Config, model: str | None = None, dim: int | None = None):
        self.spark, self.store, self.config = spark, store, config
        self.manifest = store.manifest()
        self.warning = store.check_pins(model or config.model, dim or self.manifest.vector_dim or 0, strict=False)
        if self.warning:
            warnings.warn(self.warning, stacklevel=2)

    def validate(self, request: SearchRequest) -> None:
        if not request.query.strip():
            raise EmptyQuery
        if request.limit < 1:
            raise InvalidLimit
        for name in request.collections:
            if name not in self.config.collections:
                raise UnknownCollection(name)
        if not self.manifest.ranges:
            raise IndexOutdated(self.config.model)

    def _chunks(self, request: SearchRequest) -> DataFrame:
        rows = self.store.table("chunks", self.manifest, request.collections)
        return ranking.without_nulls(rows, ["collection", "path", "chunk_sequence", "body"])

    def _text(self, request: SearchRequest) -> DataFrame:
        """Scores from the stored index: term rows alone are read, and bodies of what may be shown."""
        index = self.store.table("postings", self.manifest)
        chunks, length = self.store.sums(self.manifest)
        stats = bm25.index_statistics(index, bm25.query_tokens(request.query), chunks, length)
        scored = bm25.scored_from_index(index, request.query, stats, collections=request.collections)
        best = ranking.kept(ranking.top(scored, ranking.fetch_size(request.limit, request.level)))
        return self._with_bodies(request, best)

    def _with_bodies(self, request: SearchRequest, best: DataFrame) -> DataFrame:
        """Bodies of what may be shown, at most ten times the limit of a request; row groups of other paths are not read."""
        return ranking.of_documents(self._chunks(request), best).select(*bm25.KEY, "body").join(F.broadcast(best), list(bm25.KEY))

    def _vector(self, request: SearchRequest, vector: Sequence[float]) -> DataFrame:
        """Scores from the cells nearest to the query where a collection has an index, from all its chunks elsewhere."""
        names = sorted(c for c in self.manifest.tables["chunks"] if not request.collections or c in request.collections)
        cells = {c: found for c in names if (found := self.store.cells(self.manifest, c))}
        plain = [c for c in names if c not in cells]
        size = ranking.fetch_size(request.limit, request.level)
        parts = [ranking.top(ranking.vector_scored(self._chunks(replace(request, collections=tuple(plain))), vector), size).drop("body")] if plain or not names else []
        parts += [vector_index.search(self.store.table("vectors", self.manifest, [c]), found, vector, size) for c, found in cells.items()]
        return self._with_bodies(request, ranking.kept(ranking.top(reduce(DataFrame.unionByName, parts), size)))

    def fts_df(self, request: SearchRequest) -> DataFrame:
        return self._hits(request, self._text(request), True)

    def vector_df(self, request: SearchRequest, vector: Sequence[float]) -> DataFrame:
        return self._hits(request, self._vector(request, vector), False)

    def hybrid_df(self, request: SearchRequest, vector: Sequence[float]) -> DataFrame:
        size = ranking.fetch_size(request.limit, request.level)
        return self._hits(request, ranking.fused(self._text(request), self._vector(request, vector), size), False)

    def _hits(self, request: SearchRequest, scored: DataFrame, verbatim: bool) -> DataFrame:
        snippet = fts_snippet(F.col("body"), request.query) if verbatim else head_snippet(F.col("body"))
        shape = ranking.documents if request.level == "doc" else ranking.passages
        return shape(scored, self._chunks(request), request.limit, snippet)

    def fts(self, request: SearchRequest) -> SearchResponse:
        self.validate(request)
        return self._respond(request, "fts", self.fts_df(request))

    def vector(self, request: SearchRequest, embedder: Embedder) -> SearchResponse:
        self.validate(request)
        return self._respond(request, "vector", self.vector_df(request, embedder.embed_queries([request.query])[0]))

    def hybrid(self, request: SearchRequest, embedder: Embedder) -> SearchResponse:
        self.validate(request)
        return self._respond(request, "hybrid", self.hybrid_df(request, embedder.embed_queries([request.query])[0]))

    def _respond(self, request: SearchRequest, mode: str, hits: DataFrame) -> SearchResponse:
        order = ranking.by_document() if request.level == "doc" else ranking.by_chunk()
        found = tuple(Hit(**r.asDict()) for r in hits.orderBy(*order).collect())  # at most the limit
        return SearchResponse(request.query, mode, request.level, request.collections, request.limit, len(found), found)
