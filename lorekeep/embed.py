"""Embedders, their presets, and batched embedding of chunks."""

from __future__ import annotations

import hashlib
import json
import math
import urllib.error
import urllib.request
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.errors import EmbeddingError, UnsupportedModel

#: Passages in one model call.
BATCH = 32
#: Bytes of a failed response that are shown.
SHOWN = 512
HTTP_PREFIX = "ollama:"
DEFAULT_MODEL = "cl-nagoya/ruri-v3-30m"


@dataclass(frozen=True)
class Preset:
    """A model's width and what is put before queries and passages."""

    dim: int
    query_prefix: str
    passage_prefix: str


#: The models that are known by name.
PRESETS = {
    "cl-nagoya/ruri-v3-30m": Preset(256, "検索クエリ: ", "検索文書: "),
    "sentence-transformers/all-MiniLM-L6-v2": Preset(384, "", ""),
    "google/embeddinggemma-300m": Preset(768, "task: search result | query: ", "title: none | text: "),
}


class Embedder(Protocol):
    """One vector of `dim` numbers for each input, in order."""

    model_id: str
    dim: int

    def embed_queries(self, texts: Sequence[str]) -> list[list[float]]: ...

    def embed_passages(self, texts: Sequence[str]) -> list[list[float]]: ...


def classify(model: str) -> str:
    """D3: ``preset`` or ``http``; others are not supported."""
    if model in PRESETS:
        return "preset"
    if model.startswith(HTTP_PREFIX) and len(model) > len(HTTP_PREFIX):
        return "http"
    raise UnsupportedModel(model)


def prefixed(text: Column, prefix: str) -> Column:
    """D4."""
    return F.concat(F.lit(prefix), text)


def declared_dim(model: str, pinned: int | None, probe: Embedder | None = None) -> int:
    """A preset's width; for others the table's, else what a probe returns."""
    if classify(model) == "preset":
        return PRESETS[model].dim
    if pinned is not None:
        return pinned
    if probe is None:
        raise EmbeddingError(f"the width of {model} is not known")
    return len(probe.embed_queries(["dim probe"])[0])


class HashEmbedder:
    """Deterministic vectors from hashed tokens, of length 1: for tests and for corpora without a model."""

    def __init__(self, model_id: str = DEFAULT_MODEL, dim: int | None = None):
        self.model_id = model_id
        preset = PRESETS.get(model_id)
        self.dim = dim or (preset.dim if preset else 256)
        self.prefixes = (preset.query_prefix, preset.passage_prefix) if preset else ("", "")

    def _vector(self, text: str) -> list[float]:
        vector = [0.0] * self.dim
        for token in text.lower().split():
            raw = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
            vector[raw % self.dim] += 1.0 if raw >> 63 else -1.0
        length = max(math.sqrt(sum(x * x for x in vector)), 1e-12)
        return [x / length for x in vector]

    def embed_queries(self, texts: Sequence[str]) -> list[list[float]]:
        return [self._vector(self.prefixes[0] + t) for t in texts]

    def embed_passages(self, texts: Sequence[str]) -> list[list[float]]:
        return [self._vector(self.prefixes[1] + t) for t in texts]


class ConstantEmbedder:
    """One value throughout: the mock of the tests."""

    def __init__(self, query: float = 0.1, passage: float = 0.2, dim: int = 256, model_id: str = DEFAULT_MODEL):
        self.query, self.passage, self.dim, self.model_id = query, passage, dim, model_id

    def embed_queries(self, texts: Sequence[str]) -> list[list[float]]:
        return [[self.query] * self.dim for _ in texts]

    def embed_passages(self, texts: Sequence[str]) -> list[list[float]]:
        return [[self.passage] * self.dim for _ in texts]


class HttpEmbedder:
    """POST {base}/api/embed with model and input; no prefixes."""

    def __init__(self, model: str, base: str, dim: int | None = None, timeout: float = 60.0):
        self.model_id, self.base, self.timeout = HTTP_PREFIX + model, base.rstrip("/"), timeout
        self.model = model
        self.dim = dim or len(self._call(["dim probe"])[0])

    def _call(self, texts: Sequence[str]) -> list[list[float]]:
        request = urllib.request.Request(f"{self.base}/api/embed", json.dumps({"model": self.model, "input": list(texts)}).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                vectors = json.load(reply)["embeddings"]
        except urllib.error.HTTPError as e:
            shown = "".join(c if c.isprintable() else " " for c in e.read(SHOWN).decode("utf-8", "replace"))
            raise EmbeddingError(f"status {e.code}: {shown}") from e
        except (OSError, ValueError, KeyError) as e:
            raise EmbeddingError(str(e)) from e
        if len(vectors) != len(texts):
            raise EmbeddingError(f"{len(vectors)} vectors for {len(texts)} texts")
        return vectors

    embed_queries = embed_passages = lambda self, texts: self._call(texts)


def build_embedder(model: str, endpoint: str | None = None, dim: int | None = None) -> Embedder:
    """The embedder of a configured model. Presets have no weights offline: hashed tokens stand in for them."""
    if classify(model) == "http":
        return HttpEmbedder(model.removeprefix(HTTP_PREFIX), endpoint or "http://localhost:11434", dim)
    return HashEmbedder(model)


def embedded(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """Chunks with `embedding`; empty bodies keep null and are not sent. The model sees 32 passages a call."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for bodies in batches:
            out: list[list[float] | None] = [None] * len(bodies)
            full = [k for k, b in enumerate(bodies) if b]
            for at in range(0, len(full), BATCH):
                part = full[at : at + BATCH]
                vectors = embedder.embed_passages([bodies.iloc[k] for k in part])
                if len(vectors) != len(part) or any(len(v) != embedder.dim for v in vectors):
                    raise ValueError("the embedder returned vectors of a wrong number or width")
                for k, v in zip(part, vectors, strict=True):
                    out[k] = v
            yield pd.Series(out, dtype=object)

    return chunks.withColumn("embedding", embed("body"))
