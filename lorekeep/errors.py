"""Errors with a stable code and details."""

from __future__ import annotations

from typing import Any


class LorekeepError(Exception):
    code = "internal"

    def __init__(self, message: str, **details: Any):
        super().__init__(message)
        self.details = details

    def as_dict(self) -> dict[str, Any]:
        return {"code": self.code, "message": str(self), "details": self.details}


class EmptyQuery(LorekeepError):
    code = "empty_query"

    def __init__(self) -> None:
        super().__init__("query must be non-empty")


class InvalidLimit(LorekeepError):
    code = "invalid_limit"

    def __init__(self) -> None:
        super().__init__("limit must be at least 1")


class UnknownCollection(LorekeepError):
    code = "unknown_collection"

    def __init__(self, name: str):
        super().__init__(f"unknown collection: {name}", collection=name)


class NotFound(LorekeepError):
    code = "not_found"

    def __init__(self, collection: str, path: str):
        super().__init__(f"no document {path} in {collection}", collection=collection, path=path)


class ChunkNotFound(LorekeepError):
    code = "not_found"

    def __init__(self, collection: str, path: str, chunk_sequence: int):
        super().__init__(f"no chunk {chunk_sequence} of {path} in {collection}", collection=collection, path=path, chunk_sequence=chunk_sequence)


class PayloadTooLarge(LorekeepError):
    code = "payload_too_large"

    def __init__(self, size: int, limit: int):
        super().__init__(f"{size} bytes are more than the limit of {limit}", size_bytes=size, limit_bytes=limit)


class InvalidChunkRange(LorekeepError):
    code = "invalid_chunk_range"

    def __init__(self, chunk: int | None, chunk_end: int):
        if chunk is None:
            super().__init__("an end of a chunk range needs a start")
        else:
            super().__init__(f"chunk range ends at {chunk_end}, before its start {chunk}", chunk=chunk, chunk_end=chunk_end)


class IndexOutdated(LorekeepError):
    code = "index_outdated"

    def __init__(self, model: str):
        super().__init__(f"the index has no chunk ranges; rebuild it with: vector use {model}", embedding_model=model)


class SchemaMetadataMissing(LorekeepError):
    code = "schema_metadata_missing"

    def __init__(self, absent: list[str]):
        super().__init__(f"the index lacks: {', '.join(absent)}", absent_keys=absent)


class SchemaMismatch(LorekeepError):
    """Ingest under another model than the index was built with."""


class IndexOutOfSync(LorekeepError):
    """A source and its chunks are of different states."""

    def __init__(self, collection: str, path: str):
        super().__init__(f"the chunks of {path} in {collection} do not fit its source; update the index")


class ConfigError(LorekeepError):
    pass


class EmbeddingError(LorekeepError):
    pass


class UnsupportedModel(LorekeepError):
    def __init__(self, model: str):
        super().__init__(f"unsupported embedding model: {model}")


class ExtractError(LorekeepError):
    pass


class ArchiveError(LorekeepError):
    pass
