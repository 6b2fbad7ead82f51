"""Reads of documents and chunk ranges, and what the store holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOCUMENT = ["collection", "path"]


def document(sources: DataFrame, collection: str, path: str) -> DataFrame:
    """G1: the stored content of one document."""
    return sources.where((F.col("collection") == collection) & (F.col("path") == path)).select(*DOCUMENT, "content")


def chunk_spans(chunks: DataFrame, sources: DataFrame, first: int, last: int | None = None) -> DataFrame:
    """Of every document that has chunk `first`, the text from there to `last` (at most its last one).

    in_sync: the source has the hash of both chunks and the range lies within it; the text is null otherwise.
    Bytes are cut, so a window's overlap is not repeated.
    """
    span = chunks.where(F.col("chunk_sequence").between(first, first if last is None else last))
    ends = span.groupBy(*DOCUMENT).agg(
        F.min("chunk_sequence").alias("_first"), F.max("chunk_sequence").alias("last_chunk"),
        F.min_by(F.struct("source_start", "source_hash"), "chunk_sequence").alias("_a"), F.max_by(F.struct("source_end", "source_hash"), "chunk_sequence").alias("_z"),
    ).where(F.col("_first") == first)
    held = ends.join(sources.withColumnRenamed("source_hash", "_hash"), DOCUMENT)
    start, end = F.col("_a.source_start"), F.col("_z.source_end")
    sync = (F.col("_a.source_hash") == F.col("_hash")) & (F.col("_z.source_hash") == F.col("_hash")) & (start <= end) & (end <= F.octet_length("content"))
    cut = F.substring(F.encode("content", "UTF-8"), (start + 1).cast("int"), (end - start).cast("int"))
    text = F.when(sync & F.is_valid_utf8(cut.cast("string")), cut.cast("string"))
    return held.select(*DOCUMENT, "last_chunk", sync.alias("in_sync"), text.alias("text"))


def collection_list(collections: DataFrame, sources: DataFrame) -> DataFrame:
    """Configured collections (name, path, description) with their documents, in order of names."""
    counts = sources.groupBy(F.col("collection").alias("name")).agg(F.count(F.lit(1)).alias("document_count"))
    return collections.join(counts, "name", "left").withColumn("document_count", F.coalesce("document_count", F.lit(0)).cast("long")).orderBy("name")


def status(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Numbers of collections, chunks, embedded chunks and sources."""
    a = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("embedding").isNotNull()).alias("embedded")).first()
    return sources.agg(F.count_distinct("collection").alias("collections"), F.lit(a["chunks"]).cast("long").alias("chunks"), F.lit(a["embedded"]).cast("long").alias("embedded"), F.count(F.lit(1)).alias("sources"))
