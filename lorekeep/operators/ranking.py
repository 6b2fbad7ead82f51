"""Vector search, fusion, folding to documents, order and enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import vectors
from lorekeep.operators.bm25 import KEY, in_collections

DOCUMENT = ("collection", "path")
#: Chunk rows asked for per document wanted, and the constant of reciprocal ranks.
OVER_FETCH, RANK_BASE = 10, 60


def fetch_size(limit: int, level: str) -> int:
    """How many chunk rows are taken before they are folded."""
    return min(limit * OVER_FETCH, 2**31 - 1) if level == "doc" else limit


def vector_scored(chunks: DataFrame, query: Sequence[float] | Column, *, collections: Sequence[str] = ()) -> DataFrame:
    """Chunks with a vector, with `score`, to six decimals."""
    wanted = query if isinstance(query, Column) else vectors.literal(query)
    found = chunks.where(in_collections(collections) & F.col("embedding").isNotNull())
    score = vectors.distance_to_score(vectors.cosine_distance(F.col("embedding"), wanted))
    return found.select(*KEY, "body", F.round(score, 6).alias("score"))


def by_chunk() -> list[Column]:
    """E12."""
    return [F.desc("score"), F.asc("collection"), F.asc("path"), F.asc("chunk_sequence")]


def by_document() -> list[Column]:
    """E13."""
    return [F.desc("score"), F.asc("collection"), F.asc("path")]


def top(scored: DataFrame, size: int) -> DataFrame:
    """The best rows in the order of chunks; a partial sort in each task, and a merge of as many rows."""
    return scored.orderBy(*by_chunk()).limit(size)


def ranked(scored: DataFrame, size: int, name: str) -> DataFrame:
    """The best rows with their rank from 1 on. The window holds `size` rows, which the limit above it bounds."""
    return top(scored, size).withColumn(name, F.row_number().over(Window.orderBy(*by_chunk())))


def fused(text: DataFrame, vector: DataFrame, size: int, base: int = RANK_BASE) -> DataFrame:
    """Reciprocal rank fusion of the best rows of both lists; a chunk of one list has one term."""
    a = ranked(text, size, "text_rank").select(*KEY, F.col("body").alias("text_body"), "text_rank")
    b = ranked(vector, size, "vector_rank").select(*KEY, F.col("body").alias("vector_body"), "vector_rank")
    part = lambda rank: F.coalesce(F.lit(1.0) / (F.lit(float(base)) + F.col(rank)), F.lit(0.0))
    both = a.join(b, list(KEY), "full_outer")
    score = F.round(part("text_rank") + part("vector_rank"), 6)
    return top(both.select(*KEY, F.coalesce("text_body", "vector_body").alias("body"), score.alias("score")), size)


def folded(fetched: DataFrame) -> DataFrame:
    """Documents with their best score, the body of its first chunk, and how many fetched rows they have."""
    best = Window.partitionBy(*DOCUMENT).orderBy(F.desc("score"), F.asc("chunk_sequence"))
    every = Window.partitionBy(*DOCUMENT)
    rows = fetched.withColumn("_r", F.row_number().over(best)).withColumn("matched_chunks", F.count(F.lit(1)).over(every))
    return rows.where("_r = 1").select(*DOCUMENT, "score", "body", "matched_chunks")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Chunks of each document, empty ones included."""
    return chunks.groupBy(*DOCUMENT).agg(F.count(F.lit(1)).alias("chunk_count"))


def kept(hits: DataFrame) -> DataFrame:
    """hits as rows of the driver, so that what scored them is run once. Only for as many as a request's limit asks for."""
    return hits.sparkSession.createDataFrame(hits.collect(), hits.schema)


def of_documents(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Those rows that belong to a document of hits (as kept() returns them); the filter on paths reaches the scan, which skips row groups."""
    wanted = sorted({(r["collection"], r["path"]) for r in hits.select(*DOCUMENT).collect()})
    if not wanted:
        return rows.where(F.lit(False))
    here = rows.where(F.col("path").isin(*sorted({p for _, p in wanted})) & F.col("collection").isin(*sorted({c for c, _ in wanted})))
    # As many pairs as there are hits.
    return here.join(F.broadcast(rows.sparkSession.createDataFrame(wanted, "collection string, path string")), list(DOCUMENT), "left_semi")


def enriched(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits with chunk_count, 0 where the document is gone. Hits are at most a search's limit; chunks of other documents are not read."""
    hits = kept(hits)
    counts = chunk_counts(of_documents(chunks.select(*DOCUMENT), hits))
    return hits.join(counts, list(DOCUMENT), "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)).cast("long"))


def without_nulls(rows: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows that have every required column."""
    return rows.dropna(subset=list(required))


def documents(scored: DataFrame, chunks: DataFrame, limit: int, snippet: Column) -> DataFrame:
    """Document hits: over-fetched, folded, ordered, cut and enriched."""
    hits = folded(top(scored, fetch_size(limit, "doc"))).orderBy(*by_document()).limit(limit)
    hits = hits.withColumn("snippet", snippet).drop("body")
    return enriched(hits, chunks).select(*DOCUMENT, "score", "snippet", "matched_chunks", "chunk_count")


def passages(scored: DataFrame, chunks: DataFrame, limit: int, snippet: Column) -> DataFrame:
    """Chunk hits."""
    hits = top(scored, limit).withColumn("snippet", snippet).drop("body")
    return enriched(hits, chunks).select(*KEY, "score", "snippet", "chunk_count")
