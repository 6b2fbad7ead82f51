"""BM25 over chunk bodies.

Statistics are of the whole table, whatever collections a search is limited to. Query terms are joined by OR.
Constants are those of Robertson and Zaragoza (2009), and are parameters.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import once, query_tokens, tokens

K1, B = 1.2, 0.75
KEY = ("collection", "path", "chunk_sequence")


@dataclass(frozen=True)
class Statistics:
    """Chunks with a token, their mean length, and how many hold each term asked for."""

    chunks: int
    mean_length: float
    holding: dict[str, int]


def postings(chunks: DataFrame) -> DataFrame:
    """(term, collection, path, chunk_sequence, tf, length): the inverted index, one row a term and chunk."""
    worded = chunks.select(*KEY, tokens(F.col("body")).alias("_t")).withColumn("length", F.size("_t").cast("long"))
    return worded.select(*KEY, "length", F.explode("_t").alias("term")).groupBy("term", *KEY, "length").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(chunks: DataFrame) -> DataFrame:
    """(term, df, cf): chunks that hold a term and its occurrences."""
    held = chunks.select(tokens(F.col("body")).alias("_t"), F.monotonically_increasing_id().alias("_row"))
    each = held.select("_row", F.explode("_t").alias("term")).groupBy("term", "_row").agg(F.count(F.lit(1)).alias("tf"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: n_chunks with a token, total_length, avg_length."""
    length = F.size(tokens(F.col("body")))
    sums = chunks.select(length.alias("l")).where("l > 0").agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.sum("l"), F.lit(0)).cast("long").alias("total_length"))
    return sums.withColumn("avg_length", F.when(F.col("n_chunks") > 0, F.round(F.col("total_length") / F.col("n_chunks").cast("double"), 6)))


def statistics(chunks: DataFrame, terms: Sequence[str]) -> Statistics:
    """One pass over the bodies; what comes back is a row of as many numbers as the query has terms."""
    worded = chunks.select(tokens(F.col("body")).alias("_t")).where(F.size("_t") > 0)
    holding = [F.count_if(F.array_contains("_t", t)) for t in terms]
    n, total, *df = worded.agg(F.count(F.lit(1)), F.sum(F.size("_t")), *holding).first()
    return Statistics(n, (total or 0) / n if n else 0.0, dict(zip(terms, df, strict=True)))


def occurrences(column: str, term: str) -> Column:
    """How often an array of tokens holds a term."""
    return F.size(F.filter(column, lambda x: x == term))


def weight(tf: Column, length: Column, df: int, stats: Statistics, k1: float = K1, b: float = B) -> Column:
    """A term's share of the score of a chunk."""
    idf = F.log(F.lit(1.0) + F.lit(stats.chunks - df + 0.5) / F.lit(df + 0.5))
    tf = tf.cast("double")
    return idf * (tf * F.lit(k1 + 1)) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * length / F.lit(stats.mean_length or 1.0)))


def in_collections(collections: Sequence[str]) -> Column:
    """The filter on collections; none given means all."""
    return F.col("collection").isin(*collections) if collections else F.lit(True)


def scored(chunks: DataFrame, query: str, *, collections: Sequence[str] = (), stats: Statistics | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """Chunks (collection, path, chunk_sequence, body) that hold a query term, with `score`, to six decimals.

    Term frequencies are counted within the row: nothing is shuffled before the top rows are taken.
    """
    terms = query_tokens(query)
    stats = stats or statistics(chunks, terms)
    held = chunks.where(in_collections(collections)).select(*KEY, "body", once(tokens(F.col("body"))).alias("_t"))
    if not terms:
        return held.where(F.lit(False)).select(*KEY, "body", F.lit(0.0).alias("score"))
    counted = held.select(*KEY, "body", F.size("_t").cast("double").alias("_length"), once(F.array(*[occurrences("_t", t) for t in terms])).alias("_tf"))
    parts = [weight(F.col("_tf")[k], F.col("_length"), stats.holding[t], stats, k1, b) for k, t in enumerate(terms)]
    total = sum(parts[1:], parts[0])
    return counted.where(F.exists("_tf", lambda n: n > 0)).select(*KEY, "body", F.round(total, 6).alias("score"))


def index_statistics(index: DataFrame, terms: Sequence[str], chunks: int, total_length: int) -> Statistics:
    """The same numbers from stored postings and stored sums: only rows of the query's terms are read."""
    df = index.where(F.col("term").isin(*terms)).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect() if terms else []
    return Statistics(chunks, total_length / chunks if chunks else 0.0, {r["term"]: r["df"] for r in df})


def scored_from_index(index: DataFrame, query: str, stats: Statistics, *, collections: Sequence[str] = (), k1: float = K1, b: float = B) -> DataFrame:
    """(collection, path, chunk_sequence, score) from stored postings, of which only the query's terms are read."""
    terms = query_tokens(query)
    found = index.where(F.col("term").isin(*terms) & in_collections(collections)) if terms else index.where(F.lit(False))
    share = F.lit(0.0)
    for t, holding in stats.holding.items():
        share = F.when(F.col("term") == t, weight(F.col("tf"), F.col("length").cast("double"), holding, stats, k1, b)).otherwise(share)
    return found.groupBy(*KEY).agg(F.round(F.sum(share), 6).alias("score"))
