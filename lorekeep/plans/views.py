"""The engine's tables as views of the driver's: documents as sources, embeddings as vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.text import source_hash
from lorekeep.operators.chunking import plain_chunks


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("source").alias("collection"), F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".pdf")).alias("path"), source_hash(F.col("text")).alias("source_hash"), F.col("text").alias("content"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_chunks(sources(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    path = F.concat(F.lit("v"), F.expr("vec_id div 5"))
    return rows.select(F.concat(F.lit("label-"), F.col("label")).alias("collection"), path.alias("path"), (F.col("vec_id") % 5).alias("chunk_sequence"), F.concat(F.lit("vector "), F.col("vec_id")).alias("body"), "embedding", "vec_id")


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of documents; the first of each has the embedding of its number, if any, the others have none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("source").alias("collection"), F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".pdf")).alias("path"), F.col("text").alias("content"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("of"), F.lit(0).cast("long").alias("at"), "embedding")
    cut = plain_chunks(docs)
    return cut.join(rows, (cut["doc_id"] == rows["of"]) & (cut["chunk_sequence"] == rows["at"]), "left").select("collection", "path", "chunk_sequence", "body", "embedding")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector searched for: that of number 0."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id = 0").select("embedding").head(1)
    return list(rows[0]["embedding"]) if rows else []


def states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, sources, disk): a state of the store and of the disk after changes, by the last digit of doc_id.

    0 is new on disk, 1 gone from disk, 2 touched, 3 changed, 4 unchanged but without its source; others as
    they were.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    digit = F.col("doc_id") % 10
    base = docs.select("doc_id", F.col("source").alias("collection"), F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".pdf")).alias("path"), F.col("text").alias("content"))
    time = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id"))
    held = base.where(digit != 0).select("collection", "path", time.alias("modified_at"), F.sha2("content", 256).alias("source_hash"))
    stored = base.where((digit != 0) & (digit != 4)).select("collection", "path", F.sha2("content", 256).alias("source_hash"), "content")
    later = F.when(digit.isin(2, 3), F.timestamp_seconds(F.lit(1_800_000_000) + F.col("doc_id"))).otherwise(time)
    changed = F.when(digit == 3, F.concat("content", F.lit(" changed"))).otherwise(F.col("content"))
    disk = base.where(digit != 1).select("collection", "path", later.alias("mtime"), F.sha2(changed, 256).alias("source_hash"), changed.alias("content"))
    return held, stored, disk
