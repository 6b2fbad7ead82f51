"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding, in this order.

Each stage takes all that the one before kept, stored as Parquet, and its decisions take effect. Columns that an
operator does not use are given plain names while it runs, so that none can clash with its own, and their names back
after it. Null texts are texts without words; a stage over an empty table is empty; what else a stage does with nulls,
ties and repeated rows stands with it and with its operator.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import decontaminate, entropy_mix, hilbert_shards, line_frequency, near_dup
from lorekeep.llm.shared import global_rank, materialize, scratch, shared_dir, without

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Columns that operators read, by these names.
USED = ("doc_id", "text", "source", "lang")


def _plain(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with other columns than USED named column_0, column_1 and so on; and the new names in order."""
    names = [c if c in USED else f"column_{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def _restored(found: DataFrame, names: list[str], docs: DataFrame) -> DataFrame:
    return found.select(*[F.col(a).alias(b) for a, b in zip(names, docs.columns, strict=True)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that their host repeats; n_chars follows the text.

    Null texts are rejected, null sources are one host, repeated rows are judged alike.
    """
    rows, names = _plain(docs)
    kept = _restored(line_frequency.quality(rows.withColumn("whole_length", F.char_length("text")), clean=True).where("kept"), [*names, "whole_length"], docs.withColumn("whole_length", F.lit(0)))
    if "n_chars" in docs.columns:
        after = F.char_length("text")
        kept = kept.withColumn("n_chars", F.when(after < F.col("whole_length"), after).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least doc_id, and all that have no words.

    Sets are of five words, linked at a similarity of 0.8. Where doc_ids are null or stand for several rows, all rows
    are numbered in the order of doc_id (null last) and of a hash of all columns, and the first of a group stays:
    which one depends on what the rows hold, not on where they lie; of repeated rows one stays.
    """
    rows, names = _plain(docs)
    odd = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").limit(1).count()
    if odd:
        rows = global_rank(rows, [F.col("doc_id").asc_nulls_last(), F.xxhash64(*names)], "numbered")[0].withColumnRenamed("_rank", "_id")
    else:
        rows = rows.withColumn("_id", F.col("doc_id"))
    judged = near_dup.near_duplicates(rows.select(F.col("_id").alias("doc_id"), "text"))
    gone = judged.where("NOT kept").select(F.col("doc_id").alias("_id"))
    return _restored(without(rows, "_id", materialize(gone, "gone")), names, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Null texts stay; repeated rows, and others of one doc_id and text, go or stay together."""
    rows, names = _plain(docs)
    rows = rows.withColumn("_key", F.xxhash64("doc_id", "text"))
    judged = decontaminate.decontaminate(rows.select("doc_id", "text", F.col("_key").alias("row_key")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = judged.where("contaminated").select(F.col("row_key").alias("_key"))
    return _restored(without(rows, "_key", materialize(bad, "bad")), names, docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Texts without words are taken as often as others of their rate; null sources are one source, repeated rows are taken alike."""
    rows, names = _plain(docs)
    mixed = entropy_mix.mix(rows).withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return _restored(mixed, names, docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with size, text_crc32, law, shard, slot and grown_shard. Columns of docs that are named like these give way to them."""
    results = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows, names = _plain(docs)
    stay = [(a, b) for a, b in zip(names, docs.columns, strict=True) if b.lower() not in results]
    return hilbert_shards.hilbert_shards(rows).select(*[F.col(a).alias(b) for a, b in stay], *results)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL cannot follow the mixing and the curve; the tests hold each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is stored in the shared folder until the next one stands, and what a stage wrote besides goes with it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place, last = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{place}/{k}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            target = spark._jvm.org.apache.hadoop.fs.Path(last)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        last = path
    return docs
