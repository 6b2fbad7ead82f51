"""The relational part of keeping an index in step with its documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import is_safe_path

DOCUMENT = ["collection", "path"]


def decide_actions(disk: DataFrame, index: DataFrame) -> DataFrame:
    """disk (collection, path, mtime, source_hash) with `action` against index (…, modified_at, indexed_hash).

    new: no row; skip: equal times; touch_mtime: equal contents; reingest: else. Times are compared as stored.
    """
    held = index.select(*DOCUMENT, "modified_at", F.col("source_hash").alias("_hash"))
    action = F.when(F.col("modified_at").isNull(), "new").when(F.col("mtime") == F.col("modified_at"), "skip").when(F.col("source_hash") == F.col("_hash"), "touch_mtime").otherwise("reingest")
    return disk.join(held, DOCUMENT, "left").withColumn("action", action).drop("modified_at", "_hash")


def mirrored(index: DataFrame, sources: DataFrame) -> DataFrame:
    """the documents whose source row has the hash of their chunks."""
    return index.select(*DOCUMENT, "source_hash").join(sources.select(*DOCUMENT, "source_hash"), [*DOCUMENT, "source_hash"], "left_semi")


def unread(disk: DataFrame, index: DataFrame, sources: DataFrame) -> DataFrame:
    """disk rows (no contents needed) that can be skipped: equal time, and a mirrored source."""
    same = disk.join(index.select(*DOCUMENT, F.col("modified_at").alias("mtime"), "source_hash"), [*DOCUMENT, "mtime"])
    return same.join(mirrored(index, sources), [*DOCUMENT, "source_hash"], "left_semi").select(*disk.columns)


def orphans(disk: DataFrame, *tables: DataFrame) -> DataFrame:
    """documents in any of the tables that are not on disk."""
    held = tables[0].select(*DOCUMENT)
    for t in tables[1:]:
        held = held.unionByName(t.select(*DOCUMENT))
    return held.distinct().join(disk.select(*DOCUMENT), DOCUMENT, "left_anti")


def without(table: DataFrame, gone: DataFrame) -> DataFrame:
    """the table without the documents named."""
    return table.join(gone.select(*DOCUMENT).distinct(), DOCUMENT, "left_anti")


def upsert(table: DataFrame, fresh: DataFrame) -> DataFrame:
    """the rows of documents in `fresh` replaced by theirs, stale chunks included; all others kept."""
    return without(table, fresh).unionByName(fresh)


def touch(table: DataFrame, touched: DataFrame) -> DataFrame:
    """F8: modified_at of the documents in touched (collection, path, mtime)."""
    times = touched.select(*DOCUMENT, F.col("mtime").alias("_time")).distinct()
    return table.join(times, DOCUMENT, "left").withColumn("modified_at", F.coalesce("_time", "modified_at")).select(*table.columns)


def index_state(chunks: DataFrame) -> DataFrame:
    """(collection, path, modified_at, source_hash) of each document by its last chunk; broken rows left out."""
    valid = chunks.where(F.col("path").isNotNull() & F.col("modified_at").isNotNull() & F.col("source_hash").isNotNull() & is_safe_path(F.col("path")))
    last = F.max_by(F.struct("modified_at", "source_hash"), "chunk_sequence")
    return valid.groupBy(*DOCUMENT).agg(last.alias("s")).select(*DOCUMENT, "s.modified_at", "s.source_hash")


def summary(actions: DataFrame, removed: DataFrame) -> DataFrame:
    """one row: new, updated, skipped (touched ones too), removed, failed."""
    count = lambda *names: F.count_if(F.col("action").isin(*names))
    gone: Column = F.lit(removed.count())
    return actions.agg(count("new").alias("new"), count("reingest").alias("updated"), count("skip", "touch_mtime").alias("skipped"), gone.cast("long").alias("removed"), count("failed").alias("failed"))
