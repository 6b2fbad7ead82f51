"""Applies files of document rows, as they arrive, to a store.

The engine itself has no streams; this runs its incremental operators (decide, upsert, touch) under Structured
Streaming, so that a landing folder is taken in once and no more, whatever restarts in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorekeep.embed import Embedder
from lorekeep.operators import maintenance
from lorekeep.plans.ingest import chunked
from lorekeep.plans.store import Store

SCHEMA = "collection string, path string, mtime timestamp, content string"


def apply_batch(store: Store, rows: DataFrame, embedder: Embedder) -> dict[str, int]:
    """Bring the store to the newest of each document in rows; one commit for all of them.

    A batch that comes again after a failure finds its documents unchanged and does nothing.
    """
    rows = rows.withColumn("source_hash", F.sha2("content", 256)).persist()
    newest = rows.groupBy("collection", "path").agg(F.max_by(F.struct("mtime", "source_hash", "content"), F.struct("mtime", "source_hash")).alias("n")).select("collection", "path", "n.*").persist()
    manifest = store.manifest()
    names = [r[0] for r in newest.select("collection").distinct().collect()]  # collections are configured, and few
    counts: dict[str, int] = {}
    for name in names:
        chunks, sources = store.table("chunks", manifest, [name]), store.table("sources", manifest, [name])
        decided = maintenance.decide_actions(newest.where(F.col("collection") == name), maintenance.index_state(chunks)).persist()
        found = {r["action"]: r["n"] for r in decided.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
        for k, n in found.items():
            counts[k] = counts.get(k, 0) + n
        if set(found) - {"skip"}:
            fresh = decided.where("action IN ('new', 'reingest')")
            kept = maintenance.touch(chunks, decided.where("action = 'touch_mtime'"))
            after = maintenance.upsert(kept, chunked(fresh, embedder).select(*chunks.columns))
            manifest = store.write(manifest, name, after, maintenance.upsert(sources, fresh.select("collection", "path", "source_hash", "content")))
        decided.unpersist()
    if set(counts) - {"skip"}:
        manifest.version += 1
        store.commit(manifest)
    newest.unpersist()
    rows.unpersist()
    return counts


def follow(spark: SparkSession, store: Store, landing: str, checkpoint: str, embedder: Embedder) -> StreamingQuery:
    """Take in every Parquet file that lies in `landing` and was not taken before, then stop."""
    rows = spark.readStream.schema(SCHEMA).parquet(landing)
    writer = rows.writeStream.foreachBatch(lambda batch, _: apply_batch(store, batch, embedder) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
