"""Bringing a store up to date with its collections.

A directory is listed with times and sizes; what the index already mirrors is dropped before a byte is read.
Executors read, extract, chunk and embed the rest, a row for each file; a file that fails keeps its old rows.
All of a collection's changes go into new snapshots, and one manifest makes them count.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.embed import Embedder, embedded
from lorekeep.errors import ArchiveError, ExtractError, LorekeepError
from lorekeep.operators import maintenance
from lorekeep.operators.chunking import plain_chunks
from lorekeep.operators.markdown import markdown_chunks
from lorekeep.plans.config import Config
from lorekeep.plans.store import Store
from lorekeep.sources import archives, walker
from lorekeep.sources.extract import extract

DOCUMENT = ["collection", "path"]
READ = "collection string, path string, mtime timestamp, source_hash string, content string, error string"


@dataclass
class UpdateSummary:
    """F14."""

    new: int = 0
    updated: int = 0
    skipped: int = 0
    removed: int = 0
    failed: int = 0
    unreadable: list[str] = field(default_factory=list)

    def add(self, other: UpdateSummary) -> None:
        for k in ("new", "updated", "skipped", "removed", "failed"):
            setattr(self, k, getattr(self, k) + getattr(other, k))
        self.unreadable += other.unreadable


class Progress(Protocol):
    """what an update tells while it runs."""

    def event(self, name: str, **details: Any) -> None: ...


class Silent:
    def event(self, name: str, **details: Any) -> None:
        pass


def _text_of(data: bytes, path: str) -> tuple[str, str | None, str | None]:
    """(hash of the bytes, text, error)."""
    digest = hashlib.sha256(data).hexdigest()
    try:
        return digest, extract(data, walker.format_of(path) or "markdown"), None
    except ExtractError as e:
        return digest, None, str(e)


def read_files(listing: DataFrame) -> DataFrame:
    """(collection, path, mtime, source_hash, content, error) of files (…, file), read by the executors."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                try:
                    with open(row.file, "rb") as f:
                        found = _text_of(f.read(), row.path)
                except OSError as e:
                    found = None, None, str(e)
                yield pd.DataFrame([(row.collection, row.path, row.mtime, *found)], columns=["collection", "path", "mtime", "source_hash", "content", "error"])

    return listing.select(*DOCUMENT, "mtime", "file").mapInPandas(read, READ)


def read_archive(spark: SparkSession, collection: str, file: str, wanted: set[str], mtime_micros: int) -> DataFrame:
    """The wanted documents of an archive, which is read as a stream by one task."""
    task = spark.createDataFrame([(file, sorted(wanted))], "file string, wanted array<string>")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                for path, data, error in archives.contents(row.file, set(row.wanted)):
                    found = _text_of(data, path) if data is not None else (None, None, error)
                    yield pd.DataFrame([(collection, path, pd.Timestamp(mtime_micros, unit="us"), *found)], columns=["collection", "path", "mtime", "source_hash", "content", "error"])

    return task.mapInPandas(read, READ)


def chunked(documents: DataFrame, embedder: Embedder) -> DataFrame:
    """Chunk rows with vectors; Markdown by headings, text of PDFs by windows."""
    rows = documents.select(*DOCUMENT, F.col("mtime").alias("modified_at"), "source_hash", "content")
    pdf = F.lower("path").endswith(".pdf")
    both = markdown_chunks(rows.where(~pdf)).unionByName(plain_chunks(rows.where(pdf)))
    return embedded(both, embedder)


def update_collection(spark: SparkSession, store: Store, name: str, root: str, embedder: Embedder, progress: Progress | None = None) -> UpdateSummary:
    """One collection: what to do is decided before anything is read, and committed at the end at once."""
    progress = progress or Silent()
    summary = UpdateSummary()
    progress.event("start_collection", collection=name)
    manifest = store.manifest()
    chunks, sources = store.table("chunks", manifest, [name]), store.table("sources", manifest, [name])
    state = maintenance.index_state(chunks)
    archive = archives.archive_kind(root) if not os.path.isdir(root) else None
    if archive:
        try:
            listing = archives.listed(root)
        except (ArchiveError, OSError) as e:
            progress.event("unreadable", collection=name, reason=str(e))
            return UpdateSummary(unreadable=[name])
        micros = listing.stamp[0] // 1000
        summary.failed += len(listing.rejected)
        rows = [(name, p, micros) for p in listing.documents]
        disk = spark.createDataFrame(rows, "collection string, path string, micros long").selectExpr("collection", "path", "timestamp_micros(micros) AS mtime")
    else:
        disk = walker.listing(spark, name, root)
    named = maintenance.without(disk, disk.where(F.col("path").rlike(r"\p{Cc}")))
    disk = disk.persist()
    known = maintenance.unread(named.select(*DOCUMENT, "mtime"), state, sources).persist()
    todo = named.join(known, DOCUMENT, "left_anti")
    rejected = disk.where(F.col("path").rlike(r"\p{Cc}")).count()
    summary.failed += rejected
    gone = maintenance.orphans(named, chunks, sources).persist()
    wanted = todo.count()
    if archive:
        paths = {r["path"] for r in todo.select("path").toLocalIterator()}
        read = read_archive(spark, name, root, paths, listing.stamp[0] // 1000) if paths else spark.createDataFrame([], READ)
    else:
        read = read_files(todo)
    # Read once: what follows branches, and files may change in between.
    read = read.persist()
    delivered = read.count()
    failed = read.where("content IS NULL").select(*DOCUMENT)
    decided = maintenance.decide_actions(read.where("content IS NOT NULL"), state).persist()
    counts = {r["action"]: r["n"] for r in decided.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
    summary.new += counts.get("new", 0)
    summary.updated += counts.get("reingest", 0)
    summary.skipped += counts.get("skip", 0) + counts.get("touch_mtime", 0) + known.count()
    summary.failed += failed.count() + wanted - delivered
    summary.removed = gone.count()
    fresh = decided.where("action IN ('new', 'reingest')")
    if summary.removed or counts:
        new_sources = maintenance.upsert(maintenance.without(sources, gone), decided.select(*DOCUMENT, "source_hash", "content"))
        kept = maintenance.touch(maintenance.without(chunks, gone), decided.where("action = 'touch_mtime'"))
        new_chunks = maintenance.upsert(kept, chunked(fresh, embedder).select(*chunks.columns)) if counts.get("new") or counts.get("reingest") else kept
        after = store.write(manifest, name, new_chunks, new_sources)
        after.version = manifest.version + 1
        store.commit(after)
        progress.event("start_index_maintenance", collection=name)
    for frame in (disk, known, gone, read, decided):
        frame.unpersist()
    progress.event("finish", collection=name, summary=summary)
    return summary


def update_all(spark: SparkSession, store: Store, config: Config, embedder: Embedder, progress: Progress | None = None) -> UpdateSummary:
    """Every configured collection in order of names; one that fails leaves the others alone."""
    store.create(embedder.model_id, embedder.dim)
    store.check_pins(embedder.model_id, embedder.dim, strict=True)
    store.check_layout(config.model)
    total = UpdateSummary()
    for name, entry in sorted(config.collections.items()):
        total.add(update_collection(spark, store, name, os.path.expanduser(entry.path), embedder, progress))
    store.vacuum()
    return total


def prune(store: Store, config: Config) -> list[str]:
    """Drop collections that are no longer configured, which an update leaves as they are."""
    manifest = store.manifest()
    gone = sorted({c for t in manifest.tables.values() for c in t} - set(config.collections))
    if gone:
        manifest.tables = {t: {c: p for c, p in places.items() if c not in gone} for t, places in manifest.tables.items()}
        manifest.version += 1
        store.commit(manifest)
    return gone


def model_action(config_model: str, target: str, pinned: str | None, ranges: bool) -> str:
    """``switch`` to another model, ``rebuild`` what an older one or layout left, or ``none``."""
    if config_model != target:
        return "switch"
    return "none" if pinned == target and ranges else "rebuild"


def switch_model(spark: SparkSession, store: Store, config: Config, embedder: Embedder, progress: Progress | None = None) -> UpdateSummary:
    """empty chunks under the new model, and everything ingested anew."""
    if config.model != embedder.model_id:
        raise LorekeepError(f"the embedder is of {embedder.model_id}, not {config.model}")
    store.recreate(embedder.model_id, embedder.dim)
    return update_all(spark, store, config, embedder, progress)
