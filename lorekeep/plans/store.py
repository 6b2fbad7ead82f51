"""The store: chunks, sources and the text index as immutable Parquet snapshots under one manifest.

A version names, for each collection, the folder of each table; an update writes new folders for the
collections that changed and then adds the next manifest, so readers see all of an update or none of it, and
collections that did not change are neither read nor written. Of two updates of one version the second fails. Folders
that no kept manifest names are removed by vacuum(). Any file system that Hadoop knows will do.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.errors import IndexOutdated, LorekeepError, SchemaMetadataMissing, SchemaMismatch
from lorekeep.operators import bm25, vector_index

MANIFESTS = "manifests"
#: Chunks with a vector from which on a collection has an inverted file of them.
INDEXED_FROM = 10_000
CHUNKS = T.StructType([
    T.StructField("collection", T.StringType()), T.StructField("path", T.StringType()), T.StructField("chunk_sequence", T.LongType()), T.StructField("body", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("modified_at", T.TimestampType()), T.StructField("source_hash", T.StringType()),
    T.StructField("source_start", T.LongType()), T.StructField("source_end", T.LongType()),
])
SOURCES = T.StructType([T.StructField(c, T.StringType()) for c in ("collection", "path", "source_hash", "content")])
POSTINGS = T.StructType([
    T.StructField("term", T.StringType()), T.StructField("collection", T.StringType()), T.StructField("path", T.StringType()), T.StructField("chunk_sequence", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("tf", T.LongType()),
])
VECTORS = T.StructType([
    T.StructField("collection", T.StringType()), T.StructField("path", T.StringType()), T.StructField("chunk_sequence", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("cell", T.IntegerType()), T.StructField("distance", T.DoubleType()),
])
CENTRES = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("centre", T.ArrayType(T.DoubleType())), T.StructField("radius", T.DoubleType())])
SCHEMAS = {"chunks": CHUNKS, "sources": SOURCES, "postings": POSTINGS, "vectors": VECTORS, "centres": CENTRES}


@dataclass
class Manifest:
    version: int = 0
    embedding_model: str | None = None
    vector_dim: int | None = None
    #: Whether chunks have their source ranges; a store without them has to be built anew.
    ranges: bool = True
    tables: dict[str, dict[str, str]] = field(default_factory=lambda: {t: {} for t in SCHEMAS})
    #: Chunks with a token and their tokens, by collection.
    lengths: dict[str, list[int]] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # Files, on whatever file system the root is

    def _path(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):  # noqa: ANN202
        return self._path(MANIFESTS).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The versions whose manifests are kept, in order."""
        files, place = self._files(), self._path(MANIFESTS)
        names = [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def exists(self) -> bool:
        return bool(self.versions())

    def manifest(self, version: int | None = None) -> Manifest:
        if version is None:
            held = self.versions()
            if not held:
                return Manifest()
            version = held[-1]
        stream = self._files().open(self._path(f"{MANIFESTS}/{version:012d}.json"))
        try:
            raw = bytes(stream.readAllBytes())
        finally:
            stream.close()
        return Manifest(**json.loads(raw))

    def commit(self, manifest: Manifest) -> None:
        """Add a manifest under its version: written beside, then renamed, which fails if that version is there."""
        files, beside, place = self._files(), self._path(f"{MANIFESTS}/.{uuid.uuid4().hex}"), self._path(f"{MANIFESTS}/{manifest.version:012d}.json")
        stream = files.create(beside)
        try:
            stream.write(bytearray(json.dumps(manifest.__dict__).encode()))
        finally:
            stream.close()
        jvm = self.spark._jvm
        kinds = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration()).rename(beside, place, kinds)
        except Py4JJavaError as e:
            files.delete(beside, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise LorekeepError(f"another update has made version {manifest.version}; this one is not kept") from e
            raise

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove all manifests but the last `keep`, and the folders that none of those names; returns the folders."""
        files, held = self._files(), self.versions()
        for version in held[:-keep]:
            files.delete(self._path(f"{MANIFESTS}/{version:012d}.json"), False)
        named = {p for v in held[-keep:] for places in self.manifest(v).tables.values() for p in places.values()}
        gone = []
        for top in files.listStatus(self._path("")) if held else []:
            name = top.getPath().getName()
            # Folders of a version that is not there yet belong to an update that runs.
            if name.startswith("v=") and int(name[2:]) <= held[-1]:
                for table in files.listStatus(top.getPath()):
                    for place in files.listStatus(table.getPath()):
                        path = f"{name}/{table.getPath().getName()}/{place.getPath().getName()}"
                        if path not in named:
                            files.delete(place.getPath(), True)
                            gone.append(path)
        return gone

    # Tables

    def create(self, model: str, dim: int) -> Manifest:
        """Empty tables with their pins, unless there are some."""
        if self.exists():
            return self.manifest()
        manifest = Manifest(1, model, dim)
        self.commit(manifest)
        return manifest

    def recreate(self, model: str, dim: int) -> Manifest:
        """No chunks, under other pins; sources stay."""
        old = self.manifest()
        manifest = Manifest(old.version + 1, model, dim, True, {t: old.tables["sources"] if t == "sources" else {} for t in SCHEMAS})
        self.commit(manifest)
        return manifest

    def table(self, name: str, manifest: Manifest | None = None, collections: tuple[str, ...] | list[str] = ()) -> DataFrame:
        """The rows of a table; of the collections named alone, or of all."""
        held = (manifest or self.manifest()).tables.get(name, {})
        places = [p for c, p in sorted(held.items()) if not collections or c in collections]
        if not places:
            return self.spark.createDataFrame([], SCHEMAS[name])
        frame = self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.root}/{p}" for p in places])
        return frame

    def write(self, manifest: Manifest, collection: str, chunks: DataFrame | None, sources: DataFrame | None) -> Manifest:
        """The manifest with new folders for a collection's tables; they count once it is committed."""
        version = manifest.version + 1
        tables = {t: dict(p) for t, p in manifest.tables.items()}
        for name, rows in (("sources", sources), ("chunks", chunks)):
            if rows is not None:
                place = f"v={version}/{name}/{collection}-{uuid.uuid4().hex[:8]}"
                pinned = rows.select(*[F.col(c.name).cast(c.dataType).alias(c.name) for c in SCHEMAS[name]])
                if name == "chunks":
                    pinned = pinned.withMetadata("embedding", {"embedding_model": manifest.embedding_model, "vector_dim": manifest.vector_dim})
                # In order of paths, so that reads of a document skip all other row groups.
                order = [c for c in ("path", "chunk_sequence") if c in pinned.columns]
                pinned.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{self.root}/{place}")
                tables[name][collection] = place
        if chunks is not None:
            # F16: the text index of what was just written, by term, so that a query reads a few row groups.
            place = f"v={version}/postings/{collection}-{uuid.uuid4().hex[:8]}"
            stored = self.spark.read.schema(CHUNKS).parquet(f"{self.root}/{tables['chunks'][collection]}")
            index = bm25.postings(stored).select(*POSTINGS.names)
            index.repartitionByRange("term", "path").sortWithinPartitions("term").write.parquet(f"{self.root}/{place}")
            tables["postings"][collection] = place
            for name in ("vectors", "centres"):
                tables.setdefault(name, {}).pop(collection, None)
            if (n := stored.where("embedding IS NOT NULL").count()) >= INDEXED_FROM:
                centres = vector_index.fitted(stored, vector_index.cell_count(n))
                for name in ("vectors", "centres"):
                    tables[name][collection] = f"v={version}/{name}/{collection}-{uuid.uuid4().hex[:8]}"
                vector_index.stored(vector_index.assigned(stored, centres), f"{self.root}/{tables['vectors'][collection]}")
                cells = vector_index.cells_of(self.spark.read.schema(VECTORS).parquet(f"{self.root}/{tables['vectors'][collection]}"), centres)
                rows = [(k, c.tolist(), float(r)) for k, (c, r) in enumerate(zip(cells.centres, cells.radii, strict=True))]
                self.spark.createDataFrame(rows, CENTRES).coalesce(1).write.parquet(f"{self.root}/{tables['centres'][collection]}")
            row = bm25.corpus_stats(stored).first()
            return replace(manifest, tables=tables, lengths=manifest.lengths | {collection: [row["n_chunks"], row["total_length"]]})
        return replace(manifest, tables=tables)

    def cells(self, manifest: Manifest, collection: str) -> vector_index.Cells | None:
        """The cells of a collection's vectors; None where it has no index."""
        if collection not in manifest.tables.get("centres", {}):
            return None
        rows = sorted(self.table("centres", manifest, [collection]).collect())  # MOST_CELLS at most
        return vector_index.Cells(np.array([r["centre"] for r in rows]), np.array([r["radius"] for r in rows]))

    def sums(self, manifest: Manifest) -> tuple[int, int]:
        """Chunks with a token and all tokens of the store."""
        held = [n for c, n in manifest.lengths.items() if c in manifest.tables["chunks"]]
        return sum(n for n, _ in held), sum(t for _, t in held)

    # Pins

    def check_pins(self, model: str, dim: int, *, strict: bool) -> str | None:
        """What is missing is an error; what differs is one for ingest, and a warning (returned) for search."""
        manifest = self.manifest()
        absent = [k for k in ("embedding_model", "vector_dim") if getattr(manifest, k) is None]
        if absent:
            raise SchemaMetadataMissing(absent)
        if (manifest.embedding_model, manifest.vector_dim) == (model, dim):
            return None
        message = f"the index was built with {manifest.embedding_model} ({manifest.vector_dim}), not {model} ({dim})"
        if strict:
            raise SchemaMismatch(message)
        return message

    def check_layout(self, model: str) -> None:
        if not self.manifest().ranges:
            raise IndexOutdated(model)
