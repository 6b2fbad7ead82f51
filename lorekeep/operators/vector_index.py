"""F16, A1: an inverted file of vectors (IVF), and searches that read a few of its cells.

Centres are fitted on a bounded sample; every vector is then assigned to its nearest centre and stored in the order
of cells, so that a search reads the row groups of the cells it probes. Each cell's radius bounds what lies in it: an
exact search probes on until no other cell can hold a better row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.bm25 import KEY

#: Vectors of the sample for each cell, and the most cells: the driver holds their product at most.
PER_CELL, MOST_CELLS = 64, 1024
ROUNDS = 12
#: Share of the cells that a search probes; the tests measure its recall.
PROBED = 0.2


@dataclass(frozen=True)
class Cells:
    """Centres of length 1, and how far the farthest vector of each cell lies from its centre."""

    centres: np.ndarray
    radii: np.ndarray

    def distances(self, query: Sequence[float]) -> np.ndarray:
        wanted = np.asarray(query, np.float64)
        return np.linalg.norm(self.centres - wanted / max(float(np.linalg.norm(wanted)), 1e-12), axis=1)

    def nearest(self, query: Sequence[float], probes: int | None = None) -> list[int]:
        return np.argsort(self.distances(query), kind="stable")[: probes or max(1, round(PROBED * len(self.centres)))].tolist()

    def within(self, query: Sequence[float], score: float) -> list[int]:
        """Cells that may hold a vector of at least this cosine: by the triangle inequality."""
        reach = float(np.sqrt(max(0.0, 2 - 2 * score)))
        return np.flatnonzero(self.distances(query) - self.radii <= reach + 1e-5).tolist()


def cell_count(rows: int) -> int:
    return max(1, min(MOST_CELLS, round(rows**0.5)))


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    vectors = flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def fitted(chunks: DataFrame, cells: int) -> np.ndarray:
    """Centres by spherical k-means over PER_CELL * cells vectors: those whose keys have the least hashes."""
    sample = chunks.where("embedding IS NOT NULL").select("embedding", F.xxhash64(*KEY).alias("h")).orderBy("h").limit(PER_CELL * cells)
    vectors = _unit(sample.select("embedding").toArrow().column(0).combine_chunks())  # PER_CELL * MOST_CELLS rows at most
    centres = vectors[:: max(1, len(vectors) // cells)][:cells].copy()
    for _ in range(ROUNDS):
        nearest = np.argmax(vectors @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, vectors)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-12), centres)
    return centres


def assigned(chunks: DataFrame, centres: np.ndarray) -> DataFrame:
    """(collection, path, chunk_sequence, embedding, cell, distance) of every chunk that has a vector."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _unit(batch.column("embedding"))
            cell = np.argmax(vectors @ centres.T, axis=1) if len(vectors) else np.empty(0, np.int64)
            distance = np.linalg.norm(vectors - centres[cell], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(distance, pa.float64())], [*batch.schema.names, "cell", "distance"])

    held = chunks.where("embedding IS NOT NULL").select(*KEY, "embedding")
    return held.mapInArrow(assign, "collection string, path string, chunk_sequence long, embedding array<float>, cell int, distance double")


def stored(index: DataFrame, path: str) -> None:
    """Write assigned rows in the order of cells; a cell of very many rows spreads over files by its paths."""
    order = ["cell", "path", "chunk_sequence"]
    index.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


def cells_of(index: DataFrame, centres: np.ndarray) -> Cells:
    radii = np.zeros(len(centres))
    for r in index.groupBy("cell").agg(F.max("distance").alias("r")).collect():  # one row a cell
        radii[r["cell"]] = r["r"]
    return Cells(centres, radii)


def probed(index: DataFrame, cells: Sequence[int]) -> DataFrame:
    """The rows of some cells; the filter reaches the scan."""
    return index.where(F.col("cell").isin(*cells)) if cells else index.where(F.lit(False))


def search(index: DataFrame, cells: Cells, query: Sequence[float], size: int, *, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(collection, path, chunk_sequence, score): the best rows of the probed cells; with `exact`, of all."""
    from lorekeep.operators import ranking

    scored = lambda rows: ranking.vector_scored(rows.withColumn("body", F.lit(None).cast("string")), query).drop("body")
    first = cells.nearest(query, probes)
    if exact:
        low = ranking.top(scored(probed(index, first)), size).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).first()
        # Scores below 0 count as 0, and all such rows are alike.
        first = cells.within(query, low["s"] - 1e-6) if low["n"] == size and low["s"] > 0 else list(range(len(cells.centres)))
    return ranking.top(scored(probed(index, first)), size)
