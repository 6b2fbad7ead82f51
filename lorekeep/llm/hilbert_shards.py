"""Shards along a Hilbert curve (native DataFrame functions only).

Metadata columns are quantised to a few bits each and rows are sorted by their place on the Hilbert curve
through those cells; equal runs of the order are the shards. Rows near each other in all dimensions meet in
few shards, so that minima and maxima of files prune on any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.shared import global_rank, others, partitions_for


def _rotl(x: int, k: int, n: int) -> int:
    k %= n
    return (x << k | x >> (n - k)) & ((1 << n) - 1)


def _gray_rank(g: int) -> int:
    rank = 0
    while g:
        rank ^= g
        g >>= 1
    return rank


def curve_table(n: int) -> tuple[list[int], list[int]]:
    """For state (entry corner, direction) and octant of an n-dimensional Hilbert curve: its rank, the next state.

    The rules are Hamilton's (Compact Hilbert Indices, 2006); both lists have n * 4^n entries.
    """
    gray = lambda i: i ^ i >> 1
    ones = lambda i: ((i + 1) & -(i + 1)).bit_length() - 1  # noqa: E731  trailing one bits
    entry = lambda w: 0 if w == 0 else gray(2 * ((w - 1) // 2))
    turn = lambda w: 0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % n
    ranks, states = [], []
    for e in range(1 << n):
        for d in range(n):
            for octant in range(1 << n):
                w = _gray_rank(_rotl(octant ^ e, n - (d + 1) % n, n))
                ranks.append(w)
                states.append((e ^ _rotl(entry(w), d + 1, n)) * n + (d + turn(w) + 1) % n)
    return ranks, states


def curve_index(cells: list[str], bits: int) -> Column:
    """Place on the curve of the cell whose coordinates are the named columns, each of so many bits."""
    n = len(cells)
    ranks, states = (f"array({','.join(map(str, x))})" for x in curve_table(n))
    octant = " | ".join(f"shiftleft(shiftright({c}, b) & 1, {j})" for j, c in enumerate(cells))
    step = f"struct(element_at({states}, s.at * {1 << n} + ({octant}) + 1) AS at, shiftleft(s.place, {n}) | element_at({ranks}, s.at * {1 << n} + ({octant}) + 1) AS place)"
    return F.expr(f"aggregate(sequence({bits - 1}, 0, -1), struct(0 AS at, 0L AS place), (s, b) -> {step}, s -> s.place)")


def value_cells(docs: DataFrame, column: str, bits: int) -> DataFrame:
    """(_value, _cell): the distinct values of a column in order, null first, cut into 2^bits equal runs."""
    values = docs.select(F.col(column).alias("_value")).distinct()
    ranked, n = global_rank(values, [F.col("_value").asc_nulls_first()], "values")
    return ranked.select("_value", (F.col("_rank") * (1 << bits) / F.lit(max(n, 1))).cast("int").alias("_cell"))


def hilbert_shards(docs: DataFrame, shards: int = 8, *, by: tuple[str, ...] = ("source", "lang"), bits: int = 6, carry: bool = True) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard; shards hold equal numbers of rows, give or take one.

    Dimensions are the columns of `by` (by the order of their values) and the logarithm of the text's size.
    size: UTF-8 bytes of the text plus 1; text_crc32: of those bytes. Ties on the curve are ordered by size,
    checksum and doc_id, so equal texts of one cell lie together and no cell has to fit in one task; repeated
    rows are dealt out like others. law is `rows`; grown_shard is null. Without `carry` the result lacks the text,
    which then is not sorted along.

    Nulls: a null text counts as empty; null metadata and doc_ids sort first. Empty table: empty result. Other
    columns stay; those named like a result or with an underscore in front are left out.
    """
    docs = others(docs, ["size", "text_crc32", "law", "shard", "slot", "grown_shard"])
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.withColumns({"size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text.cast("binary"))})
    if not carry:
        sized = sized.drop("text")
    kept = [c for c in docs.columns if c in sized.columns]
    cells = []
    for k, column in enumerate(by):
        found = value_cells(docs, column, bits)
        sized = sized.join(found.withColumnsRenamed({"_value": f"_v{k}", "_cell": f"_c{k}"}), sized[column].eqNullSafe(F.col(f"_v{k}")), "left").drop(f"_v{k}")
        cells.append(f"_c{k}")
    sized = sized.withColumn("_size", F.least(F.lit((1 << bits) - 1), F.floor(F.log2("size") * ((1 << bits) / 32))).cast("int"))
    cells.append("_size")
    placed = sized.withColumn("_place", curve_index(cells, bits)).drop(*cells)
    ranked, n = global_rank(placed, [F.col("_place"), F.col("size"), F.col("text_crc32"), F.col("doc_id").asc_nulls_first(), F.xxhash64(*kept)], "curve")
    base, more = divmod(n, shards)
    longer = more * (base + 1)
    shard = F.when(F.col("_rank") < longer, F.expr(f"_rank div {base + 1}")).otherwise(F.expr(f"{more} + (_rank - {longer}) div {max(base, 1)}"))
    start = F.col("shard") * base + F.least(F.col("shard"), F.lit(more))
    return (
        ranked.withColumn("law", F.lit("rows")).withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.col("_rank") - start).withColumn("grown_shard", F.lit(None).cast("int"))
        .select(*kept, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    )


def write_shards(sharded: DataFrame, path: str, *, files: int | None = None) -> None:
    """Write what hilbert_shards() returns as folders of shards, each of files that are runs of the curve: as many files as `files`, or partitions, and a shard's end more."""
    count = files or partitions_for(sharded.sparkSession)
    sharded.repartitionByRange(count, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
