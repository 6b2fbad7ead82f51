"""What the operators of this subpackage share: scratch tables, distributed ranks, links to components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, for Java regular expressions.
BLANKS = r"[\x20\x09-\x0D]+"

#: Paths written inside the scopes that are open, innermost last; outside of any, the root goes when the driver ends.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open scratch scopes", default=())
_roots: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On a local master a fresh one where it is unset (tests)."""
    if not (place := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="lorekeep-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        place = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once. The archive lies on the driver until it ends."""
    context = spark.sparkContext
    if not getattr(context, "_lorekeep_shipped", False):
        own = tempfile.mkdtemp(prefix="lorekeep-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.addPyFile(shutil.make_archive(f"{own}/lorekeep_package", "zip", Path(__file__).resolve().parents[2], "lorekeep"))
        context._lorekeep_shipped = True


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under this driver's own part of the shared folder.

    It is removed with the innermost scratch() scope it was made in, else when the driver ends: a result that was
    returned lazily keeps what it reads, whatever else runs meanwhile.
    """
    key = (spark.sparkContext.applicationId, shared_dir(spark))
    if key not in _roots:
        root = f"{key[1]}/lorekeep-{uuid.uuid4().hex}"
        files, target = _file_system(spark, root)
        files.mkdirs(target)
        files.deleteOnExit(target)
        _roots[key] = root
    path = f"{_roots[key]}/{label}-{uuid.uuid4().hex}"
    if scopes := _open.get():
        scopes[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A scope whose scratch tables are removed at its end. Results built in it must be stored by then."""
    own: list[str] = []
    token = _open.set((*_open.get(), own))
    try:
        yield
    finally:
        _open.reset(token)
        for path in own:
            _remove(spark, path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: its lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path).withMetadata(df.columns[0], {"scratch": path})


def drop(df: DataFrame) -> None:
    """Remove a materialized table that nothing reads any more."""
    if path := df.schema[0].metadata.get("scratch"):
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    files, target = _file_system(spark, path)
    files.delete(target, True)


def others(docs: DataFrame, results: Sequence[str]) -> DataFrame:
    """docs without columns that are named like results or, as the operators' own are, start with an underscore."""
    taken = {r.lower() for r in results}
    return docs.select(*[c for c in docs.columns if c.lower() not in taken and not c.startswith("_")])


def words_of(text: Column) -> Column:
    """Maximal runs without white space; null text: an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def fixed(value: Column) -> Column:
    """value, computed once a row: filters above it are not rewritten in its terms (which would split a text anew for each element of an array)."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Where a text is all ASCII, lower() is that and faster."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def partitions_for(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def apart(sums: DataFrame) -> DataFrame:
    """Sums by key, dealt out evenly again, for a join by that key.

    Spark would otherwise keep them where they were summed and bring a hot key's rows there, to one task; now
    both sides of the join are shuffled for it, and adaptive execution can split the hot side.
    """
    return sums.repartition(partitions_for(sums.sparkSession))


def bitmap(keys: DataFrame, longs: int) -> Column:
    """An array of `longs` longs (a power of 2), as a scalar, in which the 64-bit hashes keys (one column) have set a bit each."""
    (name,) = keys.columns
    word = F.col(name).bitwiseAND(64 * longs - 1)
    bits = keys.groupBy(F.shiftright(word, 6).alias("id")).agg(F.bit_or(F.expr(f"shiftleft(1L, int({name} & 63))")).alias("bits"))
    # As many rows as the bitmap has longs.
    dense = keys.sparkSession.range(longs).join(bits, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    return dense.agg(F.sort_array(F.collect_list(F.struct("id", "bits")))["bits"].alias("bitmap")).scalar()


def in_bitmap(found: Column, longs: int, key: Column) -> Column:
    """Whether the key's bit is set."""
    return F.getbit(F.element_at(found, F.shiftright(key.bitwiseAND(64 * longs - 1), 6).cast("int") + 1), key.bitwiseAND(63).cast("int")) == 1


#: Bits of a bitmap for each key, and its least and most 64-bit words (16 MB, which hold 8 million keys so).
BITS_EACH, LEAST_LONGS, MOST_LONGS = 16, 1 << 10, 1 << 21


def longs_for(keys: int) -> int:
    """Words of a bitmap for so many keys: a power of 2 within the bounds."""
    return min(MOST_LONGS, max(LEAST_LONGS, 1 << (BITS_EACH * keys // 64).bit_length()))


def maybe_in(column: str, keys: DataFrame) -> Column:
    """Whether `column` may be among keys (one stored column of the same name): true for all that are, false for most others.

    Keys set bits of one bitmap, which is an array that every task holds: rows are told apart where they are read,
    before a join would shuffle them. It grows with the keys up to MOST_LONGS; beyond, more rows pass.
    """
    longs = longs_for(keys.count())
    return in_bitmap(bitmap(keys.select(F.xxhash64(column).alias("key")), longs), longs, F.xxhash64(column))


def without(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """rows whose `column` is not among keys. Only rows that may be are shuffled, the others pass; null is kept."""
    doubtful = maybe_in(column, keys)
    return rows.where(~doubtful).unionByName(rows.where(doubtful).join(keys.select(column), column, "left_anti").select(*rows.columns))


def global_rank(df: DataFrame, order: list[Column], label: str, weight: str | None = None) -> tuple[DataFrame, int]:
    """df with `_rank`, its row's place from 0 in the order given, and the number of rows.

    Rows are range-partitioned and sorted, written with their place in the partition, and shifted by what
    lies in the partitions before: no task sees more than its range, and only one row a partition is summed
    up. With weight, `before` holds the sum of that column over all rows ahead. The order must end in columns
    that tell rows apart, or a tie stays in one partition.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(partitions_for(spark), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, label)
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sums = [F.count(F.lit(1)).alias("n")] + ([F.sum(weight).alias("w")] if weight else [])
    ahead, rows, heavy = [], 0, 0
    for r in sorted(placed.groupBy(part.alias("part")).agg(*sums).collect()):  # one row a partition
        ahead.append((r["part"], rows, heavy))
        rows, heavy = rows + r["n"], heavy + (r["w"] or 0 if weight else 0)
    offsets = spark.createDataFrame(ahead or [(0, 0, 0)], "_part long, _rows long, _heavy long")
    # As many rows as the range sort has partitions.
    ranked = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    ranked = ranked.withColumn("_rank", F.col("_rows") + row)
    return ranked.drop("_part", "_rows", "_heavy", "_at"), rows


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of links (a, b): root is the least node that a path of links reaches.

    Alternating large and small stars: each round hangs every node's neighbours on the least of them, and is
    written before the next; it ends when a round changes nothing. Rounds grow with the logarithm of the
    longest path. Minima are partially aggregated before they are dealt out, and the join that follows has
    one row a node on one side, so that a node with very many links is split over tasks.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialize(edges, label)
    mark = _fingerprint(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = apart(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = apart(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = materialize(small, label)
        drop(edges)
        edges, last, mark = after, mark, _fingerprint(after)
        if mark == last:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], int(r["h"] or 0)
