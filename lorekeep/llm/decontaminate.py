"""Benchmark decontamination by a prefix-filtered set join (native DataFrame functions only).

Items are cut into windows of consecutive words. A window's set is its shingles (runs of up to SHINGLE
words); to hold the window a document must hold every one of them, so it is enough to join the rarest: the
necessary prefix of a containment of 1. Rarity is counted over the whole corpus. A shared prefix fixes where
the window would lie; the length and position bounds drop what would stick out of the document, and the
words of the window are then compared one to one.

Shingles of documents meet a bitmap of the wanted ones where they are read, inside generated code; what passes
is joined exactly. The bitmap grows with the items up to a bound: beyond it more pass, and the join does more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.shared import ascii_lower, bitmap, drop, fixed, in_bitmap, longs_for, materialize, others, partitions_for

#: What separates words: ASCII other than digits and letters.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAPS), "")


def windows(items: DataFrame, width: int) -> DataFrame:
    """(item_id, _window, _k): distinct windows as arrays of words, with the shingle size for each."""
    words = items.select(F.col("item_id"), fixed(item_words(F.col("text"))).alias("_w")).where("size(_w) > 0")
    starts = F.expr(f"sequence(0, greatest(size(_w) - {width}, 0))")
    cut = words.select("item_id", "_w", F.explode(starts).alias("_s")).select("item_id", F.expr(f"slice(_w, _s + 1, {width})").alias("_window"))
    return cut.distinct().withColumn("_k", F.least(F.lit(SHINGLE), F.size("_window")))


def hashed(words: str, at: str, k: int) -> str:
    """SQL for the hash of the k words from place `at` (from 0) on; null where they do not fit."""
    return f"CASE WHEN {at} + {k} <= size({words}) THEN xxhash64({', '.join(f'{words}[{at} + {j}]' for j in range(k))}) END"


def shingles(cut: DataFrame) -> DataFrame:
    """(_window, _k, _at, _hash): every shingle of every distinct window."""
    whole = cut.select("_window", "_k").distinct()
    placed = whole.withColumn("_at", F.explode(F.expr("sequence(0, size(_window) - _k)")))
    sizes = " ".join(f"WHEN {k} THEN {hashed('_window', '_at', k)}" for k in range(1, SHINGLE + 1))
    return placed.withColumn("_hash", F.expr(f"CASE _k {sizes} END"))


def places(docs: DataFrame, wanted: DataFrame, row: str | None = None) -> DataFrame:
    """docs (with _w) once for each place `_place` where a shingle (`_k`, `_hash`) that may be among `wanted` lies in _w.

    The places of a document are rows at once, but only those that pass the bitmap leave the stage that reads it.
    With `row`, a column of the rows' numbers, each document also has one row of a `_k` of 0, behind its last word.
    """
    few = wanted.select("_k", "_hash").distinct()
    sizes = {r["_k"]: r["n"] for r in few.groupBy("_k").agg(F.count(F.lit(1)).alias("n")).collect()}  # SHINGLE rows
    longs = longs_for(sum(sizes.values()))
    bits = bitmap(few.select("_hash"), longs)
    at = docs.withColumn("_place", F.explode(F.expr("sequence(0, size(_w))")))
    passed = F.col("_place") == F.size("_w") if row else F.lit(False)
    found = [F.when(passed, F.struct(F.lit(0).alias("_k"), F.col(row).alias("_hash")))] if row else []
    for k in sorted(sizes):
        key = F.expr(hashed("_w", "_place", k))
        test = F.coalesce(in_bitmap(bits, longs, key), F.lit(False))
        passed = passed | test
        found.append(F.when(test, F.struct(F.lit(k).alias("_k"), key.alias("_hash"))))
    # No higher-order functions here: they would end the generated code, and each place's row would hold all words.
    listed = F.array(*found) if found else F.expr("CAST(array() AS array<struct<_k:int,_hash:bigint>>)")
    return at.where(passed).withColumn("_f", F.explode(listed)).where("_f IS NOT NULL").select(*docs.columns, "_place", "_f._k", "_f._hash")


def prefixes(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """(_window, _k, _at, _hash): the rarest shingle of each window over all documents; ties by hash and place."""
    every = materialize(shingles(cut), "shingles")
    counts = places(docs, every).groupBy("_k", "_hash").agg(F.count(F.lit(1)).alias("_times"))
    ranked = every.join(counts, ["_k", "_hash"], "left")
    # A window has at most as many rows here as words.
    first = Window.partitionBy("_window").orderBy(F.coalesce("_times", F.lit(0)), "_hash", "_at")
    rare = ranked.withColumn("_r", F.row_number().over(first)).where("_r = 1 AND _times IS NOT NULL").select("_window", "_k", "_at", "_hash")
    # One row a window: far fewer than the corpus has, so few files.
    rare = materialize(rare.coalesce(max(1, partitions_for(docs.sparkSession) // 16)), "prefixes")
    drop(every)
    return rare


def occurrences(docs: DataFrame, rare: DataFrame, width: int) -> DataFrame:
    """docs' columns (with _row) but _w, with `_window` and `_start` for each place where it lies; both null in other rows, of which each document has one at least."""
    keep = [c for c in docs.columns if c != "_w"]
    seen = places(docs, rare, "_row").withColumn("_size", F.size("_w"))
    # A candidate's words travel along; text around other places does not.
    around = F.expr(f"CASE WHEN _k > 0 THEN slice(_w, greatest(_place - {width}, 0) + 1, 2 * {width} + _k) END")
    near = seen.select(*keep, "_k", "_hash", "_place", "_size", around.alias("_near"))
    hit = near.join(rare, ["_k", "_hash"], "left")
    start = F.col("_place") - F.col("_at")
    lies = (start >= 0) & (start + F.size("_window") <= F.col("_size"))
    same = F.expr(f"slice(_near, _place - _at - greatest(_place - {width}, 0) + 1, size(_window)) = _window")
    hit = hit.withColumn("_start", F.when(lies, F.when(same, start)))
    return hit.select(*keep, F.when(F.col("_start").isNotNull(), F.col("_window")).alias("_window"), "_start")


def decontaminate(docs: DataFrame, items: DataFrame, *, width: int = 10) -> DataFrame:
    """docs with n_words, n_hit, n_items, items (sorted ids as strings) and contaminated.

    Words are lower-cased for A-Z; a window is `width` consecutive words of an item, or all words of a
    shorter one. A document word inside an occurrence of a window is hit. contaminated: n_hit > 0.

    Nulls: null texts have no words; a null item_id is left out of `items` and n_items but its words count.
    Very long texts are rows like others; only the words around candidates leave them. Repeated rows of documents
    are each returned; repeated items count once. Without items every document is clean; without documents the
    result is empty. Other columns but the text stay; columns named like a result or with an underscore in front
    are left out.
    """
    results = ["n_words", "n_hit", "n_items", "items", "contaminated"]
    docs = others(docs, results)
    kept = [c for c in docs.columns if c != "text"]
    cut = materialize(windows(items, width), "windows")
    worded = docs.select("text").where("text IS NOT NULL").select(fixed(item_words(F.col("text"))).alias("_w"))
    rare = prefixes(worded, cut)
    # A row's own number keeps repeated rows apart; it holds within this one reading of the table.
    own = docs.withColumn("_row", F.monotonically_increasing_id()).withColumn("_w", fixed(item_words(F.col("text")))).withColumn("n_words", F.size("_w").cast("long"))
    slim = [c for c in own.columns if c != "text"]
    found = occurrences(own.select(*slim), rare, width)
    listed = cut.groupBy("_window").agg(F.collect_set(F.col("item_id").cast("string")).alias("_ids"))
    found = found.join(listed, "_window", "left")
    # One row a document: its rows are at most its words times the items that share a window.
    marks = F.collect_set(F.when(F.col("_start").isNotNull(), F.struct("_start", (F.col("_start") + F.size("_window")).alias("_end"))))
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_set("_ids"))))
    by_row = found.groupBy("_row").agg(*[F.first(c).alias(c) for c in slim if c not in ("_row", "_w")], F.array_sort(marks).alias("_marks"), ids.alias("items"))
    covered = F.expr("aggregate(_marks, struct(0 AS upto, 0L AS n), (a, m) -> struct(greatest(a.upto, m._end) AS upto, a.n + greatest(0, m._end - greatest(a.upto, m._start)) AS n), a -> a.n)")
    out = by_row.withColumn("n_hit", covered).withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", F.col("n_hit") > 0)
    return out.select(*kept, *results)
