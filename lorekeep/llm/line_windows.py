"""Line dedup by overlapping three-line windows (native DataFrame functions only).

Every run of three consecutive lines is hashed; windows that lie in several places of the corpus are kept
where they come first and their lines are removed elsewhere, overlapping windows together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.shared import apart, fixed, materialize, others

WIDTH = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def hashes(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a text that are independent: what is hashed first is the seed of what follows."""
    return F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(1), text).alias("_h2")


def document_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, _key, _at, _end, _h1, _h2): windows over lines with content, as places in the whole text.

    A document with fewer such lines than a window is one window of all of them.
    """
    full = docs.select("doc_id", F.xxhash64("text").alias("_key"), fixed(_lines(F.col("text"))).alias("_l"))
    full = full.withColumn("_p", fixed(F.expr(r"filter(sequence(0, size(_l) - 1), i -> _l[i] rlike '[^\\x20\\x09-\\x0D]')"))).where("size(_p) > 0")
    starts = full.select("doc_id", "_key", "_l", "_p", F.explode(F.expr(f"sequence(0, greatest(size(_p) - {WIDTH}, 0))")).alias("_i"))
    last = f"least(_i + {WIDTH}, size(_p)) - 1"
    text = F.expr(f"array_join(transform(slice(_p, _i + 1, {WIDTH}), p -> trim(_l[p])), '\n')")
    return starts.select("doc_id", "_key", F.expr("_p[_i]").alias("_at"), F.expr(f"_p[{last}]").alias("_end"), *hashes(text))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with `text` without repeated three-line windows, n_lines, n_removed and text_before_chars.

    Windows skip lines without a word, and lines are compared without the spaces at their ends. The first
    place is the one with the least doc_id, then the least line; every later place of the window loses all
    its lines. A line is so removed only if an earlier place holds it. Windows are told apart by 128 bits.

    Nulls: a null text stays null; a null doc_id comes before all others. Rows with equal doc_id and text are
    the same place and share their fate. Empty table: empty result. Other columns stay; those named like a result
    or with an underscore in front are left out.
    """
    docs = others(docs, ("n_lines", "n_removed", "text_before_chars"))
    kept = docs.columns
    found = materialize(document_windows(docs), "windows")
    first = found.groupBy("_h1", "_h2").agg(F.min(F.struct("doc_id", "_at", "_key")).alias("_first"), F.count(F.lit(1)).alias("_times")).where("_times > 1").drop("_times")
    later = found.join(apart(first), ["_h1", "_h2"]).where(~F.struct("doc_id", "_at", "_key").eqNullSafe(F.col("_first")))
    # A document's windows are at most its lines.
    spans = later.groupBy(F.col("doc_id").alias("_doc"), F.col("_key").alias("_k")).agg(F.array_sort(F.collect_set(F.struct("_at", "_end"))).alias("_cuts"))
    # Gaps between merged spans, as (first line, lines).
    gaps = "aggregate(_cuts, struct(0 AS upto, CAST(array() AS array<struct<s:int,n:int>>) AS gaps), (a, c) -> struct(greatest(a.upto, c._end + 1) AS upto, CASE WHEN c._at > a.upto THEN array_append(a.gaps, struct(a.upto AS s, c._at - a.upto AS n)) ELSE a.gaps END AS gaps), a -> CASE WHEN a.upto < size(_l) THEN array_append(a.gaps, struct(a.upto AS s, size(_l) - a.upto AS n)) ELSE a.gaps END)"
    joined = docs.withColumn("_t", F.xxhash64("text")).join(spans, F.col("_t").eqNullSafe(F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left").withColumn("_l", fixed(_lines(F.col("text"))))
    left = F.expr(f"CASE WHEN _cuts IS NULL THEN _l ELSE flatten(transform({gaps}, g -> slice(_l, g.s + 1, g.n))) END")
    out = joined.withColumn("_left", left).withColumn("text_before_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long"))
    text = F.when(F.col("text").isNotNull(), F.array_join("_left", "\n"))
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in kept], F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size("_left")).cast("long").alias("n_removed"), "text_before_chars")
