"""Mixing sources to target weights by entropy balancing (native DataFrame functions only).

Every document gets a rate: the rates least far, in relative entropy over the interval from 0 to the most
repeats, from taking everything once, among those whose expected words meet each source's target. The convex
dual has one multiplier a source, which tilts exponentially by what is constrained, a document's words. A document's
part of the dual depends on its source and size alone, so each source's histogram of sizes is one row, where
safeguarded Newton steps solve its multiplier; sources are solved side by side. The rates are then rounded into copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.shared import drop, fixed, global_rank, materialize, others, words_of

#: Bins a source at each pass over the rounding order, and passes: the order is resolved to their power.
BINS, PASSES = 1024, 3
#: Documents a source that fill up what the cut leaves, one after the other.
FILLED = 3
#: Bound of a multiplier: beyond it the shortest text that counts is at an end of its rates.
FAR = 1e6


def targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """(source, source_size, _mean, target): shares of the whole by weight, none above `most` times its source."""
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size"), F.sum("_n").alias("_docs"))
    ranked, _ = global_rank(sources, [F.col("source").asc_nulls_last()], "sources")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", F.greatest(F.col("source_size") / F.col("_docs"), F.lit(1e-3)).alias("_mean"), weight.alias("_weight"), (most * F.col("source_size")).alias("_cap"))
    ranked = materialize(ranked, "weighted")
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    # Water filling: a source is full if its share at the present level is above its cap; the level only rises.
    level = 0.0
    while True:
        full = F.col("_weight") * level >= F.col("_cap")
        held, free = ranked.agg(F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_weight")))).first()
        raised = (total - (held or 0.0)) / free if free else level
        if not free or raised <= level:
            break
        level = raised
    return ranked.withColumn("target", F.least(F.col("_cap"), F.col("_weight") * level))


def rate(multiplier: Column, size: Column, mean: Column, most: float) -> Column:
    """The tilted rate, between 0 and `most`, and 1 at a multiplier of 0."""
    tilt = F.exp(F.least(F.lit(60.0), F.greatest(F.lit(-60.0), multiplier * size / mean)))
    return most * tilt / (most - 1 + tilt)


def multipliers(sizes: DataFrame, aims: DataFrame, most: float, rounds: int, close: float) -> DataFrame:
    """aims with _tilt, the dual solution of each source.

    A source's histogram is one row: it has at most as many sizes as its longest text has words. A step sums words and
    their slope at the present multiplier and goes by Newton, or halves the bracket where that leaves it; it stands still
    once the words are within `close` of the target. Halving alone would reach the bracket's last bit in `rounds` steps;
    a source that does not get there is an error.
    """
    bins = sizes.groupBy(F.col("source").alias("_s")).agg(F.sort_array(F.collect_list(F.struct("size", "_n"))).alias("_sizes"))
    rows = aims.join(bins, aims["source"].eqNullSafe(bins["_s"])).drop("_s").withColumn("_bins", F.expr("transform(_sizes, x -> struct(double(x.size) * x._n AS m, double(x.size) / _mean AS r))"))
    tilt = "exp(least(60D, greatest(-60D, s.t * x.r)))"
    part = f"{tilt} / ({most - 1}D + {tilt})"
    sums = f"aggregate(_bins, struct(0D AS w, 0D AS g), (a, x) -> struct(a.w + {most}D * x.m * ({part}) AS w, a.g + {most}D * x.m * x.r * ({part}) * (1 - ({part})) AS g))"
    at = f"element_at(transform(array({sums}), q -> struct(target - q.w AS short, CASE WHEN q.g > 0 THEN s.t + (target - q.w) / q.g END AS newton)), 1)"
    low, high = "CASE WHEN q.short > 0 THEN s.t ELSE s.lo END", "CASE WHEN q.short < 0 THEN s.t ELSE s.hi END"
    moved = f"CASE WHEN q.newton > ({low}) AND q.newton < ({high}) THEN q.newton ELSE (({low}) + ({high})) / 2 END"
    step = f"element_at(transform(array({at}), q -> CASE WHEN abs(q.short) <= {close}D * target THEN struct(s.t AS t, s.lo AS lo, s.hi AS hi, true AS done) ELSE struct({moved} AS t, {low} AS lo, {high} AS hi, false AS done) END), 1)"
    solved = F.expr(f"aggregate(sequence(1, {rounds}), struct(0D AS t, -{FAR}D AS lo, {FAR}D AS hi, target >= {most}D * source_size AS done), (s, k) -> CASE WHEN s.done THEN s ELSE {step} END)")
    found = rows.withColumn("_at", solved).select(*aims.columns, F.col("_at.t").alias("_tilt"), F.expr("_at.done OR _at.hi - _at.lo < 1e-9").alias("_done"))
    found = materialize(found, "tilt")
    if left := found.where("NOT _done").limit(1).count():
        raise ArithmeticError(f"no multiplier meets the target of {left} source or more after {rounds} steps")
    return found.drop("_done")


def thresholds(rated: DataFrame, aims: DataFrame) -> DataFrame:
    """(_source, _up, _more): by source, up to which point of the rounding order rates are rounded up, and the places behind it that are as well.

    rated has source, size, _least (copies that are sure), _order in [0, 1) and _m (documents alike in these). The point
    is the last at which the words rounded up do not exceed what is missing; each pass sums them by bin and looks into
    the bin it lies in. What is missing then is less than one document has, and FILLED documents, each the largest that
    fits, fill it up.
    """
    sure = rated.groupBy(F.col("source").alias("_source")).agg(F.sum(F.col("size") * F.col("_least") * F.col("_m")).alias("_sure"))
    at = aims.join(sure, aims["source"].eqNullSafe(sure["_source"])).select("_source", (F.col("target") - F.col("_sure")).alias("_need"), F.lit(0).cast("long").alias("_bin"))
    width = 1
    for k in range(PASSES):
        width *= BINS
        bin_of = F.floor(F.col("_order") * float(width)).cast("long")
        inside = rated.where("_order < 1").withColumn("_fine", bin_of).join(at, rated["source"].eqNullSafe(at["_source"]))
        if k:
            inside = inside.where(F.floor(F.col("_fine") / BINS) == F.col("_bin"))
        bins = inside.groupBy("_source", "_need", "_fine").agg(F.sum(F.col("size") * F.col("_m")).alias("_words"))
        # At most BINS rows a source here.
        run = bins.withColumn("_sum", F.sum("_words").over(Window.partitionBy("_source").orderBy("_fine")))
        fits = F.col("_sum") <= F.col("_need")
        if k == PASSES - 1:
            ends = run.groupBy("_source", "_need").agg(F.max(F.when(fits, F.col("_fine"))).alias("_last"), F.max(F.when(fits, F.col("_sum"))).alias("_got"), F.min("_fine").alias("_first"))
            up = F.coalesce(F.col("_last") + 1, F.col("_first")) / float(width)
            at = ends.select("_source", up.alias("_up"), (F.col("_need") - F.coalesce("_got", F.lit(0))).alias("_need"), F.array().cast("array<double>").alias("_more"))
        else:
            met = run.withColumn("_ahead", F.col("_sum") - F.col("_words"))
            met = met.groupBy("_source", "_need").agg(F.min(F.when(F.col("_sum") >= F.col("_need"), F.col("_fine"))).alias("_hit"), F.max("_fine").alias("_final"))
            chosen = met.select(F.col("_source").alias("_s"), F.coalesce("_hit", "_final").alias("_pick"))
            at = run.join(chosen, run["_source"].eqNullSafe(chosen["_s"]) & (run["_fine"] == chosen["_pick"])).select("_source", (F.col("_need") - (F.col("_sum") - F.col("_words"))).alias("_need"), F.col("_fine").alias("_bin"))
        at = materialize(at, "rounding")
    for _ in range(FILLED):
        words = F.col("size") * F.col("_m")
        open_ = rated.where("_order < 1").join(at, rated["source"].eqNullSafe(at["_source"])).where((F.col("_order") >= F.col("_up")) & (words > 0) & (words <= F.col("_need")) & ~F.array_contains("_more", F.col("_order")))
        best = open_.groupBy(F.col("_source").alias("_s")).agg(F.max(F.struct(words.alias("w"), (-F.col("_order")).alias("o"))).alias("_best"))
        filled = at.join(best, at["_source"].eqNullSafe(best["_s"]), "left")
        more = F.when(F.col("_best").isNull(), F.col("_more")).otherwise(F.array_append("_more", -F.col("_best.o")))
        after = materialize(filled.select("_source", "_up", (F.col("_need") - F.coalesce("_best.w", F.lit(0))).alias("_need"), more.alias("_more")), "filling")
        drop(at)
        at = after
    return at.select("_source", "_up", "_more")


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = 3, rounds: int = 80, close: float = 1e-9) -> DataFrame:
    """docs with size (words), source_size, target, rate, copies and taken (words, with repeats).

    Sources in order of code points, null last, weigh `weights` in turn. The share of each is of all words; it
    stops at `most` times its source's words, and the excess is shared again. A document is taken 0 to `most`
    times. Which rates are rounded up is decided by a hash of doc_id and text: up to a cut of that order, which is set for
    each source, and FILLED documents behind it, so that the words taken are less than a document short of the target and
    never above it, unless the copies that are sure exceed it already.

    Nulls: a null text has no words; null sources form one source. Repeated rows (one doc_id and text) have one place in
    the order and are taken like each other. Very long texts are documents like others: one that exceeds its source's
    target may be left out. Empty table: empty result. Other columns stay; those named like a result or with an
    underscore in front are left out.
    """
    results = ["size", "source_size", "target", "rate", "copies", "taken"]
    docs = others(docs, results)
    kept = docs.columns
    sized = docs.select(*kept).withColumn("size", fixed(F.size(words_of(F.col("text"))).cast("long")))
    sizes = materialize(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("_n")), "sizes")
    aims = multipliers(sizes, targets(sizes, weights, float(most)), float(most), rounds, close)
    aims = aims.select(F.col("source").alias("_src"), "source_size", "_mean", "target", "_tilt")
    rated = sized.join(aims, sized["source"].eqNullSafe(aims["_src"])).drop("_src")
    full = F.col("target") >= most * F.col("source_size")
    rated = rated.withColumn("rate", F.when(full, F.lit(float(most))).otherwise(rate(F.col("_tilt"), F.col("size"), F.col("_mean"), float(most))))
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 50)) / float(1 << 50)
    # Documents come in the order in which a growing part of each fraction is rounded up.
    rated = rated.withColumn("_least", F.least(F.floor("rate"), F.lit(most)).cast("long"))
    part = F.col("rate") - F.col("_least")
    rated = rated.withColumn("_order", F.when(part > 0, (chance + 1 - part) / 2).otherwise(F.lit(2.0)))
    slim = materialize(rated.groupBy("source", "size", "_least", "_order").agg(F.count(F.lit(1)).alias("_m")), "rated")
    cuts = thresholds(slim, aims.withColumnRenamed("_src", "source"))
    done = rated.join(cuts, rated["source"].eqNullSafe(cuts["_source"]), "left")
    up = F.when((F.col("_order") < F.col("_up")) | F.array_contains("_more", F.col("_order")), 1).otherwise(0)
    done = done.withColumn("copies", F.least(F.col("_least") + up, F.lit(most)).cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return done.select(*kept, "size", F.col("source_size").cast("long").alias("source_size"), "target", "rate", "copies", "taken")
