"""Quality rules by cross-document line frequency (native DataFrame functions only).

Lines that many different texts of one host share are boilerplate: they are hashed after normalisation, counted
per host over distinct texts, and known as such from a limit on. They are removed, and a document that is depleted by
that, left with too few words for the base rules or with little of what it had, is rejected, as is one that fails the
base rules.

The texts are read once: measures, and each line's hash and words, are stored by row, and all else works on those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.shared import drop, fixed, materialize, maybe_in, others, words_of

#: The base rules' least words, of the whole text and of what is left of it.
LEAST_WORDS = 50
#: What is not a symbol.
SYMBOLS = "[^#*$%&|<>]+"


def repeated_words() -> Column:
    """Number of words of _words inside three-word windows that occur twice or more.

    A window's hash and place are packed into one long (_packed) with as many low bits (_bits) as the places need,
    so that one primitive sort brings equal windows together in order of place; of neighbours that share the hash the
    words are compared. All within the row, in n log n steps.
    """
    return F.expr("""
      aggregate(
        sort_array(array_distinct(flatten(transform(
          filter(zip_with(_packed, slice(_packed, 2, size(_packed)), (a, b) -> CASE WHEN shiftrightunsigned(a ^ b, _bits) = 0 THEN struct(int(a & _mask) AS p, int(b & _mask) AS q) END),
            x -> x IS NOT NULL AND _words[x.p] = _words[x.q] AND _words[x.p + 1] = _words[x.q + 1] AND _words[x.p + 2] = _words[x.q + 2]),
          x -> array(x.p, x.q))))),
        struct(-3 AS last, 0L AS n),
        (a, p) -> struct(p AS last, a.n + least(3, p - a.last) AS n),
        a -> a.n)""")


def normalised(line: Column) -> Column:
    """Lower case, with every run of digits, punctuation and white space as one space."""
    return F.trim(F.regexp_replace(F.lower(line), r"[\s\p{Punct}\p{Nd}]+", " "))


def measured(docs: DataFrame) -> DataFrame:
    """docs with the base measures, and _row, _text (a key of host and text), _lines: each line's hash by host (null without a word) and its words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.withColumn("_words", fixed(words_of(F.col("text")))).withColumn("_raw", fixed(F.split(text, "\n")))
    base = base.withColumn("_bits", F.expr("int(ceil(log2(size(_words) + 1)))")).withColumn("_mask", F.expr("shiftleft(1L, _bits) - 1"))
    packed = "sort_array(transform(sequence(0, size(_words) - 3), i -> shiftleft(xxhash64(_words[i], _words[i + 1], _words[i + 2]), _bits) | i))"
    base = base.withColumn("_packed", F.expr(f"CASE WHEN size(_words) < 4 THEN array() ELSE {packed} END")).withColumn("_norms", F.transform("_raw", normalised))
    base = base.withColumn("_full", F.filter("_raw", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    line = lambda x, norm: F.struct(F.when(norm != "", F.xxhash64("source", norm)).alias("line"), F.size(words_of(x)).alias("n"))
    return base.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        repeated_words().alias("n_repeat_words"),
        F.monotonically_increasing_id().alias("_row"),
        F.xxhash64("source", "text").alias("_text"),
        F.zip_with("_raw", "_norms", line).alias("_lines"),
    ).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def boilerplate(lines: DataFrame, min_docs: int) -> DataFrame:
    """(_line): the lines that at least min_docs different texts of their host hold. Sums are taken by line and text first."""
    return lines.groupBy("_line").agg(F.count_distinct("_text").alias("_docs")).where(F.col("_docs") >= min_docs).select("_line")


def quality(docs: DataFrame, *, min_docs: int = 25, own_share: float = 0.2, clean: bool = False, carry: bool = True) -> DataFrame:
    """docs with the base measures, n_removed_words and `kept`.

    docs needs text and source (the host). A line is boilerplate if at least min_docs different texts of its host
    hold it, whatever its length: exact copies of a text count once. The limit is a number and no share, so that one
    boilerplate is caught alike in small and in very large hosts; by chance alone, lines of the driver's hosts stand in
    one to three texts. n_removed_words: the words of a document's boilerplate lines. A document is depleted when
    the others hold fewer words than the base rules ask for (LEAST_WORDS) or less than own_share of its words. kept:
    not base_failed and not depleted. With `clean`, `text` comes without its boilerplate lines; measures and verdicts
    are those of the whole text. Without `carry` the result lacks the text.

    Nulls: a null text has no words and fails the base rules; null sources form one host; doc_id is not used. Very
    long texts are rows like others: windows and lines are arrays of a row. Repeated rows are each returned, with
    equal verdicts. Empty table: empty result. Other columns stay; those named like a result or with an underscore
    in front are left out.
    """
    results = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept"]
    docs = others(docs, results)
    out = docs.columns if carry or clean else [c for c in docs.columns if c != "text"]
    found = measured(docs)
    stored = materialize(found.select(*out, *[c for c in found.columns if c not in docs.columns]), "measured")
    lines = stored.select("_row", "_text", F.posexplode("_lines").alias("_at", "_l")).select("_row", "_text", "_at", F.col("_l.line").alias("_line"), F.col("_l.n").alias("_n")).where("_line IS NOT NULL")
    common = materialize(boilerplate(lines, min_docs), "boilerplate")
    # Lines that surely are their own stay where they are read.
    hits = lines.where(maybe_in("_line", common)).join(common, "_line")
    # A document's hits are at most its lines.
    lost = materialize(hits.groupBy("_row").agg(F.sum("_n").alias("_lost"), F.collect_set("_at").alias("_cut")), "lost")
    drop(common)
    doubtful = maybe_in("_row", lost.select("_row"))
    none = stored.where(~doubtful).withColumns({"_lost": F.lit(0).cast("long"), "_cut": F.array().cast("array<int>")})
    judged = none.unionByName(stored.where(doubtful).join(lost, "_row", "left").select(*stored.columns, "_lost", "_cut"))
    judged = judged.withColumn("n_removed_words", F.coalesce("_lost", F.lit(0).cast("long")))
    left = F.col("n_words") - F.col("n_removed_words")
    judged = judged.withColumn("kept", ~F.col("base_failed") & (left >= LEAST_WORDS) & (left >= own_share * F.col("n_words")))
    if clean:
        rest = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_cut", i)), "\n")
        judged = judged.withColumn("text", F.when(F.col("n_removed_words") > 0, rest).otherwise(F.col("text")))
    return judged.select(*out, *results)
