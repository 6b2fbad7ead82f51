"""Plain-text chunks with byte ranges, as one expression a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import SPACE, trimmed

WINDOW_CHARS, OVERLAP_CHARS = 700, 70
#: A text is cut once into pieces of the overlap's length: a window is so many, and starts so many on.
PIECES, STEP = WINDOW_CHARS // OVERLAP_CHARS, WINDOW_CHARS // OVERLAP_CHARS - 1


def plain_chunks(sources: DataFrame) -> DataFrame:
    """sources (with content) as chunks: chunk_sequence, body, source_start, source_end for each window.

    The trimmed text is cut into windows of 700 characters, each 630 on, the last ending with the text; ranges
    are UTF-8 bytes of content and tile it: the first starts at 0, the last ends with the document, each ends
    where the next starts or its body does, whichever is later. A blank document is one empty chunk.
    """
    keep = [c for c in sources.columns if c != "content"]
    cut = sources.withColumn("_text", trimmed(F.col("content")))
    cut = cut.withColumn("_p", F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{OVERLAP_CHARS}}}"), 0))
    cut = cut.withColumn("_n", F.expr(f"greatest(1, 1 + int(ceil((size(_p) - {PIECES}) / {STEP})))"))
    cut = cut.withColumn("_bodies", F.expr(f"transform(sequence(0, _n - 1), k -> array_join(slice(_p, k * {STEP} + 1, {PIECES}), ''))"))
    cut = cut.withColumn("_steps", F.expr(f"transform(sequence(0, _n - 1), k -> octet_length(array_join(slice(_p, k * {STEP} + 1, {STEP}), '')))"))
    lead = F.octet_length(F.regexp_extract("content", f"^{SPACE}*", 0))
    cut = cut.withColumn("_starts", F.aggregate("_steps", F.array(lead), lambda a, x: F.array_append(a, F.element_at(a, -1) + x)))
    cut = cut.withColumn("_all", F.octet_length("content"))
    chunk = """transform(_bodies, (b, k) -> struct(b AS body,
        CASE WHEN k = 0 THEN 0L ELSE bigint(_starts[k]) END AS source_start,
        CASE WHEN _text = '' THEN bigint(_all) ELSE greatest(CASE WHEN k = _n - 1 THEN bigint(_all) ELSE bigint(_starts[k + 1]) END, bigint(_starts[k] + octet_length(b))) END AS source_end))"""
    out = cut.select(*keep, F.posexplode(F.expr(chunk)).alias("chunk_sequence", "_c"))
    return out.select(*keep, F.col("chunk_sequence").cast("long").alias("chunk_sequence"), "_c.body", "_c.source_start", "_c.source_end")
