"""The engine's own queries over the driver's tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.functions import vectors as V
from lorekeep.operators import bm25, maintenance, ranking, reading, vector_index
from lorekeep.operators.chunking import plain_chunks
from lorekeep.plans import views

QUERY, PHRASE, LIMIT, SOME = "the tion erth anly onwhe", "er the", 20, ("src1", "src3", "src5")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_SP = r"[\t\n\x0B\f\r\p{Z}\x{85}]"
_SOURCES = "src AS (SELECT source AS collection, 'doc-' || doc_id || '.pdf' AS path, sha256(text) AS source_hash, text AS content, doc_id FROM documents)"
_CHUNKS = rf"""{_SOURCES}, trimmed AS (SELECT *, regexp_replace(content, '^{_SP}+|{_SP}+$', '', 'g') AS t, strlen(regexp_extract(content, '^{_SP}*')) AS lead FROM src),
windows AS (SELECT *, CASE WHEN length(t) <= 700 THEN 1 ELSE 1 + CAST(ceil((length(t) - 700) / 630.0) AS BIGINT) END AS n FROM trimmed),
cut AS (SELECT *, unnest(generate_series(0, n - 1)) AS k FROM windows),
placed AS (SELECT collection, path, source_hash, content, doc_id, t, n, k AS chunk_sequence, substr(t, k * 630 + 1, 700) AS body, lead + strlen(substr(t, 1, k * 630)) AS own, lead + strlen(substr(t, 1, (k + 1) * 630)) AS nxt FROM cut),
chunks AS (SELECT collection, path, source_hash, doc_id, CAST(chunk_sequence AS BIGINT) AS chunk_sequence, body, CAST(CASE WHEN chunk_sequence = 0 THEN 0 ELSE own END AS BIGINT) AS source_start,
  CAST(CASE WHEN t = '' THEN strlen(content) ELSE greatest(CASE WHEN chunk_sequence = n - 1 THEN strlen(content) ELSE nxt END, own + strlen(body)) END AS BIGINT) AS source_end FROM placed)"""
_TOKENS = r"list_filter(string_split_regex(lower(body), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_TERMS = "[" + ", ".join(f"'{t}'" for t in T.query_tokens(QUERY)) + "]"


def _bm25(limit_to: str = "TRUE") -> str:
    return rf"""{_CHUNKS}, tok AS (SELECT collection, path, chunk_sequence, body, {_TOKENS} AS t FROM chunks),
stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(len(t)) AS DOUBLE) / count(*) AS avgdl FROM tok WHERE len(t) > 0),
terms AS (SELECT unnest({_TERMS}) AS term),
df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM terms JOIN tok ON list_contains(t, term) GROUP BY term),
tf AS (SELECT collection, path, chunk_sequence, term, CAST(len(t) AS DOUBLE) AS dl, CAST(len(list_filter(t, lambda x: x = term)) AS DOUBLE) AS tf FROM tok JOIN terms ON list_contains(t, term) WHERE {limit_to}),
scored AS (SELECT collection, path, chunk_sequence, round(sum(ln(CAST(1 AS DOUBLE) + (n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) * (tf * CAST(2.2 AS DOUBLE)) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term), stats GROUP BY ALL),
hits AS (SELECT s.*, body FROM scored s JOIN tok USING (collection, path, chunk_sequence))"""


def _cosine(limit_to: str = "TRUE") -> str:
    return f"""q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0),
vec AS (SELECT 'label-' || label AS collection, 'v' || (vec_id // 5) AS path, vec_id % 5 AS chunk_sequence, 'vector ' || vec_id AS body, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
hits AS (SELECT collection, path, chunk_sequence, body, round(greatest(list_cosine_similarity(e, v), CAST(0 AS DOUBLE)), 6) AS score FROM vec, q WHERE {limit_to})"""


_HEAD = "translate(substr(body, 1, 60), chr(13) || chr(10), '  ') || CASE WHEN length(body) > 60 THEN '…' ELSE '' END"
_AT = f"CASE WHEN instr(body, '{PHRASE}') - 1 > 0 AND instr(body, '{PHRASE}') = length(body) THEN length(body) ELSE greatest(instr(body, '{PHRASE}') - 1, 0) END"
_FTS = f"CASE WHEN {_AT} - 30 > 0 THEN '…' ELSE '' END || translate(substr(body, greatest({_AT} - 30, 0) + 1, 60), chr(13) || chr(10), '  ') || CASE WHEN greatest({_AT} - 30, 0) + 60 < length(body) THEN '…' ELSE '' END"


def _chunk_level(ctes: str, table: str, snippet: str) -> str:
    return f"WITH {ctes} SELECT h.collection, h.path, h.chunk_sequence, h.score, {snippet} AS snippet, chunk_count FROM (SELECT * FROM hits ORDER BY score DESC, collection, path, chunk_sequence LIMIT {LIMIT}) h JOIN (SELECT collection, path, count(*) AS chunk_count FROM {table} GROUP BY ALL) USING (collection, path)"


def _doc_level(ctes: str, table: str, snippet: str) -> str:
    return f"""WITH {ctes}, fetched AS (SELECT * FROM hits ORDER BY score DESC, collection, path, chunk_sequence LIMIT {10 * LIMIT}),
folded AS (SELECT *, row_number() OVER (PARTITION BY collection, path ORDER BY score DESC, chunk_sequence) AS r, count(*) OVER (PARTITION BY collection, path) AS matched_chunks FROM fetched)
SELECT h.collection, h.path, h.score, {snippet} AS snippet, matched_chunks, chunk_count FROM (SELECT * FROM folded WHERE r = 1 ORDER BY score DESC, collection, path LIMIT {LIMIT}) h JOIN (SELECT collection, path, count(*) AS chunk_count FROM {table} GROUP BY ALL) USING (collection, path)"""


_QUERY_SNIPPET = _HEAD  # the whole query never stands verbatim


@query(_doc_level(_bm25(), "chunks", _QUERY_SNIPPET))
def bm25_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = views.chunks(spark, sf_dir)
    return ranking.documents(bm25.scored(chunks, QUERY), chunks, LIMIT, T.fts_snippet(F.col("body"), QUERY))


@query(_chunk_level(_bm25(), "chunks", _QUERY_SNIPPET))
def bm25_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = views.chunks(spark, sf_dir)
    return ranking.passages(bm25.scored(chunks, QUERY), chunks, LIMIT, T.fts_snippet(F.col("body"), QUERY))


@query(_doc_level(_bm25(f"collection IN {SOME}"), "chunks", _QUERY_SNIPPET))
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = views.chunks(spark, sf_dir)
    return ranking.documents(bm25.scored(chunks, QUERY, collections=SOME), chunks, LIMIT, T.fts_snippet(F.col("body"), QUERY))


@query(f"WITH {_bm25()} SELECT collection, path, chunk_sequence, score FROM hits ORDER BY score DESC, collection, path, chunk_sequence LIMIT {LIMIT}")
def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores from an inverted index."""
    chunks = views.chunks(spark, sf_dir)
    index, sums = bm25.postings(chunks), bm25.corpus_stats(chunks).first()
    stats = bm25.index_statistics(index, T.query_tokens(QUERY), sums["n_chunks"], sums["total_length"])
    scored = bm25.scored_from_index(index, QUERY, stats)
    return scored.orderBy(*ranking.by_chunk()).limit(LIMIT)


@query(_doc_level(_cosine(), "vec", _HEAD))
def vector_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.vectors(spark, sf_dir)
    return ranking.documents(ranking.vector_scored(rows, views.query_vector(spark, sf_dir)), rows, LIMIT, T.head_snippet(F.col("body")))


@query(_chunk_level(_cosine(), "vec", _HEAD))
def vector_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.vectors(spark, sf_dir)
    return ranking.passages(ranking.vector_scored(rows, views.query_vector(spark, sf_dir)), rows, LIMIT, T.head_snippet(F.col("body")))


@query(f"WITH {_cosine()} SELECT collection, path, chunk_sequence, score FROM hits ORDER BY score DESC, collection, path, chunk_sequence LIMIT {LIMIT}")
def vector_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from an inverted file, whose cells are probed until none can hold a better one."""
    rows = views.vectors(spark, sf_dir)
    centres = vector_index.fitted(rows, vector_index.cell_count(rows.count()))
    index = vector_index.assigned(rows, centres)
    return vector_index.search(index, vector_index.cells_of(index, centres), views.query_vector(spark, sf_dir), LIMIT, exact=True)


@query(_doc_level(_cosine("collection IN ('label-1', 'label-2')"), "vec", _HEAD))
def vector_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.vectors(spark, sf_dir)
    return ranking.documents(ranking.vector_scored(rows, views.query_vector(spark, sf_dir), collections=("label-1", "label-2")), rows, LIMIT, T.head_snippet(F.col("body")))


def _hybrid(size: int) -> str:
    one = "CAST(1 AS DOUBLE)"
    return rf"""{_CHUNKS}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0),
held AS (SELECT c.collection, c.path, c.chunk_sequence, c.body, CAST(e.embedding AS DOUBLE[]) AS e FROM chunks c LEFT JOIN embeddings e ON e.vec_id = c.doc_id AND c.chunk_sequence = 0),
tok AS (SELECT collection, path, chunk_sequence, body, {_TOKENS} AS t FROM held),
stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(len(t)) AS DOUBLE) / count(*) AS avgdl FROM tok WHERE len(t) > 0),
terms AS (SELECT unnest({_TERMS}) AS term),
df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM terms JOIN tok ON list_contains(t, term) GROUP BY term),
tf AS (SELECT collection, path, chunk_sequence, term, CAST(len(t) AS DOUBLE) AS dl, CAST(len(list_filter(t, lambda x: x = term)) AS DOUBLE) AS tf FROM tok JOIN terms ON list_contains(t, term)),
lex AS (SELECT collection, path, chunk_sequence, round(sum(ln({one} + (n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) * (tf * CAST(2.2 AS DOUBLE)) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term), stats GROUP BY ALL),
sem AS (SELECT collection, path, chunk_sequence, round(greatest(list_cosine_similarity(e, v), CAST(0 AS DOUBLE)), 6) AS score FROM held, q WHERE e IS NOT NULL),
a AS (SELECT * FROM (SELECT collection, path, chunk_sequence, row_number() OVER (ORDER BY score DESC, collection, path, chunk_sequence) AS ra FROM lex) WHERE ra <= {size}),
b AS (SELECT * FROM (SELECT collection, path, chunk_sequence, row_number() OVER (ORDER BY score DESC, collection, path, chunk_sequence) AS rb FROM sem) WHERE rb <= {size}),
rrf AS (SELECT collection, path, chunk_sequence, round(coalesce({one} / (60 + ra), CAST(0 AS DOUBLE)) + coalesce({one} / (60 + rb), CAST(0 AS DOUBLE)), 6) AS score FROM a FULL JOIN b USING (collection, path, chunk_sequence)),
hits AS (SELECT r.*, body FROM rrf r JOIN held USING (collection, path, chunk_sequence) ORDER BY score DESC, collection, path, chunk_sequence LIMIT {size})"""


@query(_doc_level(_hybrid(10 * LIMIT), "held", _HEAD))
def hybrid_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.hybrid(spark, sf_dir)
    scored = ranking.fused(bm25.scored(rows, QUERY), ranking.vector_scored(rows, views.query_vector(spark, sf_dir)), ranking.fetch_size(LIMIT, "doc"))
    return ranking.documents(scored, rows, LIMIT, T.head_snippet(F.col("body")))


@query(_chunk_level(_hybrid(LIMIT), "held", _HEAD))
def hybrid_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.hybrid(spark, sf_dir)
    scored = ranking.fused(bm25.scored(rows, QUERY), ranking.vector_scored(rows, views.query_vector(spark, sf_dir)), LIMIT)
    return ranking.passages(scored, rows, LIMIT, T.head_snippet(F.col("body")))


@query(f"WITH {_CHUNKS} SELECT count(*) AS rows_all, count(e.embedding) AS rows_with_vector FROM chunks c LEFT JOIN embeddings e ON e.vec_id = c.doc_id AND c.chunk_sequence = 0")
def null_vector_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.hybrid(spark, sf_dir)
    found = ranking.vector_scored(rows, views.query_vector(spark, sf_dir)).agg(F.count(F.lit(1)).alias("rows_with_vector"))
    return rows.agg(F.count(F.lit(1)).alias("rows_all")).withColumn("rows_with_vector", F.lit(found.first()[0]).cast("long"))


@query("WITH x AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN CAST('nan' AS DOUBLE) ELSE CAST(vec_id % 21 AS DOUBLE) / 10 END AS d FROM embeddings) SELECT vec_id, round(CASE WHEN isnan(d) THEN 0 ELSE greatest(1 - d, 0) END, 6) AS score FROM x")
def distance_to_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id")
    distance = F.when(F.col("vec_id") % 7 == 0, F.lit(float("nan"))).otherwise((F.col("vec_id") % 21).cast("double") / 10)
    return rows.select("vec_id", F.round(V.distance_to_score(distance), 6).alias("score"))


@query("WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3 * x * 3))) AS n FROM embeddings) SELECT vec_id, CAST(unnest(generate_series(0, len(e) - 1)) AS INTEGER) AS place, round(unnest(e) * 3 / greatest(n, 1e-12), 6) AS value FROM x")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    unit = rows.select("vec_id", V.l2_normalize(F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3)).alias("u"))
    return unit.select("vec_id", F.posexplode("u").alias("place", "value")).withColumn("value", F.round("value", 6))


@query("WITH x AS (SELECT label, unnest(embedding) AS v, CAST(unnest(generate_series(0, len(embedding) - 1)) AS INTEGER) AS place FROM embeddings WHERE vec_id % 10 < 5) SELECT label, place, round(avg(CAST(v AS DOUBLE)), 6) AS value FROM x GROUP BY ALL")
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's vectors as tokens of one text, half of them masked."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    mask = F.when(F.col("vec_id") % 10 < 5, 1).otherwise(0)
    # One label's vectors stand for the tokens of one passage: a few hundred.
    held = rows.groupBy("label").agg(F.collect_list("embedding").alias("v"), F.collect_list(mask).alias("m"))
    pooled = held.where(F.exists("m", lambda x: x == 1)).select("label", V.mean_pool(F.col("v"), F.col("m")).alias("p"))
    return pooled.select("label", F.posexplode("p").alias("place", "value")).withColumn("value", F.round("value", 6))


@query(f"WITH {_CHUNKS} SELECT collection, path, chunk_sequence, body FROM chunks")
def plain_chunk_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.chunks(spark, sf_dir).select("collection", "path", "chunk_sequence", "body")


@query(f"WITH {_CHUNKS} SELECT collection, path, chunk_sequence, source_start, source_end FROM chunks")
def chunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.chunks(spark, sf_dir).select("collection", "path", "chunk_sequence", "source_start", "source_end")


@query(f"WITH {_CHUNKS} SELECT collection, path, count(*) AS chunk_count FROM chunks GROUP BY ALL")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.chunk_counts(views.chunks(spark, sf_dir))


@query(rf"WITH {_CHUNKS}, t AS (SELECT row_number() OVER () AS r, unnest({_TOKENS}) AS term FROM chunks) SELECT term, count(DISTINCT r) AS df, count(*) AS cf FROM t GROUP BY term")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.term_stats(views.chunks(spark, sf_dir))


@query(rf"WITH {_CHUNKS}, t AS (SELECT len({_TOKENS}) AS l FROM chunks) SELECT count(*) AS n_chunks, CAST(sum(l) AS BIGINT) AS total_length, round(CAST(sum(l) AS DOUBLE) / count(*), 6) AS avg_length FROM t WHERE l > 0")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.corpus_stats(views.chunks(spark, sf_dir))


@query(rf"WITH {_CHUNKS}, t AS (SELECT collection, path, chunk_sequence, {_TOKENS} AS t FROM chunks), u AS (SELECT *, unnest(t) AS term FROM t) SELECT term, collection, path, chunk_sequence, CAST(len(t) AS BIGINT) AS length, count(*) AS tf FROM u GROUP BY ALL")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.postings(views.chunks(spark, sf_dir))


@query(f"WITH {_CHUNKS} SELECT collection, path, chunk_sequence, {_FTS} AS snippet FROM chunks")
def fts_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.chunks(spark, sf_dir).select("collection", "path", "chunk_sequence", T.fts_snippet(F.col("body"), f" {PHRASE}\n").alias("snippet"))


@query(f"WITH {_CHUNKS} SELECT collection, path, chunk_sequence, {_HEAD} AS snippet FROM chunks")
def head_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.chunks(spark, sf_dir).select("collection", "path", "chunk_sequence", T.head_snippet(F.col("body")).alias("snippet"))


@query("WITH p AS (SELECT doc_id, source || '/doc-' || doc_id || CASE doc_id % 6 WHEN 0 THEN '.md' WHEN 1 THEN '.MarkDown' WHEN 2 THEN '.PDF' WHEN 3 THEN '.txt' WHEN 4 THEN '' ELSE '.md.bak' END AS path FROM documents) SELECT doc_id, path, CASE WHEN lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('md', 'markdown') THEN 'markdown' WHEN lower(regexp_extract(path, '\\.([^./]+)$', 1)) = 'pdf' THEN 'pdf' END AS format FROM p".replace("\\\\", "\\"))
def format_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    ending = F.element_at(F.array(*map(F.lit, (".md", ".MarkDown", ".PDF", ".txt", "", ".md.bak"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return rows.select("doc_id", F.concat("source", F.lit("/doc-"), "doc_id", ending).alias("path")).withColumn("format", T.format_of(F.col("path")))


@query(f"WITH {_SOURCES} SELECT collection, path, source_hash FROM src")
def source_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sources(spark, sf_dir).select("collection", "path", "source_hash")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'decoded' END AS decoded FROM documents")
def markdown_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict UTF-8: a stray byte makes a document unreadable."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    content = F.when(F.col("doc_id") % 4 == 0, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("C3")))).otherwise(F.encode("text", "UTF-8"))
    return rows.select("doc_id", F.when(T.is_valid_utf8(content.cast("string")), F.lit("decoded")).alias("decoded"))


@query(f"WITH {_CHUNKS} SELECT collection, path, chunk_sequence, 'passage: ' || body AS text FROM chunks WHERE body <> ''")
def prefix_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.embed import prefixed

    rows = views.chunks(spark, sf_dir).where("body <> ''")
    return rows.select("collection", "path", "chunk_sequence", prefixed(F.col("body"), "passage: ").alias("text"))


@query(f"WITH {_SOURCES} SELECT collection, path, content FROM src WHERE collection = 'src1' AND path = 'doc-1.pdf'")
def get_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.document(views.sources(spark, sf_dir), "src1", "doc-1.pdf")


@query(f"WITH {_CHUNKS}, ends AS (SELECT collection, path, min(chunk_sequence) AS f, max(chunk_sequence) AS last_chunk, min(source_start) AS s, max(source_end) AS e FROM chunks WHERE chunk_sequence BETWEEN 1 AND 3 GROUP BY ALL) SELECT collection, path, last_chunk, TRUE AS in_sync, decode(array_slice(encode(content), s + 1, e)) AS text FROM ends JOIN src USING (collection, path) WHERE f = 1")
def get_chunk_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = views.sources(spark, sf_dir)
    return reading.chunk_spans(plain_chunks(sources), sources, 1, 3)


@query(f"WITH {_SOURCES} SELECT collection, path, strlen(content) AS bytes, strlen(content) <= 4096 AS allowed FROM src")
def size_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.sources(spark, sf_dir)
    return rows.select("collection", "path", F.octet_length("content").cast("long").alias("bytes"), T.size_allowed(F.col("content"), 4096).alias("allowed"))


_CONFIGURED = [("src0", "/data/src0", "first"), ("src1", "/data/src1", None), ("unused", "/data/unused", None)]


@query("WITH c(name, path, description) AS (VALUES ('src0', '/data/src0', 'first'), ('src1', '/data/src1', NULL), ('unused', '/data/unused', NULL)) SELECT name, path, description, count(d.doc_id) AS document_count FROM c LEFT JOIN documents d ON d.source = c.name GROUP BY ALL")
def collection_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    configured = spark.createDataFrame(_CONFIGURED, "name string, path string, description string")
    return reading.collection_list(configured, views.sources(spark, sf_dir))


@query(f"WITH {_CHUNKS} SELECT (SELECT count(DISTINCT source) FROM documents) AS collections, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id) AS embedded, (SELECT count(*) FROM documents) AS sources")
def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.status(views.hybrid(spark, sf_dir), views.sources(spark, sf_dir))


_STATES = """base AS (SELECT doc_id, doc_id % 10 AS g, source AS collection, 'doc-' || doc_id || '.pdf' AS path, text FROM documents),
held AS (SELECT collection, path, make_timestamp((1700000000 + doc_id) * 1000000) AS modified_at, sha256(text) AS source_hash FROM base WHERE g <> 0),
stored AS (SELECT collection, path, sha256(text) AS source_hash FROM base WHERE g NOT IN (0, 4)),
disk AS (SELECT collection, path, make_timestamp(((CASE WHEN g IN (2, 3) THEN 1800000000 ELSE 1700000000 END) + doc_id) * 1000000) AS mtime, sha256(text || CASE WHEN g = 3 THEN ' changed' ELSE '' END) AS source_hash FROM base WHERE g <> 1),
acts AS (SELECT d.collection, d.path, d.mtime, d.source_hash, CASE WHEN h.modified_at IS NULL THEN 'new' WHEN d.mtime = h.modified_at THEN 'skip' WHEN d.source_hash = h.source_hash THEN 'touch_mtime' ELSE 'reingest' END AS action FROM disk d LEFT JOIN held h USING (collection, path))"""


@query(f"WITH {_STATES} SELECT collection, path, action FROM acts")
def incremental_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, _, disk = views.states(spark, sf_dir)
    return maintenance.decide_actions(disk, held).select("collection", "path", "action")


@query(f"WITH {_STATES} SELECT h.collection, h.path, h.source_hash FROM held h JOIN stored s USING (collection, path, source_hash)")
def mirror_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, stored, _ = views.states(spark, sf_dir)
    return maintenance.mirrored(held, stored).select("collection", "path", "source_hash")


@query(f"WITH {_STATES} SELECT d.collection, d.path FROM disk d JOIN held h ON d.collection = h.collection AND d.path = h.path AND d.mtime = h.modified_at JOIN stored s ON s.collection = h.collection AND s.path = h.path AND s.source_hash = h.source_hash")
def unread_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, stored, disk = views.states(spark, sf_dir)
    return maintenance.unread(disk.select("collection", "path", "mtime"), held, stored).select("collection", "path")


@query(f"WITH {_STATES} SELECT collection, path FROM (SELECT collection, path FROM held UNION SELECT collection, path FROM stored) EXCEPT SELECT collection, path FROM disk")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, stored, disk = views.states(spark, sf_dir)
    return maintenance.orphans(disk, held, stored)


@query(f"WITH {_STATES} SELECT h.collection, h.path, h.source_hash FROM held h SEMI JOIN disk d USING (collection, path)")
def orphan_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, stored, disk = views.states(spark, sf_dir)
    return maintenance.without(held, maintenance.orphans(disk, held, stored)).select("collection", "path", "source_hash")


@query(f"WITH {_CHUNKS}, kept AS (SELECT collection, path, chunk_sequence, body, source_hash FROM chunks WHERE doc_id % 10 <> 3) SELECT * FROM kept UNION ALL SELECT source, 'doc-' || doc_id || '.pdf', CAST(0 AS BIGINT), 'short', 'new' FROM documents WHERE doc_id % 10 = 3")
def upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents shrink to one chunk: their other chunks go."""
    chunks = views.chunks(spark, sf_dir).select("collection", "path", "chunk_sequence", "body", "source_hash")
    changed = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 10 = 3")
    fresh = changed.select(F.col("source").alias("collection"), F.concat(F.lit("doc-"), "doc_id", F.lit(".pdf")).alias("path"), F.lit(0).cast("long").alias("chunk_sequence"), F.lit("short").alias("body"), F.lit("new").alias("source_hash"))
    return maintenance.upsert(chunks, fresh)


@query(f"WITH {_STATES} SELECT collection, path, source_hash FROM stored ANTI JOIN disk USING (collection, path) UNION ALL SELECT collection, path, source_hash FROM disk")
def upsert_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, stored, disk = views.states(spark, sf_dir)
    return maintenance.upsert(stored.select("collection", "path", "source_hash"), disk.select("collection", "path", "source_hash"))


@query(f"WITH {_STATES} SELECT h.collection, h.path, epoch_us(coalesce(a.mtime, h.modified_at)) AS modified_us FROM held h LEFT JOIN (SELECT * FROM acts WHERE action = 'touch_mtime') a USING (collection, path)")
def touch_mtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, _, disk = views.states(spark, sf_dir)
    touched = maintenance.decide_actions(disk, held).where("action = 'touch_mtime'")
    return maintenance.touch(held, touched).select("collection", "path", F.unix_micros("modified_at").alias("modified_us"))


@query(f"WITH {_STATES} SELECT count(*) FILTER (WHERE action = 'new') AS new, count(*) FILTER (WHERE action = 'reingest') AS updated, count(*) FILTER (WHERE action IN ('skip', 'touch_mtime')) AS skipped, (SELECT count(*) FROM held ANTI JOIN disk USING (collection, path)) AS removed, CAST(0 AS BIGINT) AS failed FROM acts")
def update_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, stored, disk = views.states(spark, sf_dir)
    return maintenance.summary(maintenance.decide_actions(disk, held), maintenance.orphans(disk, held, stored))


@query(f"WITH {_CHUNKS} SELECT collection, path, max(chunk_sequence) AS last_chunk, arg_max(source_hash, chunk_sequence) AS source_hash FROM chunks WHERE doc_id % 10 <> 7 GROUP BY ALL")
def index_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last chunk's state per document; documents whose path climbs out of the collection are left out."""
    chunks = views.chunks(spark, sf_dir)
    climbing = F.regexp_extract("path", "doc-([0-9]+)", 1).cast("long") % 10 == 7
    rows = chunks.withColumn("path", F.when(climbing, F.concat(F.lit("../"), "path")).otherwise(F.col("path"))).withColumn("modified_at", F.timestamp_seconds("chunk_sequence"))
    return maintenance.index_state(rows).select("collection", "path", F.unix_seconds("modified_at").alias("last_chunk"), "source_hash")


@query(r"WITH p AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '../up' WHEN 1 THEN '/abs' WHEN 2 THEN 'a/../b' WHEN 3 THEN 'bad' || chr(7) WHEN 4 THEN 'a..b/c' ELSE 'fine/doc.md' END AS path FROM documents) SELECT doc_id, doc_id % 6 NOT IN (0, 1, 2) AS safe, doc_id % 6 = 3 AS control FROM p")
def valid_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    path = F.element_at(F.array(*map(F.lit, ("../up", "/abs", "a/../b", "bad\x07", "a..b/c", "fine/doc.md"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return rows.withColumn("path", path).select("doc_id", T.is_safe_path(F.col("path")).alias("safe"), T.has_control(F.col("path")).alias("control"))


@query("WITH n AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN source || '.x' WHEN 2 THEN '' ELSE repeat('a', CAST(doc_id % 100 AS INTEGER)) END AS name FROM documents) SELECT doc_id, name, regexp_full_match(name, '[A-Za-z0-9_-]{1,64}') AS valid FROM n")
def valid_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kind = F.col("doc_id") % 4
    name = F.when(kind == 0, F.col("source")).when(kind == 1, F.concat("source", F.lit(".x"))).when(kind == 2, "").otherwise(F.expr("repeat('a', int(doc_id % 100))"))
    return rows.select("doc_id", name.alias("name")).withColumn("valid", T.is_collection_name(F.col("name")))


@query("SELECT doc_id, regexp_replace(replace(replace(replace(replace('<a>' || text || chr(13) || chr(1), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(13), '&#xD;'), '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]', '�', 'g') AS escaped FROM documents".replace("\\\\", "\\"))
def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", T.xml_escape(F.concat(F.lit("<a>"), "text", F.lit("\r\x01"))).alias("escaped"))


@query(f"WITH {_SOURCES} SELECT collection, path FROM src WHERE doc_id % 3 <> 0")
def defensive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.sources(spark, sf_dir)
    broken = F.regexp_extract("path", "doc-([0-9]+)", 1).cast("long") % 3 == 0
    return ranking.without_nulls(rows.withColumn("content", F.when(~broken, F.col("content"))), ["path", "content"]).select("collection", "path")
