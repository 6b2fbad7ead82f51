"""The pipeline's stages, each against a plain version over its own input."""

import re
from collections import Counter

from pyspark.sql import Row

import corpus_pipeline
from tests.llm.test_operators import base, hits, shingles

SF = "/root/testdata/sf0.001"


def normal(line):
    return re.sub(r"[\s!-/:-@\[-`{-~\d]+", " ", line.lower()).strip()


def common_lines(rows):
    """(host, line) of the lines that 25 different texts of a host hold."""
    held: dict = {}
    for r in rows:
        for line in (r.text or "").split("\n"):
            if normal(line):
                held.setdefault((r.source, normal(line)), set()).add(r.text)
    return {k for k, texts in held.items() if len(texts) >= 25}


def cleaned(r, common):
    """The row without its host's lines; None where it is rejected."""
    lines = (r.text or "").split("\n")
    lost = [line for line in lines if (r.source, normal(line)) in common]
    words = base(r.text)[0]
    left = words - sum(base(line)[0] for line in lost)
    if base(r.text)[5] or left < 50 or left < 0.2 * words:
        return None
    if not lost:
        return r
    text = "\n".join(line for line in lines if (r.source, normal(line)) not in common)
    return Row(**{**r.asDict(), "text": text, "n_chars": len(text)})


def test_each_stage_does_what_a_plain_version_does(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, [docs.collect()]
    # Rows the tables lack: no text, no id, a repeated row.
    more = spark.createDataFrame([(90_000, None, "en", "src0", 0), (None, " ".join(f"n{i}" for i in range(80)), "en", None, 0), (90_001, " ".join(f"r{i}" for i in range(80)), "en", "src1", 0)], docs.schema)
    docs = docs.unionByName(more).unionByName(more.where("doc_id = 90001"))
    docs.write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    tables = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert k == 4 or out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        tables.append(docs.collect())
    first, good, unique, clean, mixed, sharded = tables
    common = common_lines(first)
    assert Counter(good) == Counter(r for r in (cleaned(r, common) for r in first) if r)
    left: list = []
    nodes = [shingles(r.text, 5) for r in good]
    group = list(range(len(good)))
    for i in range(len(good)):
        for j in range(i):
            both = len(nodes[i] & nodes[j])
            if both and 100 * both >= 80 * (len(nodes[i]) + len(nodes[j]) - both):
                group = [group[j] if g == group[i] else g for g in group]
    for g in set(group):
        left.append(sum(1 for k in group if k == g))
    assert len(unique) == len(left) and set(unique) <= set(good)
    index = {r: group[k] for k, r in enumerate(good)}
    assert len({index[r] for r in unique}) == len(unique)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert Counter(clean) == Counter(r for r in unique if not hits(r.text, items)[1])
    copies = Counter(mixed)
    assert set(copies) <= set(clean) and max(copies.values()) <= 3 * max(Counter(clean).values())
    assert Counter(tuple(r[c] for c in columns) for r in sharded) == Counter(map(tuple, mixed))
    sizes = Counter(r.shard for r in sharded)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted(r.slot for r in sharded if r.shard == 0) == list(range(sizes[0]))


def test_columns_that_clash_stay_themselves(spark, tmp_path):
    """Columns named like those that operators make or use inside, a very long text, and rows without ids or texts pass all stages."""
    long = " ".join(f"x{i}" for i in range(200_000))
    rows = [(i, " ".join(f"n{i}_{k}" for k in range(60 + i)), "en", f"src{i % 3}", i, f"key{i}", 7, True, f"w{i}", "a", 0.5) for i in range(40)]
    rows += [(100, long, None, None, 1, "k", 1, False, "w", None, 1.0), (None, None, "en", "src0", None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, _key string, size int, kept boolean, _window string, items string, rate double")
    docs = docs.unionByName(docs.where("doc_id = 100"))
    held = {r.doc_id: r for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        names = [c for c in docs.columns if k < 4 or c != "size"]
        assert out.columns[: len(names)] == names
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        for r in docs.collect():
            assert all(r[c] == held[r.doc_id][c] for c in names)
    assert {r.doc_id for r in docs.select("doc_id").collect()} <= {*range(40), 100}


def test_results_outlive_other_runs(spark, tmp_path):
    """A result that is read late keeps its scratch tables while the pipeline removes its own; a scope removes those made in it."""
    import os

    from lorekeep.llm import near_dup, shared

    late = near_dup.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet"), width=4)
    n = corpus_pipeline.run(spark, SF).count()
    assert n > 0 and late.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    with shared.scratch(spark):
        path = shared.materialize(spark.range(3), "gone").schema[0].metadata["scratch"].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_the_pipeline_runs_as_a_query(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_an_empty_table_passes_all_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() == 0
