import io
import json
import os
import tarfile
import zipfile

import numpy as np
import pytest

from lorekeep import api, cli, render
from lorekeep.embed import ConstantEmbedder, HashEmbedder, classify, declared_dim
from lorekeep.errors import ChunkNotFound, ConfigError, EmptyQuery, IndexOutdated, InvalidChunkRange, InvalidLimit, LorekeepError, NotFound, PayloadTooLarge, SchemaMismatch, UnknownCollection, UnsupportedModel
from lorekeep.plans import config as configs
from lorekeep.plans import ingest
from lorekeep.plans.config import Collection, Config
from lorekeep.plans.search import SearchEngine, SearchRequest
from lorekeep.plans.store import Store


@pytest.fixture
def notes(tmp_path):
    root = tmp_path / "notes"
    root.mkdir()
    (root / "release.md").write_text("# Release\n\nThe rollout keyword lives here.\n\n## Steps\n\nTag and push.\n")
    (root / "other.md").write_text("# Other\n\nNothing to see.\n")
    (root / "empty.md").write_text("")
    return root


@pytest.fixture
def engine(spark, tmp_path, notes):
    store = Store(spark, f"file://{tmp_path}/index")
    config = Config(collections={"notes": Collection(str(notes))})
    embedder = HashEmbedder()
    summary = ingest.update_all(spark, store, config, embedder)
    return store, config, embedder, summary


def update(spark, engine):
    store, config, embedder, _ = engine
    s = ingest.update_all(spark, store, config, embedder)
    return s.new, s.updated, s.skipped, s.removed, s.failed


def test_ingest_is_incremental(spark, engine, notes):
    assert (engine[3].new, engine[3].failed) == (3, 0)
    assert update(spark, engine) == (0, 0, 3, 0, 0)
    (notes / "release.md").write_text("# Release\n\nOnly this.\n")
    os.utime(notes / "release.md", (2e9, 2e9))
    os.utime(notes / "other.md", (2e9, 2e9))
    (notes / "new.md").write_text("fresh")
    (notes / "empty.md").unlink()
    assert update(spark, engine) == (1, 1, 1, 1, 0)
    chunks = engine[0].table("chunks")
    assert {(r.path, r.chunk_sequence) for r in chunks.collect()} == {("release.md", 0), ("other.md", 0), ("new.md", 0)}
    assert update(spark, engine) == (0, 0, 3, 0, 0)


def test_failures_keep_old_rows(spark, engine, notes):
    (notes / "release.md").write_bytes(b"\xff\xfe bad")
    os.utime(notes / "release.md", (2e9, 2e9))
    assert update(spark, engine) == (0, 0, 2, 0, 1)
    assert "rollout" in api.get_document(engine[0], engine[1], "notes", "release.md")


def test_placeholders_have_no_vector(engine):
    rows = {(r.path, r.chunk_sequence): r for r in engine[0].table("chunks").collect()}
    assert rows["empty.md", 0].embedding is None and rows["empty.md", 0].body == ""
    assert len(rows["release.md", 0].embedding) == 256


def test_search_modes(spark, engine):
    store, config, embedder, _ = engine
    search = SearchEngine(spark, store, config)
    found = search.fts(SearchRequest("rollout keyword"))
    assert [h.path for h in found.hits] == ["release.md"] and found.hits[0].chunk_count == 2 and found.total == 1
    assert "rollout keyword" in found.hits[0].snippet
    chunk = search.fts(SearchRequest("tag push", level="chunk")).hits[0]
    assert (chunk.path, chunk.chunk_sequence, chunk.matched_chunks) == ("release.md", 1, None)
    vector = search.vector(SearchRequest("nothing to see.", limit=5), embedder)
    assert vector.hits[0].path == "other.md" and "empty.md" not in {h.path for h in vector.hits}
    hybrid = search.hybrid(SearchRequest("rollout keyword"), embedder)
    assert hybrid.hits[0].path == "release.md" and 0 < hybrid.hits[0].score <= 2 / 61 + 1e-6


def test_requests_are_checked_in_order(spark, engine):
    store, config, *_ = engine
    search = SearchEngine(spark, store, config)
    for request, error in ((SearchRequest(" ", limit=0), EmptyQuery), (SearchRequest("a", ("x",), 0), InvalidLimit), (SearchRequest("a", ("x",)), UnknownCollection)):
        with pytest.raises(error):
            search.fts(request)


def test_reads(engine):
    store, config, *_ = engine
    text = api.get_document(store, config, "notes", "release.md")
    assert api.get_chunks(store, config, "notes", "release.md", 0, 9) == text
    assert api.get_chunks(store, config, "notes", "release.md", 1) == "## Steps\n\nTag and push.\n"
    for call, error in (
        (lambda: api.get_document(store, config, "ghost", "a"), UnknownCollection), (lambda: api.get_document(store, config, "notes", "a"), NotFound),
        (lambda: api.get_chunks(store, config, "notes", "release.md", 7), ChunkNotFound), (lambda: api.parse_span(None, 3), InvalidChunkRange), (lambda: api.parse_span(5, 2), InvalidChunkRange),
        (lambda: api.check_size("éé", 3), PayloadTooLarge),
    ):
        with pytest.raises(error):
            call()
    assert api.check_size("éé", 0) == "éé" and api.parse_span(None, None) is None


def test_tools_return_errors_with_codes(spark, engine):
    store, config, embedder, _ = engine
    tools = api.Tools(spark, store, config, embedder)
    assert tools.search("")["error"]["code"] == "empty_query"
    assert tools.search("x", collections=["ghost"])["error"]["details"] == {"collection": "ghost"}
    assert tools.get_document("notes", "none.md")["error"]["code"] == "not_found"
    assert tools.get_document("notes", "release.md", 0)["content"].startswith("# Release")
    assert tools.list_collections()["collections"][0]["document_count"] == 3
    assert tools.search("rollout", "fts")["hits"][0]["path"] == "release.md"


def test_status_and_pins(spark, engine):
    store, config, *_ = engine
    report = api.status(store, config)
    assert (report.chunks, report.sources, report.vector_dim, report.collections) == (4, 3, 256, 1)
    with pytest.raises(SchemaMismatch):
        ingest.update_all(spark, store, config, ConstantEmbedder(dim=128))
    with pytest.warns(UserWarning):
        SearchEngine(spark, store, config, dim=128)
    manifest = store.manifest()
    manifest.ranges, manifest.version = False, manifest.version + 1
    store.commit(manifest)
    with pytest.raises(IndexOutdated):
        SearchEngine(spark, store, config).fts(SearchRequest("x"))
    assert api.get_document(store, config, "notes", "other.md")


def test_switching_models(spark, engine):
    store, config, *_ = engine
    model = "sentence-transformers/all-MiniLM-L6-v2"
    assert ingest.model_action(config.model, model, config.model, True) == "switch"
    assert ingest.model_action(model, model, config.model, True) == "rebuild"
    assert ingest.model_action(model, model, model, True) == "none"
    config.model = model
    assert ingest.switch_model(spark, store, config, HashEmbedder(model)).new == 3
    assert store.manifest().vector_dim == 384 and store.table("chunks").count() == 4


def test_collections_no_longer_configured_can_be_pruned(spark, engine):
    store, config, *_ = engine
    config.collections = {}
    assert ingest.update_all(spark, store, config, HashEmbedder()).removed == 0
    assert store.table("sources").count() == 3
    assert ingest.prune(store, config) == ["notes"] and store.table("sources").count() == 0


@pytest.mark.parametrize("kind", ["zip", "tar", "tar.gz"])
def test_archives_as_collections(spark, tmp_path, kind):
    file = tmp_path / f"docs.{kind}"
    entries = {"./a.md": b"# A\n\nalpha", "b/c.markdown": b"beta", "__MACOSX/a.md": b"x", "b/._c.md": b"x", "../up.md": b"bad", "skip.txt": b"no"}
    if kind == "zip":
        with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
            for n, d in entries.items():
                z.writestr(n, d)
    else:
        with tarfile.open(file, "w:gz" if kind == "tar.gz" else "w") as t:
            for n, d in entries.items():
                info = tarfile.TarInfo(n)
                info.size = len(d)
                t.addfile(info, io.BytesIO(d))
    store, config = Store(spark, f"file://{tmp_path}/index"), Config(collections={"arc": Collection(str(file))})
    s = ingest.update_all(spark, store, config, HashEmbedder())
    assert (s.new, s.failed, s.unreadable) == (2, 1, [])
    assert {r.path for r in store.table("sources").collect()} == {"a.md", "b/c.markdown"}
    assert ingest.update_all(spark, store, config, HashEmbedder()).skipped == 2
    file.write_bytes(file.read_bytes()[:-30] if kind != "tar" else file.read_bytes()[:-10240])
    s = ingest.update_all(spark, store, config, HashEmbedder())
    assert s.unreadable == ["arc"] and store.table("sources").count() == 2


def test_command_line(spark, tmp_path, notes, capsys):
    base = ["--config-dir", str(tmp_path / "conf")]
    assert cli.main([*base, "init"], spark) == 0 and cli.main([*base, "init"], spark) == 0
    assert cli.main([*base, "collection", "add", str(notes), "--description", "d"], spark) == 0
    assert cli.main([*base, "collection", "add", str(notes)], spark) == 1
    assert cli.main([*base, "update-all"], spark) == 0
    capsys.readouterr()
    assert cli.main([*base, "search", "fts", "rollout", "-c", "notes", "--format", "json"], spark) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["collections"] == ["notes"] and found["hits"][0]["path"] == "release.md"
    assert cli.main([*base, "get", "notes", "release.md", "--chunk", "1"], spark) == 0
    assert capsys.readouterr().out == "## Steps\n\nTag and push.\n"
    assert cli.main([*base, "status", "--format", "md"], spark) == 0
    assert "- chunks: 4" in capsys.readouterr().out
    assert cli.main([*base, "collection", "list"], spark) == 0
    assert "3 docs\td" in capsys.readouterr().out
    assert cli.main([*base, "search", "fts", " "], spark) == 1
    assert cli.main([*base, "vector", "use", "sentence-transformers/all-MiniLM-L6-v2"], spark) == 1
    assert cli.main([*base, "vector", "use", "nonsense", "-y"], spark) == 1
    assert cli.main(["version"]) == 0
    with pytest.raises(SystemExit) as e:
        cli.main(["nonsense"])
    assert e.value.code == 2


def response(level="doc", **more):
    from lorekeep.plans.search import Hit, SearchResponse

    hit = Hit("notes", "a&b.md", 0.1, "x <y>\x1b", 3, **(more or {"matched_chunks": 2}))
    return SearchResponse("q<", "fts", level, (), 20, 1, (hit,))


def test_renderers():
    r = response()
    assert render.render(r, "human") == "notes/a&b.md  score=0.100  chunks=3\n  > x <y>\\u{1b}\n---\n1 doc hits (showing 20 max)\n"
    assert render.render(r, "json") == '{"query":"q<","mode":"fts","level":"doc","collections":[],"limit":20,"total":1,"hits":[{"collection":"notes","path":"a&b.md","score":0.1,"snippet":"x <y>\\u001b","matched_chunks":2,"chunk_count":3}]}\n'
    assert "- collections: (all)\n- 1 doc hits (showing 20 max)\n\n## notes/a&b.md\n\n- matched_chunks: 2\n- score: 0.100\n" in render.render(r, "md")
    xml = render.render(response("chunk", chunk_sequence=4), "xml")
    assert "      <path>a&amp;b.md</path>\n      <chunk_sequence>4</chunk_sequence>\n      <score>0.1</score>\n      <snippet>x &lt;y&gt;\ufffd</snippet>\n" in xml
    assert "  <collections/>\n" in xml
    rows = [render.CollectionRow("n", "/p", None, 2)]
    assert render.render_collections(rows, "human") == "n\t/p\t2 docs\t(none)\n1 collections\n"
    assert "    <description/>\n" in render.render_collections(rows, "xml") and render.render_collections([], "xml").endswith("<collections/>\n")
    assert "vector_dim:      4\n" in render.render_status(render.StatusReport("1", "m", 4, 1, 2, 3), "human")


def test_configuration(tmp_path):
    config = Config(collections={"b": Collection("~/b", "x"), "a": Collection("/a")})
    configs.save(str(tmp_path), config)
    assert configs.load(str(tmp_path)) == config and "ollama" not in configs.dump(config)
    defaults = configs.parse("embedding: {model: cl-nagoya/ruri-v3-30m}")
    assert (defaults.memory_limit_mb, defaults.embed_parallelism, defaults.cli_max_bytes) == (8192, 8, 1 << 20)
    assert configs.parse("embedding: {model: 'ollama:x'}\nruntime: {embed_parallelism: 5000}").parallelism() == 1024
    for bad in ("embedding: {model: nope}", "embedding: {model: cl-nagoya/ruri-v3-30m}\ncollections: {'a b': {path: /}}", "- x", "collections: {}"):
        with pytest.raises(ConfigError):
            configs.parse(bad)


def test_models():
    assert classify("ollama:x") == "http" and declared_dim("ollama:x", 77) == 77 and declared_dim("google/embeddinggemma-300m", 1) == 768
    with pytest.raises(UnsupportedModel):
        classify("ollama:")


def test_streamed_documents(spark, tmp_path):
    from lorekeep.streaming.upkeep import SCHEMA, follow

    store, embedder = Store(spark, f"file://{tmp_path}/index"), HashEmbedder()
    store.create(embedder.model_id, embedder.dim)
    landing, checkpoint = f"{tmp_path}/landing", f"{tmp_path}/checkpoint"
    rows = lambda *r: spark.createDataFrame(list(r), "collection string, path string, t long, content string").selectExpr("collection", "path", "timestamp_seconds(t) AS mtime", "content")
    rows(("c", "a.md", 1, "# A\n\nold"), ("c", "a.md", 2, "# A\n\nnew"), ("c", "b.md", 1, "beta")).write.parquet(landing)
    follow(spark, store, landing, checkpoint, embedder).awaitTermination()
    assert {(r.path, r.body) for r in store.table("chunks").collect()} == {("a.md", "A\n\nnew"), ("b.md", "beta")}
    version = store.manifest().version
    rows(("c", "b.md", 1, "beta")).write.mode("append").parquet(landing)
    follow(spark, store, landing, checkpoint, embedder).awaitTermination()
    assert store.manifest().version == version and SCHEMA


def test_of_two_updates_of_one_version_the_second_fails(spark, engine):
    store, *_ = engine
    one, two = store.manifest(), store.manifest()
    one.version, two.version = one.version + 1, two.version + 1
    store.commit(one)
    with pytest.raises(LorekeepError, match="another update"):
        store.commit(two)
    assert store.manifest().version == one.version


def test_vacuum_keeps_what_kept_versions_name(spark, engine, notes):
    store, *_ = engine
    for k in range(3):
        (notes / "other.md").write_text(f"# Other\n\nEdition {k}.\n")
        update(spark, engine)
    assert len(store.versions()) == 2
    last, before = store.manifest(), store.manifest(store.versions()[0])
    named = {p for m in (last, before) for t in m.tables.values() for p in t.values()}
    held = {os.path.relpath(d, store.root.removeprefix("file://")) for d, _, files in os.walk(store.root.removeprefix("file://")) if any(f.endswith(".parquet") for f in files)}
    assert held == named and store.table("chunks", before).count() == store.table("chunks", last).count() == 4


def test_vectors_of_a_large_collection_are_searched_by_cells(spark, tmp_path, monkeypatch):
    from lorekeep.operators import ranking, vector_index
    from lorekeep.plans import store as stores

    monkeypatch.setattr(stores, "INDEXED_FROM", 500)
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(40, 32))
    vectors = middle[rng.integers(0, 40, 4000)] + 0.6 * rng.normal(size=(4000, 32))
    vectors[7] = 0
    rows = [("c", f"p{i // 4:04}", i % 4, f"body {i}", v.tolist() if i % 50 else None, 0, 0) for i, v in enumerate(vectors)]
    chunks = spark.createDataFrame(rows, "collection string, path string, chunk_sequence long, body string, embedding array<float>, source_start long, source_end long")
    chunks = chunks.selectExpr("*", "timestamp_seconds(1) AS modified_at", "'h' AS source_hash")
    store = Store(spark, f"file://{tmp_path}/index")
    after = store.write(store.create("m", 32), "c", chunks, None)
    after.version += 1
    store.commit(after)
    cells, index = store.cells(after, "c"), store.table("vectors", after)
    assert len(cells.centres) == vector_index.cell_count(3920) and index.count() == 3920
    held = store.table("chunks", after)
    engine, hit, asked = SearchEngine(spark, store, Config(model="m", collections={"c": Collection("/")}), "m", 32), 0, 25
    for k in range(asked):
        wanted = (vectors[100 + 13 * k] + 0.3 * rng.normal(size=32)).tolist()
        key = lambda r: (r["path"], r["chunk_sequence"], r["score"])
        best = {key(r) for r in ranking.top(ranking.vector_scored(held, wanted), 10).collect()}
        if k < 4:
            assert {key(r) for r in vector_index.search(index, cells, wanted, 10, exact=True).collect()} == best
        hit += len(best & {key(r) for r in vector_index.search(index, cells, wanted, 10).collect()})
    assert hit >= 0.9 * 10 * asked
    shown = [r["path"] for r in engine.vector_df(SearchRequest("q", limit=5, level="chunk"), wanted).collect()]
    assert set(shown) <= {p for p, *_ in best} and len(shown) == 5
