import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from lorekeep.embed import BATCH, ConstantEmbedder, HashEmbedder, HttpEmbedder, build_embedder, embedded
from lorekeep.errors import EmbeddingError
from lorekeep.functions import vectors as V


class Counting(ConstantEmbedder):
    def embed_passages(self, texts):
        assert 0 < len(texts) <= BATCH and all(texts)
        return super().embed_passages(texts)


def test_passages_are_embedded_in_batches_and_empty_ones_are_not(spark):
    rows = spark.createDataFrame([(i, "" if i % 5 == 0 else f"b{i}") for i in range(200)], "i long, body string").repartition(2)
    found = {r.i: r.embedding for r in embedded(rows, Counting(dim=3)).collect()}
    assert all((found[i] is None) == (i % 5 == 0) for i in found) and [round(x, 3) for x in found[1]] == [0.2, 0.2, 0.2]


def test_vectors_of_another_width_fail(spark):
    class Wrong(ConstantEmbedder):
        def embed_passages(self, texts):
            return [[0.0]] * len(texts)

    with pytest.raises(Exception, match="wrong number or width"):
        embedded(spark.createDataFrame([("a",)], "body string"), Wrong(dim=3)).collect()


@pytest.fixture
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            bad = asked["model"] == "bad"
            self.send_response(500 if bad else 200)
            self.end_headers()
            self.wfile.write(b"\x1b[31m" + b"e" * 2000 if bad else json.dumps({"embeddings": [[float(len(t)), 1.0] for t in asked["input"]]}).encode())

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}/"
    http.shutdown()


def test_http_models(server):
    embedder = build_embedder("ollama:m", server)
    assert isinstance(embedder, HttpEmbedder) and embedder.dim == 2
    assert embedder.embed_queries(["abc"]) == [[3.0, 1.0]] and embedder.embed_passages(["a", "ab"])[1] == [2.0, 1.0]
    with pytest.raises(EmbeddingError) as e:
        build_embedder("ollama:bad", server)
    assert "500" in str(e.value) and "\x1b" not in str(e.value) and len(str(e.value)) < 600
    with pytest.raises(EmbeddingError):
        build_embedder("ollama:m", "http://127.0.0.1:1")


def test_hashed_vectors_have_length_one():
    a, b = HashEmbedder(dim=32).embed_passages(["x y z", "x y z"])
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-9


def test_vector_columns(spark):
    row = spark.range(1).select(
        V.distance_to_score(V.cosine_distance(V.literal([1, 0]), V.literal([0, 0]))).alias("nan"), V.distance_to_score(V.cosine_distance(V.literal([1, 0]), V.literal([-1, 0]))).alias("far"),
        V.distance_to_score(V.cosine_distance(V.literal([1, 1]), V.literal([2, 2]))).alias("same"), V.mean_pool(F.array(V.literal([1, 2]), V.literal([3, 4]), V.literal([9, 9])), F.array(F.lit(1), F.lit(1), F.lit(0))).alias("mean"),
        V.mean_pool(F.array(V.literal([1, 2])), F.array(F.lit(0))).alias("none"), V.l2_normalize(V.literal([0, 0])).alias("zero"),
    ).first()
    assert (row.nan, row.far, round(row.same, 9), row["mean"], row.none, row.zero) == (0.0, 0.0, 1.0, [2.0, 3.0], [0.0, 0.0], [0.0, 0.0])


def test_presets_put_their_prefixes_before_texts():
    embedder = HashEmbedder("google/embeddinggemma-300m")
    plain = HashEmbedder("none", dim=768)
    assert embedder.embed_queries(["tide"]) == plain.embed_queries(["task: search result | query: tide"])
    assert embedder.embed_passages(["tide"]) == plain.embed_passages(["title: none | text: tide"])
