from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import unit
from cuelattice.operators import graph as g
from cuelattice.operators import read, vector
from cuelattice.schema import parse_tag_filters
from cuelattice.service import Service

CUE_OF, TAGGED, REDIRECT = "cue_of", "tagged_with", "redirects_to"


def ids(df, column):
    return [r[column] for r in df.orderBy("ord", "edge_seq").collect()]


@pytest.fixture(scope="module")
def graph(make_graph):
    return make_graph(
        [
            ("cue-1", "cue", {"text": "one", "embedding": unit(0), "embedding_model": "m"}),
            ("cue-2", "cue", {"text": "two", "embedding": unit(1), "embedding_model": "m", "status": "deleted"}),
            ("c-py", "content", {"signature": "def f()", "docstring": "d", "embedding": unit(0), "embedding_model": "m"}),
            ("c-js", "content", {"signature": "", "symbol_name": "g", "body": "x" * 600}),
            ("c-old", "content", {}),
            ("c-new", "content", {}),
            ("c-gone", "content", {"status": "deleted"}),
            ("tag-py", "tag", {"category": "language", "value": "python"}),
            ("tag-m", "tag", {"category": "module_path", "value": "a"}),
            ("cue-0", "cue", {"text": "zero", "embedding": [0.0] * 8, "embedding_model": "m"}),
        ],
        [
            ("cue-1", "c-py", CUE_OF), ("cue-1", "c-js", CUE_OF), ("cue-2", "c-py", CUE_OF), ("cue-1", "c-old", CUE_OF), ("c-old", "c-new", REDIRECT), ("cue-1", "c-gone", CUE_OF),
            ("c-py", "tag-py", TAGGED), ("c-py", "tag-m", TAGGED), ("c-js", "tag-m", TAGGED), ("cue-1", "c-py", "part_of_topic"), ("cue-1", "nowhere", CUE_OF),
        ],
    )


def test_neighbors_keep_edge_order_and_types(spark, graph):
    start = g.ordered_ids(spark, ["cue-1", "unknown"])
    every = g.neighbors(graph, start)
    assert ids(every, "n_id") == ["c-py", "c-js", "c-old", "c-gone", "c-py"]  # over two edge types, twice; no dangling end
    assert ids(g.neighbors(graph, start, "part_of_topic"), "n_id") == ["c-py"]
    assert ids(g.neighbors(graph, g.ordered_ids(spark, ["c-py"]), CUE_OF, "incoming"), "n_id") == ["cue-1", "cue-2"]
    with pytest.raises(ValueError):
        g.neighbors(graph, start, direction="sideways")


def test_traverse_forward(spark, graph):
    start = g.ordered_ids(spark, ["cue-2", "cue-1"])
    assert ids(read.traverse_forward(graph, start), "content_id") == ["c-py", "c-js", "c-new"]
    assert ids(read.traverse_forward(graph, start, [("module_path", "a")]), "content_id") == ["c-py", "c-js"]
    assert ids(read.traverse_forward(graph, start, [("module_path", "a"), ("language", "python")]), "content_id") == ["c-py"]
    assert ids(read.traverse_forward(graph, start, [("language", "js")]), "content_id") == []


def test_traverse_reverse_ignores_status(spark, graph):
    assert ids(read.traverse_reverse(graph, g.ordered_ids(spark, ["c-py", "c-js"])), "cue_id") == ["cue-1", "cue-2"]


def test_fetch_keeps_order_and_repeats(spark, graph):
    rows = read.fetch(graph, g.ordered_ids(spark, ["c-js", "cue-1", "c-gone", "c-py", "c-js", "?"])).orderBy("ord").collect()
    assert [r.id for r in rows] == ["c-js", "c-py", "c-js"]


def test_summaries(graph):
    rows = {r.id: r for r in read.content_summaries(graph).collect()}
    assert (rows["c-py"].label, rows["c-py"].snippet, rows["c-py"].tags) == ("def f()", "d", ["language=python", "module_path=a"])
    assert rows["c-js"].label == "g" and rows["c-js"].snippet == "x" * 500 + "…"
    assert rows["c-old"].label == "function" and rows["c-old"].tags == []
    assert "embedding" not in read.content_details(graph.nodes).columns


def test_knn(graph):
    found = [(r.node_id, r.score) for r in vector.knn(graph.nodes, unit(0), 5).collect()]
    assert found == [("c-py", 1.0), ("cue-1", 1.0), ("cue-0", 0.0)]  # ties by id, the tombstone is not among them
    assert [r.node_id for r in vector.knn(graph.nodes, unit(0), 1, "cue").collect()] == ["cue-1"]
    assert vector.knn(graph.nodes, unit(0), 0).count() == vector.knn(graph.nodes, [], 3).count() == 0


def test_knn_batch_agrees_with_single(spark, graph, monkeypatch):
    queries = spark.createDataFrame([("a", unit(0)), ("b", [1.0] * 8), ("z", [0.0] * 8)], "qid string, embedding array<double>")
    monkeypatch.setattr(vector, "BLOCK", 2)
    got = {}
    for r in vector.knn_batch(graph.nodes, queries, 2).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.node_id, r.score))
    for qid, q in (("a", unit(0)), ("b", [1.0] * 8), ("z", [0.0] * 8)):
        assert got[qid] == [(r.node_id, r.score) for r in vector.knn(graph.nodes, q, 2).collect()]
    assert vector.knn_batch(graph.nodes, queries.limit(0), 2).count() == 0


def test_knn_plan_is_a_top_k(graph):
    plan = vector.knn(graph.nodes, unit(0), 5)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_service(spark, graph):
    service = Service(graph, embed=lambda texts: [unit(0) for _ in texts])
    assert [r.id for r in service.search("q").collect()] == ["cue-1", "cue-0"]
    assert [r.id for r in service.traverse_forward(["cue-1"], [("language", "python")]).collect()] == ["c-py"]
    assert service.content_tags("c-py") == ["language=python", "module_path=a"] and service.content_tags("?") == []
    with pytest.raises(ValueError, match="valid: module_path"):
        service.traverse_forward(["cue-1"], [("colour", "red")])
    with pytest.raises(RuntimeError, match="check the embedding endpoint"):
        Service(graph, embed=lambda texts: 1 / 0).search("q")
    with pytest.raises(RuntimeError):
        service.references("c-py")
    with pytest.raises(RuntimeError):
        service.reconstruct("q")
    assert set(service.tools()) >= {"search", "fetch", "references"}
    assert parse_tag_filters(None) == []


def test_counts_and_metadata(graph):
    assert g.counts(graph).head().node_count == 10
    assert g.index_metadata(graph).head().size == 4
    assert g.nodes_for_file(graph, "a.py").where(F.col("id") == "cue-1").count() == 1
