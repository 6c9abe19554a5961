"""The packed graph against the plain one; the walk's own tests run again over it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import test_walk
from cuelattice.operators import graph as g
from cuelattice.operators import packed, read, walk
from test_walk import *  # noqa: F403 - the walk's tests and fixtures

plain_walk = walk.reconstruct


@pytest.fixture(autouse=True)
def over_packed(monkeypatch):
    def run(graph, seeds, planner, *more, **named):
        return walk.reconstruct_packed(packed.pack(graph) if planner is not None else None, seeds, planner, *more, **named)

    monkeypatch.setattr(test_walk.walk, "reconstruct", run)


@pytest.fixture(scope="module")
def mixed(make_graph):
    """A hub, redirects, tombstones, tags, cues without contents, edges of every type."""
    nodes = [(f"cue{i}", "cue", {"text": f"t{i}", "status": "deleted" if i == 5 else "active"}) for i in range(40)]
    nodes += [(f"c{i}", "content", {"status": "deleted" if i % 4 == 3 else "active", "symbol_name": f"s{i}"}) for i in range(12)]
    nodes += [("tag-py", "tag", {"category": "language", "value": "python"}), ("tag-m", "tag", {"category": "module_path", "value": "m"})]
    edges = [(f"cue{i}", "c0", "cue_of") for i in range(30)] + [(f"cue{i}", f"c{i % 12}", "cue_of") for i in range(1, 35)]
    edges += [("c1", "c2", "redirects_to"), ("c3", "c4", "redirects_to"), ("c3", "c5", "redirects_to")] + [(f"c{i}", "c0", "part_of_topic") for i in range(1, 12)] + [("c0", "c1", "part_of_topic")]
    edges += [(f"c{i}", "tag-py", "tagged_with") for i in range(0, 12, 2)] + [(f"c{i}", "tag-m", "tagged_with") for i in range(0, 12, 3)]
    return make_graph(nodes, list(dict.fromkeys(edges)))


@pytest.mark.parametrize("most", [4096, 3])
@pytest.mark.parametrize("edge_type, direction", [(None, "outgoing"), ("cue_of", "incoming"), (None, "incoming")])
def test_neighbors(spark, mixed, most, edge_type, direction):
    """A hub is cut into rows of a few entries and still has every neighbour."""
    adjacency = packed.adjacency(mixed, most)
    ids = mixed.nodes.select("id").withColumn("mark", F.lit(1)).unionByName(spark.sql("SELECT 'none' AS id, 1 AS mark"))
    got = packed.neighbors(packed.Packed(adjacency, None, None), ids, edge_type, direction)
    want = g.neighbor_ids(mixed.edges, ids, edge_type, direction)
    names = ["id", "mark", "neighbor_id", "edge_type", "edge_seq"]
    assert sorted(got.select(*names).collect()) == sorted(want.select(*names).collect())
    if most == 3:
        assert adjacency.where("id = 'c0'").count() > 5


@pytest.mark.parametrize("tags", [[], [("language", "python")], [("language", "python"), ("module_path", "m")]])
def test_traverse(spark, mixed, tags):
    found = packed.pack(mixed, 3)
    cues = mixed.nodes.where("node_type = 'cue'").select((-F.col("node_seq")).alias("ord"), "id")
    assert sorted(packed.traverse_forward(found, cues, tags).collect()) == sorted(read.traverse_forward(mixed, cues, tags).collect())


@pytest.mark.parametrize("tags", [[], [("language", "python")]])
def test_walks(spark, mixed, tags):
    """Every candidate list, and whole walks of several hops, over hubs cut in pieces."""
    found = packed.pack(mixed, 3)
    everything = mixed.nodes.where("node_type <> 'tag'").select(F.col("id").alias("qid"), "id")
    got = walk._lists(found, everything, tags).select("qid", F.explode("candidates").alias("c")).select("qid", F.col("c.id").alias("candidate_id"), "c.ord")
    assert sorted(got.collect()) == sorted(walk.candidates(mixed, everything, tags).collect())
    seeds = mixed.nodes.where("node_type = 'cue'").select(F.col("id").alias("qid"), F.array("id", F.lit("cue3")).alias("seeds"))
    for budget in (1, 5):
        assert sorted(walk.reconstruct_packed(found, seeds, walk.rule_planner(), budget, tags).collect()) == sorted(plain_walk(mixed, seeds, walk.rule_planner(), budget, tags).collect())


def test_a_hop_moves_no_edges(spark, mixed):
    """The scan of the adjacency feeds its join without an exchange."""
    found = packed.pack(mixed)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hop = packed.neighbors(found, mixed.nodes.select("id"))
        plan = hop._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
        scan = plan[plan.index("outgoing", plan.index("SortMergeJoin")) :]
        assert "Bucketed: true" in plan and "Exchange" not in scan[scan.rindex("Filter") :]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_one_table_a_hop(spark, mixed, monkeypatch):
    found, written = packed.pack(mixed), []
    real = walk.cut
    monkeypatch.setattr(walk, "cut", lambda df: written.append(1) or real(df))
    seeds = spark.createDataFrame([("q", ["cue1", "cue2"])], "qid string, seeds array<string>")
    walk.reconstruct_packed(found, seeds, walk.rule_planner(), 4)
    assert len(written) == 5  # the start, and one for each hop


def test_packed_tables_are_written_once(mixed, monkeypatch):
    """No copy of a table is written before the table itself."""
    from cuelattice.plans import lineage

    monkeypatch.setattr(lineage, "cut", lambda df: pytest.fail("an intermediate table"))
    assert packed.pack(mixed).adjacency.count()
