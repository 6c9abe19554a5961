from __future__ import annotations

import random

import pytest

from cuelattice.operators import walk
from cuelattice.operators.graph import Graph
from cuelattice.plans import lineage


def seeds(spark, **by_query):
    return spark.createDataFrame(list(by_query.items()), "qid string, seeds array<string>")


def script(spark, rows):
    schema = "qid string, hop int, collect array<struct<id:string,relevance:double>>, descend_into string, stop boolean, error boolean"
    return walk.scripted_planner(spark.createDataFrame(rows, schema))


def found(df):
    return [(r.content_id, r.relevance) for r in df.orderBy("qid", "place").collect()]


@pytest.fixture(scope="module")
def two_hop(make_graph):
    return make_graph(
        [("cue-auth", "cue", {"text": "auth"}), ("login", "content", {}), ("cue-session", "cue", {"text": "session"}), ("token", "content", {})],
        [("cue-auth", "login", "cue_of"), ("cue-session", "login", "cue_of"), ("cue-session", "token", "cue_of")],
    )


def test_two_hops_and_upgrade(spark, two_hop):
    plan = script(spark, [
        ("q", 0, [("login", 0.4), ("made-up", 0.9)], "login", False, False),
        ("q", 1, [("cue-session", 0.7)], "cue-session", False, False),
        ("q", 2, [("token", 0.7)], None, False, False),
    ])
    start = seeds(spark, q=["cue-auth"], none=[])
    assert found(walk.reconstruct(two_hop, start, plan, 3)) == [("login", 0.7), ("token", 0.7)]
    assert found(walk.reconstruct(two_hop, start, plan, 1)) == [("login", 0.4)]


def test_small_files_are_not_broadcast(spark, two_hop, monkeypatch):
    """Joins of a walk are planned by measured sizes: files of ids are far smaller than the ids."""
    graph = Graph(lineage.saved(two_hop.nodes, "node_type"), lineage.saved(two_hop.edges, "edge_type"))
    plans, cut, limit = [], walk.cut, "spark.sql.autoBroadcastJoinThreshold"

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(walk, "cut", seen)
    before = spark.conf.get(limit)
    assert sorted(found(walk.reconstruct(graph, seeds(spark, q=["cue-session"]), walk.rule_planner(), 2))) == [("login", 1.0), ("token", 0.5)]
    assert len(plans) > 4 and any("Join" in p for p in plans)
    assert not [p for p in plans if "BroadcastExchange" in p]
    assert spark.conf.get(limit) == before and spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None


def test_error_keeps_what_was_found(spark, two_hop):
    plan = script(spark, [("q", 0, [("login", 0.5)], "login", False, False), ("q", 1, [("cue-auth", 0.9)], None, False, True)])
    assert found(walk.reconstruct(two_hop, seeds(spark, q=["cue-auth"]), plan, 3)) == [("login", 0.5)]


def test_backtrack_and_next_seed(spark, two_hop):
    plan = script(spark, [("q", 0, [], "login", False, False), ("q", 1, [], "?", False, False), ("q", 2, [("login", 0.2)], None, False, False), ("q", 3, [("token", 0.1)], None, True, False)])
    assert found(walk.reconstruct(two_hop, seeds(spark, q=["cue-auth", "cue-session"]), plan, 4)) == [("login", 0.2), ("token", 0.1)]


def test_callable_planner(spark, two_hop):
    def decide(request):
        if request["hop"] == 1:
            raise ValueError
        return {"collect": [{"id": c["id"], "relevance": 0.5} for c in request["candidates"]], "descend_into": request["candidates"][0]["id"]}

    assert found(walk.reconstruct(two_hop, seeds(spark, q=["cue-session"]), walk.callable_planner(decide), 3)) == [("login", 0.5), ("token", 0.5)]
    with pytest.raises(ValueError):
        walk.checked_decision({"collect": [{"id": "x", "relevance": 1.5}]})
    with pytest.raises(ValueError):
        walk.checked_decision({"other": 1})
    with pytest.raises(RuntimeError):
        walk.reconstruct(two_hop, seeds(spark, q=["cue-auth"]), None)


def plain_walk(nodes, edges, seeds, budget):
    """The walk of one query under the rule planner, step by step."""
    kind = {n: k for n, k, _ in nodes}
    out = lambda n, t: [b for a, b, k in edges if a == n and k == t]
    into = lambda n: [a for a, b, k in edges if b == n and k == "cue_of"]

    def contents(n, t):
        return list(dict.fromkeys(b for b in out(n, t) if kind[b] == "content"))

    queue, stack, result = list(seeds), [], {}
    current = queue.pop(0)
    visited = {current}
    for _ in range(budget):
        cands = contents(current, "cue_of") if kind[current] == "cue" else [c for c in into(current) if kind[c] == "cue"] + contents(current, "part_of_topic")
        for i, c in enumerate([c for c in cands if kind[c] == "content"]):
            result[c] = max(result.get(c, 0), 1 / (1 + i))
        if not cands:
            break
        if cands[0] not in visited:
            stack.append(current)
            current = cands[0]
            visited.add(current)
        elif stack:
            current = stack.pop()
        elif queue:
            current = queue.pop(0)
            visited.add(current)
        else:
            break
    return sorted(result.items(), key=lambda x: -x[1])


def test_rule_planner_against_a_plain_walk(spark, make_graph):
    rng = random.Random(5)
    nodes = [(f"cue{i}", "cue", {"text": "t"}) for i in range(6)] + [(f"c{i}", "content", {}) for i in range(6)] + [(f"t{i}", "content", {"memory_layer": "topic"}) for i in range(2)]
    pairs = {(f"cue{rng.randrange(6)}", f"c{rng.randrange(6)}", "cue_of") for _ in range(14)} | {(f"c{i}", f"t{i % 2}", "part_of_topic") for i in range(6)}
    edges = sorted(pairs)
    rng.shuffle(edges)
    graph = make_graph(nodes, edges)
    queries = {f"q{i}": [f"cue{i}", f"cue{(i + 2) % 6}"] for i in range(6)}
    got = {}
    for r in walk.reconstruct(graph, seeds(spark, **queries), walk.rule_planner(), 4).orderBy("qid", "place").collect():
        got.setdefault(r.qid, []).append((r.content_id, r.relevance))
    for q, start in queries.items():
        assert got.get(q, []) == plain_walk(nodes, edges, start, 4), q
