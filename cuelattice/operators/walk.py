"""The reconstruction walk: a budgeted depth-first search for many queries at once.

The state of every query is one row; each hop joins the current nodes to their
candidates, asks the planner once for all queries, and moves the states by
array expressions.  A walk has at most ``budget`` hops.

A planner takes requests (qid, query, hop, hops_left, current, candidates) and
gives decisions (qid, collect array<struct<id, relevance>>, descend_into, stop,
error), one row a query; a failed call is a row with ``error``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import content_label, content_snippet
from ..plans.lineage import cut, measured_joins
from ..schema import parse_tag_filters
from .graph import Graph, content_tags, first_by, neighbors
from .packed import Packed, has_tags
from .read import cue_summaries, expand_contents

DECISION = "qid string, collect array<struct<id:string,relevance:double>>, descend_into string, stop boolean, error boolean"
Planner = Callable[[DataFrame], DataFrame]


def candidates(graph: Graph, current: DataFrame, tags: list[tuple[str, str]] | None = None) -> DataFrame:
    """Candidates of current nodes (qid, id): (qid, candidate_id, ord).

    A cue's are its contents; a content's are its active cues, then the
    contents of its topics.  Contents are redirected, active, have all tags and
    come once.
    """
    kinds = graph.nodes.select("id", "node_type")
    at = current.select("qid", "id").join(kinds, "id")
    start = at.select(F.lit(0).alias("ord"), "id", "qid", "node_type")
    forward = expand_contents(graph, start.where("node_type = 'cue'"), "cue_of", tags).select(
        "qid",
        "content_id",
        F.lit(0).alias("branch"),
        "edge_seq",
    )
    peers = expand_contents(
        graph,
        start.where("node_type = 'content'"),
        "part_of_topic",
        tags,
    ).select("qid", "content_id", F.lit(1).alias("branch"), "edge_seq")
    cues = neighbors(graph, start.where("node_type = 'content'"), "cue_of", "incoming").where("n_node_type = 'cue' AND n_status = 'active'")
    cues = cues.select("qid", F.col("n_id").alias("content_id"), F.lit(0).alias("branch"), "edge_seq")
    rows = first_by(forward.unionByName(peers), ["qid", "content_id"], ["branch", "edge_seq"]).unionByName(cues)
    return rows.select("qid", F.col("content_id").alias("candidate_id"), F.struct("branch", "edge_seq").alias("ord"))


def _told(graph: Graph) -> DataFrame:
    """candidate_id, node_kind, label and snippet of all cues and contents, without their bodies: made once a walk, since hops move it."""
    cues = cue_summaries(graph.nodes).select("id", "node_kind", "label", "snippet")
    contents = graph.nodes.where("node_type = 'content'").select("id", F.lit("content").alias("node_kind"), content_label().alias("label"), content_snippet().alias("snippet"))
    return cut(cues.unionByName(contents).withColumnRenamed("id", "candidate_id"))


def _requests(graph: Graph, told: DataFrame, active: DataFrame, found: DataFrame, queries: DataFrame) -> DataFrame:
    # Tags of the candidates alone; a cue has none.
    ids = found.select(F.col("candidate_id").alias("source_id")).distinct()
    tagged = graph.edges.where("edge_type = 'tagged_with'").join(ids, "source_id", "left_semi")
    rows = found.join(told, "candidate_id").join(content_tags(Graph(graph.nodes, tagged)).withColumnRenamed("id", "candidate_id"), "candidate_id", "left")
    rows = rows.withColumn("tags", F.coalesce(F.when(F.col("node_kind") == "content", F.col("tags")), F.array().cast("array<string>")))
    item = F.struct("ord", F.col("candidate_id").alias("id"), "node_kind", "label", "snippet", "tags")
    lists = rows.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("candidates"))
    out = active.join(lists, "qid", "left").join(queries, "qid", "left")
    return out.select(
        "qid",
        "query",
        "hop",
        F.col("left").alias("hops_left"),
        F.col("id").alias("current"),
        F.coalesce("candidates", F.array().cast(lists.schema["candidates"].dataType)).alias("candidates"),
    )


def _as_contents(graph: Graph, collected: DataFrame) -> DataFrame:
    """Collected ids as contents: a cue stands for its first active content, redirects followed, tags not asked for."""
    kinds = graph.nodes.select(F.col("id").alias("picked"), F.col("node_type").alias("kind"))
    rows = collected.join(kinds, "picked")
    direct = rows.where("kind = 'content'").withColumn("content_id", F.col("picked"))
    cues = rows.where("kind = 'cue'").select("picked").distinct().select(F.lit(0).alias("ord"), F.col("picked").alias("id"))
    firsts = first_by(expand_contents(graph, cues, "cue_of"), ["id"], ["edge_seq"]).select(F.col("id").alias("picked"), "content_id")
    via = rows.where("kind = 'cue'").join(firsts, "picked")
    columns = ["qid", "content_id", "relevance", "discovery"]
    return direct.select(*columns).unionByName(via.select(*columns))


def _moved(rows: DataFrame, ends: Column, down: Column) -> DataFrame:
    """States after a hop: down to the decision's candidate, else back along the stack, else to the next seed, else done."""
    back, next_seed = F.size("stack") > 0, F.size("queue") > 0
    seed = F.get("queue", F.lit(0))
    return rows.select(
        "qid",
        F.when(ends, F.col("id")).when(down, F.col("descend_into")).when(back, F.element_at("stack", -1)).when(next_seed, seed).otherwise(F.col("id")).alias("id"),
        F.when(ends, F.col("stack")).when(down, F.concat("stack", F.array("id"))).when(
            back,
            F.slice("stack", F.lit(1), F.size("stack") - 1),
        ).otherwise(F.col("stack")).alias("stack"),
        F.when(ends | down | back | ~next_seed, F.col("queue")).otherwise(F.slice("queue", F.lit(2), F.size("queue"))).alias("queue"),
        F.when(ends, F.col("visited")).when(
            down,
            F.concat("visited", F.array("descend_into")),
        ).when(back | ~next_seed, F.col("visited")).otherwise(F.concat("visited", F.array(seed))).alias("visited"),
        (ends | ~(down | back | next_seed)).alias("done"),
    )


def _started(seeds: DataFrame) -> DataFrame:
    return seeds.where(F.size("seeds") > 0).select(
        "qid", F.col("seeds")[0].alias("id"), F.array().cast("array<string>").alias("stack"), F.slice("seeds", 2, F.greatest(F.size("seeds"), F.lit(1))).alias("queue"), F.array(F.col("seeds")[0]).alias("visited"), F.lit(False).alias("done"),
    )


def _ranked(found: DataFrame) -> DataFrame:
    """Contents by their best relevance, ties by first discovery."""
    best = found.groupBy("qid", "content_id").agg(F.max("relevance").alias("relevance"), F.min("discovery").alias("discovery"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("relevance"), "discovery"))
    return best.select("qid", "content_id", "relevance", place.alias("place"))


def reconstruct(
    graph: Graph,
    seeds: DataFrame,
    planner: Planner | None,
    budget: int = 3,
    tag_filters: list[tuple[str, str]] | None = None,
    queries: DataFrame | None = None,
) -> DataFrame:
    """(qid, content_id, relevance, place) found from seeds (qid, seeds array of cue ids by rank).

    Ranked by the best relevance a content was collected with, ties by first
    discovery; queries without seeds give nothing.
    """
    if planner is None:
        raise RuntimeError("reconstruct needs a planner and none is set")
    with measured_joins(seeds.sparkSession):  # every hop is written inside
        return _reconstructed(graph, seeds, planner, budget, parse_tag_filters(tag_filters), queries)


def _reconstructed(graph: Graph, seeds: DataFrame, planner: Planner, budget: int, tags: list[tuple[str, str]], queries: DataFrame | None) -> DataFrame:
    state, told = cut(_started(seeds)), _told(graph)
    if queries is None:
        queries = state.select("qid", F.lit(None).cast("string").alias("query"))
    found_all: DataFrame | None = None
    for hop in range(budget):
        active = state.where("NOT done").withColumns({"hop": F.lit(hop), "left": F.lit(budget - hop)})
        found = cut(candidates(graph, active, tags))
        decisions = cut(planner(_requests(graph, told, active, found, queries)))
        ok = decisions.where("NOT coalesce(error, false)")
        picks = ok.select("qid", F.posexplode("collect").alias("k", "pick")).select(
            "qid",
            F.col("pick.id").alias("picked"),
            F.col("pick.relevance").alias("relevance"),
            F.struct(F.lit(hop).alias("hop"), "k").alias("discovery"),
        )
        picks = picks.join(found.select("qid", F.col("candidate_id").alias("picked")), ["qid", "picked"], "left_semi")
        collected = cut(_as_contents(graph, picks))
        found_all = collected if found_all is None else found_all.unionByName(collected)
        known = found.select("qid", F.col("candidate_id").alias("descend_into"), F.lit(True).alias("known"))
        moves = decisions.join(known, ["qid", "descend_into"], "left").select("qid", "descend_into", "stop", "error", "known")
        rows = state.where("NOT done").join(moves, "qid", "left")
        ends = F.coalesce("error", F.lit(True)) | F.coalesce("stop", F.lit(False))  # no decision at all ends a walk too
        down = F.coalesce("known", F.lit(False)) & ~F.array_contains("visited", F.coalesce("descend_into", F.lit("")))
        moved = _moved(rows, ends, down)
        state = cut(moved.unionByName(state.where("done")))
        if state.where("NOT done").isEmpty():
            break
    if found_all is None:
        return seeds.select("qid", F.lit("").alias("content_id"), F.lit(0.0).alias("relevance"), F.lit(0).alias("place")).limit(0)
    return _ranked(found_all)


def _lists(packed: Packed, active: DataFrame, tags: list[tuple[str, str]]) -> DataFrame:
    """(qid, candidates): the candidates of each walk's current node, in order; contents have all tags."""
    rows = active.select("qid", "id").join(packed.candidates.select("id", "candidates"), "id")
    lists = rows.groupBy("qid").agg(F.array_sort(F.flatten(F.collect_list("candidates"))).alias("candidates"))
    return lists.withColumn("candidates", F.filter("candidates", lambda c: (c["node_kind"] == "cue") | has_tags(tags, c["tags"]))) if tags else lists


def reconstruct_packed(
    packed: Packed,
    seeds: DataFrame,
    planner: Planner | None,
    budget: int = 3,
    tag_filters: list[tuple[str, str]] | None = None,
    queries: DataFrame | None = None,
) -> DataFrame:
    """:func:`reconstruct` over a packed graph: a hop is one join with the candidate table, and writes one table.

    The table of a hop has for each walk its state, its decision, and the ids of its candidates with the contents
    that they stand for; the next states and what was collected are read from it.
    """
    if planner is None:
        raise RuntimeError("reconstruct needs a planner and none is set")
    tags = parse_tag_filters(tag_filters)
    state, found_all = cut(_started(seeds)), None
    if queries is None:
        queries = state.select("qid", F.lit(None).cast("string").alias("query"))
    for hop in range(budget):
        at = state.join(_lists(packed, state, tags), "qid", "left")
        none = F.array().cast(packed.candidates.schema["candidates"].dataType)
        told = F.transform(F.coalesce("candidates", none), lambda c: c.dropFields("content"))
        requests = at.join(queries, "qid", "left").select("qid", "query", F.lit(hop).alias("hop"), F.lit(budget - hop).alias("hops_left"), F.col("id").alias("current"), told.alias("candidates"))
        standing = F.transform(F.coalesce("candidates", none), lambda c: F.struct(c["id"].alias("id"), c["content"].alias("content"))).alias("standing")
        step = cut(at.select("qid", "id", "stack", "queue", "visited", standing).join(planner(requests).select("qid", "collect", "descend_into", "stop", "error"), "qid", "left"))
        picks = step.where("NOT coalesce(error, false)").select("qid", F.posexplode("collect").alias("k", "pick"))
        known = step.select("qid", F.explode("standing").alias("c")).select("qid", F.col("c.id").alias("picked"), F.col("c.content").alias("content_id")).where("content_id IS NOT NULL")
        picks = picks.select("qid", F.col("pick.id").alias("picked"), F.col("pick.relevance").alias("relevance"), F.struct(F.lit(hop).alias("hop"), "k").alias("discovery"))
        collected = picks.join(known, ["qid", "picked"]).select("qid", "content_id", "relevance", "discovery")
        found_all = collected if found_all is None else found_all.unionByName(collected)
        ends = F.coalesce("error", F.col("descend_into").isNull() & F.col("collect").isNull() & F.col("stop").isNull()) | F.coalesce("stop", F.lit(False))
        down = F.exists("standing", lambda c: c["id"] == F.col("descend_into")) & ~F.array_contains("visited", F.coalesce("descend_into", F.lit("")))
        state = _moved(step, ends, F.coalesce(down, F.lit(False))).where("NOT done")
        if hop + 1 < budget and state.isEmpty():
            break
    if found_all is None:
        return seeds.select("qid", F.lit("").alias("content_id"), F.lit(0.0).alias("relevance"), F.lit(0).alias("place")).limit(0)
    return _ranked(found_all)


# ------------------------------------------------------------------ planners


def scripted_planner(decisions: DataFrame) -> Planner:
    """Decisions by (qid, hop) from a table; without an entry: stop."""

    def plan(requests: DataFrame) -> DataFrame:
        rows = requests.select("qid", "hop").join(decisions, ["qid", "hop"], "left")
        nothing = F.array().cast("array<struct<id:string,relevance:double>>")
        return rows.select(
            "qid",
            F.coalesce("collect", nothing).alias("collect"),
            "descend_into",
            F.coalesce("stop", F.col("collect").isNull()).alias("stop"),
            F.coalesce("error", F.lit(False)).alias("error"),
        )

    return plan


def rule_planner() -> Planner:
    """A fixed rule, in columns: collect every candidate content with 1 / (1 + its place), go down to the first candidate, stop when there is none."""

    def plan(requests: DataFrame) -> DataFrame:
        contents = F.filter("candidates", lambda c: c["node_kind"] == "content")
        collect = F.transform(contents, lambda c, i: F.struct(c["id"].alias("id"), (F.lit(1.0) / (i + 1)).alias("relevance")))
        return requests.select(
            "qid",
            collect.alias("collect"),
            F.get("candidates", F.lit(0))["id"].alias("descend_into"),
            (F.size("candidates") == 0).alias("stop"),
            F.lit(False).alias("error"),
        )

    return plan


def checked_decision(decision: dict) -> dict:
    """A decision as the protocol asks: known keys only, relevance from 0 to 1."""
    if unknown := set(decision) - {"collect", "descend_into", "stop"}:
        raise ValueError(f"unknown keys in decision: {sorted(unknown)}")
    for item in decision.get("collect") or []:
        if not 0 <= item["relevance"] <= 1:
            raise ValueError(f"relevance {item['relevance']} is not within 0 and 1")
    return decision


def callable_planner(decide: Callable[[dict], dict | None]) -> Planner:
    """A planner from a Python callable of one request (a dict); None means stop, an exception an error row."""

    def plan(requests: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for row in frame.to_dict("records"):
                    try:
                        d = decide({**row, "candidates": [dict(c) for c in row["candidates"]]})
                        d = {"stop": True} if d is None else checked_decision(d)
                        out.append((row["qid"], d.get("collect") or [], d.get("descend_into"), bool(d.get("stop", False)), False))
                    except Exception:  # noqa: BLE001 - a planner's failure ends its own walk with what it has
                        out.append((row["qid"], [], None, True, True))
                yield pd.DataFrame(out, columns=["qid", "collect", "descend_into", "stop", "error"])

        return requests.mapInPandas(run, DECISION)

    return plan
