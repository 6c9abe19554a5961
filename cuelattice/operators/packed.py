"""A graph packed for reading: what every hop needs, laid out once by node.

Three tables, bucketed and sorted by node id, so that a hop is a join in which
only the side of the asked ids moves:

* ``adjacency``: the neighbours of a node in each direction, in edge order;
* ``summaries``: label, snippet and the sorted tags of each cue and content, so
  that a tag filter is a predicate on an array;
* ``candidates``: what a walk can go to from a node, with summaries and with the
  content that each candidate stands for when it is collected.

A node with more than ``MOST`` entries has several rows, dealt by a hash, so no
row and no group grows with a hub.  The tables are of one version of the graph
and are packed again when it changes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import bucketed
from ..schema import DIRECTIONS
from .graph import Graph, first_by, redirects
from .read import content_summaries, cue_summaries

#: Entries of one packed row, about.
MOST = 4096


@dataclass(frozen=True)
class Packed:
    adjacency: DataFrame
    summaries: DataFrame
    candidates: DataFrame


def _spread(rows: DataFrame, key: str, by: str, most: int) -> DataFrame:
    """Rows with a ``salt``: 0, but for keys with more than ``most`` rows one of as many as they need.

    Keys with so many rows are at most one in ``most`` rows; they are found by a count with map-side sums.
    """
    heavy = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    heavy = heavy.select(key, F.ceil(F.col("n") / most).cast("int").alias("salts"))
    salt = F.pmod(F.xxhash64(by), F.coalesce("salts", F.lit(1))).cast("int")
    return rows.join(heavy, key, "left").withColumn("salt", salt).drop("salts")


def adjacency(graph: Graph, most: int = MOST) -> DataFrame:
    """id, salt, outgoing, incoming: arrays of (edge_seq, edge_type, id) in edge order."""
    edges = graph.edges.select("source_id", "target_id", "edge_type", "edge_seq")

    def ends(here: str, there: str, direction: str) -> DataFrame:
        return edges.select(F.col(here).alias("id"), F.struct("edge_seq", "edge_type", F.col(there).alias("id")).alias("edge"), F.lit(direction).alias("direction"))

    rows = ends("source_id", "target_id", "outgoing").unionByName(ends("target_id", "source_id", "incoming"))
    packed = _spread(rows, "id", "edge", most).groupBy("id", "salt").agg(*[F.array_sort(F.collect_list(F.when(F.col("direction") == d, F.col("edge")))).alias(d) for d in DIRECTIONS])
    return packed


def summaries(graph: Graph) -> DataFrame:
    """id, node_type, status, node_kind, label, snippet, tags of every cue and content."""
    labels = cue_summaries(graph.nodes).unionByName(content_summaries(graph))
    return graph.nodes.where("node_type <> 'tag'").select("id", "node_type", "status").join(labels, "id")


def candidates(graph: Graph, labels: DataFrame, most: int = MOST) -> DataFrame:
    """id, salt, candidates: structs of ord (branch, edge_seq), id, node_kind, label, snippet, tags, content."""
    kinds = labels.select("id", "node_type", "status")
    active = kinds.where("node_type = 'content' AND status = 'active'").select(F.col("id").alias("to"))
    ways = graph.edges.where("edge_type IN ('cue_of', 'part_of_topic')").select(F.col("source_id").alias("id"), F.col("target_id").alias("to"), "edge_type", "edge_seq")
    hops = ways.join(redirects(graph).select(F.col("id").alias("to"), "redirect_id"), "to", "left").withColumn("to", F.coalesce("redirect_id", "to"))
    branch = F.when(F.col("edge_type") == "cue_of", 0).otherwise(1)
    hops = hops.select("id", "to", F.struct(branch.alias("branch"), "edge_seq").alias("ord")).join(active, "to", "left_semi")
    hops = hops.join(kinds.select("id", "node_type"), "id").where("(node_type = 'cue') = (ord.branch = 0)")
    hops = hops.groupBy("id", "to").agg(F.min("ord").alias("ord"))
    stands_for = hops.where("ord.branch = 0").groupBy("id").agg(F.min_by("to", "ord.edge_seq").alias("content"))
    # a cue collected stands for its first content whatever the filter on tags
    cues = kinds.where("node_type = 'cue' AND status = 'active'").select(F.col("id").alias("to")).join(stands_for.withColumnRenamed("id", "to"), "to", "left")
    back = ways.where("edge_type = 'cue_of'").select(F.col("to").alias("id"), F.col("id").alias("to"), F.struct(F.lit(0).alias("branch"), "edge_seq").alias("ord"))
    back = back.join(cues, "to").join(kinds.where("node_type = 'content'").select("id"), "id", "left_semi")
    rows = hops.withColumn("content", F.col("to")).unionByName(back.select("id", "to", "ord", "content"))
    told = rows.join(labels.select(F.col("id").alias("to"), "node_kind", "label", "snippet", "tags"), "to")
    item = F.struct("ord", F.col("to").alias("id"), "node_kind", "label", "snippet", "tags", "content")
    return _spread(told.select("id", "to", item.alias("item")), "id", "to", most).groupBy("id", "salt").agg(F.array_sort(F.collect_list("item")).alias("candidates"))


def pack(graph: Graph, most: int = MOST) -> Packed:
    n = graph.nodes.count()  # each table has a row a node, and few more for hubs
    labels = bucketed(summaries(graph), "summaries", "id", n)
    return Packed(bucketed(adjacency(graph, most), "adjacency", "id", n), labels, bucketed(candidates(graph, labels, most), "candidates", "id", n))


def has_tags(tags: list[tuple[str, str]], column: Column | str = "tags") -> Column:
    """Whether sorted ``category=value`` tags hold all wanted ones."""
    found = F.lit(True)
    for category, value in tags:
        found = found & F.array_contains(column, f"{category}={value}")
    return found


def neighbors(packed: Packed, ids: DataFrame, edge_type: str | None = None, direction: str = "outgoing") -> DataFrame:
    """ids (id, ...) with neighbor_id, edge_type and edge_seq, as :func:`cuelattice.operators.graph.neighbor_ids`, without moving edges."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    edges = F.col(direction) if edge_type is None else F.filter(direction, lambda e: e["edge_type"] == edge_type)
    rows = ids.join(packed.adjacency.select("id", direction), "id").withColumn("edge", F.explode(edges)).drop(direction)
    return rows.select(*ids.columns, F.col("edge.id").alias("neighbor_id"), "edge.edge_type", "edge.edge_seq")


def traverse_forward(packed: Packed, cues: DataFrame, tags: list[tuple[str, str]] | None = None) -> DataFrame:
    """Contents of cues (ord, id), each once, at its first place by cue and edge order, as :func:`cuelattice.operators.read.traverse_forward`.

    One join: redirects, status and tags are in the packed row.
    """
    asked = cues.select("id", F.col("ord").alias("asked"))
    rows = asked.join(packed.candidates, "id").withColumn("to", F.explode(F.filter("candidates", lambda c: (c["node_kind"] == "content") & (c["ord"]["branch"] == 0)))).where(has_tags(tags or [], "to.tags"))
    rows = rows.select(F.col("asked").alias("ord"), F.col("to.ord.edge_seq").alias("edge_seq"), F.col("to.id").alias("content_id"))
    return first_by(rows, ["content_id"], ["ord", "edge_seq"]).select("ord", "edge_seq", "content_id")
