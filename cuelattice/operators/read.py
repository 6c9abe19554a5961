"""The read service: search, traversals, fetch and their projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import content_label, content_snippet
from .graph import Graph, content_tags, first_by, neighbor_ids, neighbors, resolve_redirects, with_all_tags
from .vector import knn


def search(graph: Graph, query: list[float], k: int = 5) -> DataFrame:
    """The k nearest active cues as (rank order by score, id): score and the cue's columns."""
    hits = knn(graph.nodes, query, k, "cue").withColumnRenamed("node_id", "id")
    return graph.nodes.join(F.broadcast(hits), "id")  # k rows


def active_contents(graph: Graph) -> DataFrame:
    return graph.nodes.where("node_type = 'content' AND status = 'active'")


def expand_contents(graph: Graph, ids: DataFrame, edge_type: str, tags: list[tuple[str, str]] | None = None) -> DataFrame:
    """(ord, id, edge_seq, content_id): contents one typed hop away, after redirects, active and with all tags."""
    hop = neighbor_ids(graph.edges, ids, edge_type).withColumnRenamed("neighbor_id", "content_id")
    # The join with active contents below drops dangling ends too; edges never begin at a missing node.
    hop = resolve_redirects(graph, hop, "content_id")
    hop = hop.join(active_contents(graph).select(F.col("id").alias("content_id")), "content_id", "left_semi")
    return with_all_tags(graph, hop, tags or [])


def traverse_forward(graph: Graph, cues: DataFrame, tags: list[tuple[str, str]] | None = None) -> DataFrame:
    """Contents of cues (ord, id): each once, at its first place by cue and edge order (ord, edge_seq)."""
    found = first_by(expand_contents(graph, cues, "cue_of", tags), ["content_id"], ["ord", "edge_seq"])
    return found.select("ord", "edge_seq", "content_id")


def traverse_reverse(graph: Graph, contents: DataFrame) -> DataFrame:
    """Cues that point at contents (ord, id), whatever their status: each once, at its first place."""
    hop = neighbors(graph, contents, "cue_of", "incoming").where("n_node_type = 'cue'")
    return first_by(hop, ["n_id"], ["ord", "edge_seq"]).select("ord", "edge_seq", F.col("n_id").alias("cue_id"), F.col("n_text").alias("text"))


def fetch(graph: Graph, ids: DataFrame) -> DataFrame:
    """Active contents by id, in input order and with repetitions."""
    return ids.join(active_contents(graph), "id")


def cue_summaries(nodes: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    return nodes.where("node_type = 'cue'").select(
        "id",
        F.lit("cue").alias("node_kind"),
        F.col("text").alias("label"),
        F.lit(None).cast("string").alias("snippet"),
        empty.alias("tags"),
    )


def content_summaries(graph: Graph, contents: DataFrame | None = None) -> DataFrame:
    """id, node_kind, label, snippet and tags of contents."""
    rows = graph.nodes.where("node_type = 'content'") if contents is None else contents
    rows = rows.join(content_tags(graph), "id", "left")
    return rows.select(
        "id",
        F.lit("content").alias("node_kind"),
        content_label().alias("label"),
        content_snippet().alias("snippet"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )


def content_details(nodes: DataFrame) -> DataFrame:
    """Full contents; vectors are never returned."""
    return nodes.where("node_type = 'content'").select(
        "id",
        "status",
        "source_file",
        "git_sha",
        "kind",
        "memory_layer",
        "symbol_name",
        "signature",
        "docstring",
        "body",
    )
