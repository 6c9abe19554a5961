"""Set-at-a-time reads of the graph: neighbours, redirects, tags, scans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DIRECTIONS


@dataclass(frozen=True)
class Graph:
    """A pair of tables with the schemas of :mod:`cuelattice.schema`."""

    nodes: DataFrame
    edges: DataFrame

    def __post_init__(self):
        # Spark 4.1 takes a union of sides that are partitioned alike for partitioned itself, and fails when it coalesces the sides differently.
        self.nodes.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")


def ordered_ids(spark, ids: list[str], name: str = "id") -> DataFrame:
    """A caller's ids with their ordinals."""
    return spark.createDataFrame(list(enumerate(ids)), f"ord long, {name} string")


def get_nodes(graph: Graph, ids: DataFrame) -> DataFrame:
    """Nodes by id, tombstones included; unknown ids give nothing."""
    return ids.join(graph.nodes, "id")


def neighbor_ids(edges: DataFrame, ids: DataFrame, edge_type: str | None = None, direction: str = "outgoing") -> DataFrame:
    """ids (ord, id, ...) with the id at the other end and the edge's order.  The type is filtered before the join."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    here, there = ("source_id", "target_id") if direction == "outgoing" else ("target_id", "source_id")
    if edge_type is not None:
        edges = edges.where(F.col("edge_type") == edge_type)
    edges = edges.select(F.col(here).alias("id"), F.col(there).alias("neighbor_id"), "edge_type", "edge_seq")
    return ids.join(edges, "id")


def neighbors(graph: Graph, ids: DataFrame, edge_type: str | None = None, direction: str = "outgoing") -> DataFrame:
    """One hop from each of ids (ord, id), in edge order.

    A neighbour over two edge types comes twice; unknown ids give nothing.
    Columns: ord, id, edge_seq, edge_type and the neighbour's own, prefixed n_.
    """
    hop = neighbor_ids(graph.edges, ids, edge_type, direction)
    far = graph.nodes.select(*[F.col(c).alias(f"n_{c}") for c in graph.nodes.columns])
    return hop.join(far, F.col("neighbor_id") == F.col("n_id")).drop("neighbor_id")


def redirects(graph: Graph) -> DataFrame:
    """(id, redirect_id): each node's first redirect.  Writes and deletes keep edges only where both ends exist."""
    hops = graph.edges.where("edge_type = 'redirects_to'")
    return hops.groupBy(F.col("source_id").alias("id")).agg(F.min_by("target_id", "edge_seq").alias("redirect_id"))


def resolve_redirects(graph: Graph, ids: DataFrame, column: str) -> DataFrame:
    """Replace ``column`` by its redirect, one hop only."""
    table = redirects(graph).withColumnRenamed("id", column)
    return ids.join(table, column, "left").withColumn(column, F.coalesce("redirect_id", column)).drop("redirect_id")


def tag_pairs(graph: Graph) -> DataFrame:
    """(id, category, value): distinct tags of every node that has any."""
    tags = graph.nodes.where("node_type = 'tag'").select(F.col("id").alias("target_id"), "category", "value")
    return graph.edges.where("edge_type = 'tagged_with'").join(tags, "target_id").select(
        F.col("source_id").alias("id"),
        "category",
        "value",
    ).distinct()


def content_tags(graph: Graph) -> DataFrame:
    """(id, tags): sorted ``category=value`` strings of every tagged node."""
    return tag_pairs(graph).groupBy("id").agg(F.array_sort(F.collect_set(F.concat_ws("=", "category", "value"))).alias("tags"))


def with_all_tags(graph: Graph, rows: DataFrame, wanted: list[tuple[str, str]], column: str = "content_id") -> DataFrame:
    """Rows whose node has all wanted (category, value) tags; no filter if there are none."""
    wanted = list(dict.fromkeys(wanted))
    if not wanted:
        return rows
    one = None
    for category, value in wanted:
        this = (F.col("category") == category) & (F.col("value") == value)
        one = this if one is None else one | this
    full = tag_pairs(graph).where(one).groupBy("id").count().where(F.col("count") == len(wanted))
    return rows.join(full.select(F.col("id").alias(column)), column, "left_semi")


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def counts(graph: Graph) -> DataFrame:
    """node_count and edge_count."""
    n = graph.nodes.agg(F.count(F.lit(1)).alias("node_count"))
    return n.crossJoin(graph.edges.agg(F.count(F.lit(1)).alias("edge_count")))  # one row by one row


def nodes_for_file(graph: Graph, source_file: str) -> DataFrame:
    return graph.nodes.where(F.col("source_file") == source_file)


def index_metadata(graph: Graph) -> DataFrame:
    """Vectors, their dimension and model."""
    has = graph.nodes.where("embedding IS NOT NULL")
    return has.agg(
        F.count(F.lit(1)).alias("size"),
        F.max(F.size("embedding")).alias("embedding_dim"),
        F.max("embedding_model").alias("embedding_model"),
    )
