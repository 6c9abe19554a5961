"""Schemas, closed vocabularies and write-boundary checks of the memory graph.

A graph is two tables: ``nodes`` (one row an id; ``node_type`` tells cue, tag
and content apart) and ``edges`` (one row a (source, target, type) triple).
``node_seq`` and ``edge_seq`` keep the order of first insertion, which decides
neighbour order, first-of ties and de-duplication everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The closed vocabularies.
VOCABULARY = {
    "node_type": ["cue", "tag", "content"],
    "status": ["active", "deleted"],
    "edge_type": ["cue_of", "tagged_with", "part_of_topic", "redirects_to"],
    "cue_type": ["symbol", "concept", "error_message"],
    "category": ["module_path", "arch_layer", "pattern_type", "lang_construct", "language"],
    "kind": ["function", "class", "module", "commit", "test"],
    "memory_layer": ["episodic", "semantic", "topic"],
}
DIRECTIONS = ("outgoing", "incoming")


_TYPES = {"STRING": T.StringType(), "BIGINT": T.LongType(), "TIMESTAMP_NTZ": T.TimestampNTZType(), "ARRAY<DOUBLE>": T.ArrayType(T.DoubleType())}


def _fields(spec: str) -> T.StructType:
    """A schema from ``name TYPE`` pairs, without need of a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in spec.split(", "))])


NODES = _fields(
    "id STRING, node_type STRING, status STRING, indexed_at TIMESTAMP_NTZ, deleted_at TIMESTAMP_NTZ, deleted_by_commit STRING, "
    "source_file STRING, git_sha STRING, cue_type STRING, text STRING, category STRING, value STRING, kind STRING, memory_layer STRING, "
    "symbol_name STRING, signature STRING, docstring STRING, body STRING, embedding ARRAY<DOUBLE>, embedding_model STRING, "
    "embedding_model_version STRING, node_seq BIGINT"
)
EDGES = _fields("source_id STRING, target_id STRING, edge_type STRING, source_file STRING, git_sha STRING, indexed_at TIMESTAMP_NTZ, edge_seq BIGINT")
INDEXED_FILES = _fields("file_path STRING, git_sha STRING, indexed_at TIMESTAMP_NTZ, file_seq BIGINT")


def as_nodes(df: DataFrame) -> DataFrame:
    """Fill missing node columns with null and order all of them as in ``NODES``."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in NODES])


def as_edges(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in EDGES])


def node_fault(embedding_model: str | None = None, embedding_dim: int | None = None) -> Column:
    """What is wrong with a node row, or null: a value outside a vocabulary, or an embedding that does not fit the store."""
    ok = F.col("id").isNotNull() & F.col("node_type").isin(VOCABULARY["node_type"]) & F.col("status").isin(VOCABULARY["status"])
    for name in ("cue_type", "category", "kind", "memory_layer"):
        ok = ok & (F.col(name).isNull() | F.col(name).isin(VOCABULARY[name]))
    fits = F.col("embedding_model").isNotNull()
    if embedding_model is not None:
        fits = fits & (F.col("embedding_model") == embedding_model)
    if embedding_dim is not None:
        fits = fits & (F.size("embedding") == embedding_dim)
    name = F.coalesce("id", F.lit("null"))
    return (
        F.when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit("invalid node: "), name))
        .when(F.col("embedding").isNotNull() & ~F.coalesce(fits, F.lit(False)), F.concat(F.lit("embedding does not fit the store: "), name))
    )


def _sound(df: DataFrame, fault: Column) -> DataFrame:
    """The rows, raising on a fault; a filter, as within a column the test would run again wherever the column is used."""
    return df.where(F.when(fault.isNull(), F.lit(True)).otherwise(F.raise_error(fault).cast("boolean")))


def checked_nodes(df: DataFrame, embedding_model: str | None = None, embedding_dim: int | None = None) -> DataFrame:
    """The nodes, raising at run time on the first fault."""
    return _sound(df, node_fault(embedding_model, embedding_dim))


def edge_fault() -> Column:
    ok = F.col("source_id").isNotNull() & F.col("target_id").isNotNull() & F.col("edge_type").isin(VOCABULARY["edge_type"])
    return F.when(~F.coalesce(ok, F.lit(False)), F.lit("invalid edge"))


def checked_edges(df: DataFrame) -> DataFrame:
    return _sound(df, edge_fault())


def parse_tag_filters(pairs: list[tuple[str, str]] | None) -> list[tuple[str, str]]:
    """Distinct (category, value) filters; an unknown category raises and lists the valid ones."""
    for category, _ in pairs or []:
        if category not in VOCABULARY["category"]:
            raise ValueError(f"unknown tag category {category!r}; valid: {', '.join(VOCABULARY['category'])}")
    return list(dict.fromkeys(pairs or []))
