"""Cross-reference tables and their lookups.

``occurrences``: relative_path, doc_idx, occ_idx, symbol, symbol_roles,
single_line, multi_line, range.  ``relationships``: relative_path (null:
external), sym_idx, symbol, target and four flags; a symbol without
relationships has one row with a null target, so that a lookup ends there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import decoded_range

DEFINITION = 1


def decoded(occurrences: DataFrame) -> DataFrame:
    """Occurrences with their ranges and whether they define their symbol."""
    rows = occurrences.withColumn("__range", decoded_range())
    is_definition = F.col("symbol_roles").bitwiseAND(DEFINITION) != 0
    return rows.select("relative_path", "doc_idx", "occ_idx", "symbol", "__range.*", is_definition.alias("is_definition"))


def occurrences_of(occurrences: DataFrame, relative_path: str) -> DataFrame:
    """A file's occurrences (order: doc_idx, occ_idx)."""
    return decoded(occurrences.where(F.col("relative_path") == relative_path))


def definitions(occurrences: DataFrame, relative_path: str | None = None) -> DataFrame:
    rows = occurrences if relative_path is None else occurrences.where(F.col("relative_path") == relative_path)
    return decoded(rows).where("is_definition")


def references(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """Occurrences, other than definitions, of symbols (symbol, ...) in all files."""
    rows = decoded(occurrences).where("NOT is_definition")
    return rows.join(symbols, "symbol")


def symbol_infos(relationships: DataFrame, wanted: DataFrame) -> DataFrame:
    """Relationships of symbols (symbol, relative_path): the file's first entry, else the external one."""
    rows = relationships.join(wanted.withColumnRenamed("relative_path", "__file"), "symbol").where(
        F.col("relative_path").eqNullSafe(F.col("__file")) | F.col("relative_path").isNull()
    )
    rows = rows.withColumn("external", F.col("relative_path").isNull())
    first = F.min(F.struct("external", "sym_idx")).over(Window.partitionBy("symbol", "__file"))
    rows = rows.withColumn("__first", first).where((F.col("external") == F.col("__first.external")) & (F.col("sym_idx") == F.col("__first.sym_idx")))
    return rows.where("target IS NOT NULL").drop("__first", "__file", "external")


def symbol_info(relationships: DataFrame, symbol: str, relative_path: str | None = None) -> DataFrame:
    """Relationships of one symbol."""
    wanted = relationships.sparkSession.createDataFrame([(symbol, relative_path)], "symbol string, relative_path string")
    return symbol_infos(relationships, wanted)


def content_references(nodes: DataFrame, occurrences: DataFrame, content_ids: DataFrame) -> DataFrame:
    """References of contents (content_id); a content's id is its symbol."""
    symbols = nodes.where("node_type = 'content'").select(F.col("id").alias("symbol")).join(
        content_ids.select(F.col("content_id").alias("symbol")),
        "symbol",
    )
    return references(occurrences, symbols)


def content_relations(nodes: DataFrame, relationships: DataFrame, content_ids: DataFrame, flag: str) -> DataFrame:
    """Relationships of contents with a flag (is_implementation, is_type_definition), looked up in the contents' files, else externally."""
    contents = nodes.where("node_type = 'content'").select(F.col("id").alias("symbol"), "source_file").join(
        content_ids.select(F.col("content_id").alias("symbol")),
        "symbol",
    )
    rows = symbol_infos(relationships, contents.withColumnRenamed("source_file", "relative_path"))
    return rows.where(F.col(flag)).select("symbol", "target", "is_reference", "is_implementation", "is_type_definition", "is_definition")


def files(occurrences: DataFrame) -> DataFrame:
    return occurrences.select("relative_path").distinct()


def line_symbols(occurrences: DataFrame) -> DataFrame:
    """(source_file, lineno, scip_symbol): the symbol defined on each line, counted from 1; the last of a line wins (of equal places the greater symbol)."""
    rows = definitions(occurrences)
    return rows.groupBy(
        F.col("relative_path").alias("source_file"),
        (F.col("start_line") + 1).alias("lineno"),
    ).agg(F.max_by("symbol", F.struct("occ_idx", "symbol")).alias("scip_symbol"))
