"""The driver's tables as a memory graph.

This mapping is the engine's own, for tests and benchmarks: documents are
semantic contents, their sources topics, conversation turns episodic contents,
embeddings cues, and languages, sources and quality labels tags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..operators.packed import Packed, pack
from ..schema import as_edges, as_nodes
from . import lineage

#: Edge sequences start here for each kind, so that kinds keep their order.
TAGGED, TOPIC, REDIRECT = 10**12, 2 * 10**12, 3 * 10**12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doc(c) -> F.Column:
    return F.concat(F.lit("content:doc:"), c.cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    status = F.when(F.col("toxic") == 1, "deleted").otherwise("active")
    contents = docs.join(labels, "doc_id", "left").select(
        _doc(F.col("doc_id")).alias("id"), F.lit("content").alias("node_type"), status.alias("status"), F.col("source").alias("source_file"), F.lit("function").alias("kind"),
        F.lit("semantic").alias("memory_layer"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("symbol_name"), F.col("text").alias("body"), F.sha1(F.col("doc_id").cast("string").cast("binary")).alias("git_sha"), F.col("doc_id").alias("node_seq"),
    )
    active = F.lit("active").alias("status")
    topics = docs.select("source").distinct().select(
        F.concat(F.lit("content:src:"), "source").alias("id"), F.lit("content").alias("node_type"), active, F.col("source").alias("source_file"), F.lit("module").alias("kind"), F.lit("topic").alias("memory_layer"), F.col("source").alias("symbol_name"), F.lit("").alias("body"),
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.concat(
            F.lit("content:conv:"),
            F.col("conv_id").cast("string"),
            F.lit(":"),
            F.col("turn").cast("string"),
        ).alias("id"), F.lit("content").alias("node_type"), active, F.lit("commit").alias("kind"), F.lit("episodic").alias("memory_layer"), F.col("role").alias("signature"), F.col("text").alias("body"),
    )
    cues = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("cue:vec:"), F.col("vec_id").cast("string")).alias("id"), F.lit("cue").alias("node_type"), active, F.lit("concept").alias("cue_type"), F.concat(F.lit("concept "), F.col("label").cast("string")).alias("text"),
        F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), F.lit("driver-d64").alias("embedding_model"), F.col("vec_id").alias("node_seq"),
    )
    tags = tag_rows(spark, sf_dir).select("category", "value").distinct().select(
        F.concat_ws(":", F.lit("tag"), "category", "value").alias("id"), F.lit("tag").alias("node_type"), active, "category", "value",
    )
    out = as_nodes(contents)
    for part in (topics, turns, cues, tags):
        out = out.unionByName(as_nodes(part))
    return out


def tag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, place, category, value) of every document's tags."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    one = lambda place, category, value: F.struct(F.lit(place).alias("place"), F.lit(category).alias("category"), value.alias("value"))
    quality = F.concat(F.lit("quality:"), F.col("quality").cast("string"))
    tags = F.array(one(0, "language", F.col("lang")), one(1, "module_path", F.col("source")), one(2, "pattern_type", quality))
    return docs.join(labels, "doc_id", "left").select("doc_id", F.explode(tags).alias("tag")).select("doc_id", "tag.*").where("value IS NOT NULL")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = docs.count()  # a count from the footers
    vec = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    first, second = F.pmod("vec_id", F.lit(n)), F.pmod(F.col("vec_id") * 7 + F.col("label"), F.lit(n))
    ends = F.when(first == second, F.array(F.struct(F.lit(0).alias("k"), first.alias("doc")))).otherwise(
        F.array(F.struct(F.lit(0).alias("k"), first.alias("doc")), F.struct(F.lit(1).alias("k"), second.alias("doc")))
    )
    cue_of = vec.select("vec_id", F.explode(ends).alias("e")).select(
        F.concat(F.lit("cue:vec:"), F.col("vec_id").cast("string")).alias("source_id"), _doc(F.col("e.doc")).alias("target_id"), F.lit("cue_of").alias("edge_type"), (F.col("vec_id") * 2 + F.col("e.k")).alias("edge_seq"),
    )
    tagged = tag_rows(spark, sf_dir).select(
        _doc(F.col("doc_id")).alias("source_id"), F.concat_ws(":", F.lit("tag"), "category", "value").alias("target_id"), F.lit("tagged_with").alias("edge_type"), (
            F.lit(TAGGED) + F.col("doc_id") * 4 + F.col("place")
        ).alias("edge_seq"),
    )
    topic = docs.where("source IS NOT NULL").select(
        _doc(F.col("doc_id")).alias("source_id"), F.concat(F.lit("content:src:"), "source").alias("target_id"), F.lit("part_of_topic").alias("edge_type"), F.col("source").alias("source_file"), (F.lit(TOPIC) + F.col("doc_id")).alias("edge_seq"),
    )
    # Exact copies redirect to the first document with their text; texts meet by hash, and the hash is of all of a text.
    hashed = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    least = hashed.groupBy("h").agg(F.min("doc_id").alias("first"))
    redirect = hashed.join(least, "h").where("doc_id <> first").select(
        _doc(F.col("doc_id")).alias("source_id"), _doc(F.col("first")).alias("target_id"), F.lit("redirects_to").alias("edge_type"), (F.lit(REDIRECT) + F.col("doc_id")).alias("edge_seq"),
    )
    out = as_edges(cue_of)
    for part in (tagged, topic, redirect):
        out = out.unionByName(as_edges(part))
    return out


_SAVED: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """When the tables were last written, so that a changed table is not taken for the saved one."""
    names = ("documents", "labels", "conversations", "embeddings")
    paths = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{n}.parquet") for n in names]
    return tuple(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime() for p in paths)


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph as saved tables, nodes and edges each in a folder by type: built once in a session, then only read."""
    key = (spark.sparkContext.applicationId, sf_dir, _stamp(spark, sf_dir))
    if key not in _SAVED:
        _SAVED[key] = lineage.saved(nodes(spark, sf_dir), "node_type"), lineage.saved(edges(spark, sf_dir), "edge_type")
    return Graph(*_SAVED[key])  # anew, as a graph sees to the session's settings


_PACKED: dict[tuple, Packed] = {}


def packed(spark: SparkSession, sf_dir: str) -> Packed:
    """The graph packed for reading: once in a session, then only read."""
    key, plain = (spark.sparkContext.applicationId, sf_dir, _stamp(spark, sf_dir)), graph(spark, sf_dir)
    if key not in _PACKED:
        _PACKED[key] = pack(plain)
    return _PACKED[key]


#: The same mapping in DuckDB SQL, as common table expressions.
ORACLE = """
doc_rows AS (SELECT d.doc_id, d.text, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
tag_rows AS (
  SELECT doc_id, 0 AS place, 'language' AS category, lang AS value FROM doc_rows WHERE lang IS NOT NULL
  UNION ALL SELECT doc_id, 1, 'module_path', source FROM doc_rows WHERE source IS NOT NULL
  UNION ALL SELECT doc_id, 2, 'pattern_type', 'quality:' || quality FROM doc_rows WHERE quality IS NOT NULL),
nodes AS (
  SELECT 'content:doc:' || doc_id AS id, 'content' AS node_type, CASE WHEN toxic = 1 THEN 'deleted' ELSE 'active' END AS status, source AS source_file, 'function' AS kind,
         'semantic' AS memory_layer, 'doc_' || doc_id AS symbol_name, NULL AS signature, text AS body, NULL AS text, NULL AS category, NULL AS value, NULL::DOUBLE[] AS embedding, doc_id AS node_seq, sha1(CAST(doc_id AS VARCHAR)) AS git_sha
           FROM doc_rows
  UNION ALL SELECT DISTINCT 'content:src:' || source, 'content', 'active', source, 'module', 'topic', source, NULL, '', NULL, NULL, NULL, NULL, NULL::BIGINT, NULL
    FROM documents
  UNION ALL SELECT 'content:conv:' || conv_id || ':' || turn, 'content', 'active', NULL, 'commit', 'episodic', NULL, role, text, NULL, NULL, NULL, NULL, NULL, NULL
    FROM conversations
  UNION ALL SELECT 'cue:vec:' || vec_id, 'cue', 'active', NULL, NULL, NULL, NULL, NULL, NULL, 'concept ' || label, NULL, NULL, embedding::DOUBLE[], vec_id, NULL
    FROM embeddings
  UNION ALL SELECT DISTINCT 'tag:' || category || ':' || value, 'tag', 'active', NULL, NULL, NULL, NULL, NULL, NULL, NULL, category, value, NULL, NULL, NULL
    FROM tag_rows),
n_docs AS (SELECT count(*) AS n FROM documents),
edges AS (
  SELECT 'cue:vec:' || vec_id AS source_id, 'content:doc:' || (vec_id % n) AS target_id, 'cue_of' AS edge_type, NULL AS source_file, vec_id * 2 AS edge_seq
    FROM embeddings, n_docs
  UNION ALL SELECT 'cue:vec:' || vec_id, 'content:doc:' || ((vec_id * 7 + label) % n), 'cue_of', NULL, vec_id * 2 + 1
    FROM embeddings, n_docs WHERE vec_id % n <> (vec_id * 7 + label) % n
  UNION ALL SELECT 'content:doc:' || doc_id, 'tag:' || category || ':' || value, 'tagged_with', NULL, 1000000000000 + doc_id * 4 + place
    FROM tag_rows
  UNION ALL SELECT 'content:doc:' || doc_id, 'content:src:' || source, 'part_of_topic', source, 2000000000000 + doc_id FROM documents
    WHERE source IS NOT NULL
  UNION ALL SELECT 'content:doc:' || doc_id, 'content:doc:' || first, 'redirects_to', NULL, 3000000000000 + doc_id
    FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) WHERE doc_id <> first),
redirects AS (SELECT source_id AS id, arg_min(target_id, edge_seq) AS redirect_id FROM edges WHERE edge_type = 'redirects_to'
  GROUP BY source_id),
tags_of AS (SELECT DISTINCT e.source_id AS id, t.category, t.value FROM edges e JOIN nodes t ON t.id = e.target_id AND t.node_type = 'tag'
  WHERE e.edge_type = 'tagged_with')
"""
