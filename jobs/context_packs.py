"""Context packs: for each query the contents that fit a word budget, ready to be put before a model.

For every query vector the job finds the nearest active cues, follows them to
their contents (redirects resolved, tombstones left out, each content once, at
the place of its best cue), and takes contents in that order while their words
fit the budget; the first one is always taken.  A pack names its contents with
label, tags, score of the cue, words and running words.

Packs are Parquet, partitioned by the label of the query.  A run writes all of
them anew, so a rerun gives the same output.
"""

from __future__ import annotations

import logging

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from cuelattice.operators import read, vector
from cuelattice.operators.graph import Graph, first_by
from cuelattice.plans import projection

from .common import kept_setting

logger = logging.getLogger("jobs.context_packs")


def run(spark: SparkSession, tables: str, output: str, k: int = 5, budget: int = 2000, every: int = 100) -> int:
    """Write the packs of the vectors whose id ``every`` divides; returns the number of rows written."""
    with kept_setting(spark, "spark.sql.unionOutputPartitioning"):  # which graphs switch off
        return _run(spark, tables, output, k, budget, every)


def _run(spark: SparkSession, tables: str, output: str, k: int, budget: int, every: int) -> int:
    graph = projection.graph(spark, tables)
    queries = projection.table(spark, tables, "embeddings").where(F.col("vec_id") % every == 0).select(F.col("vec_id").cast("string").alias("qid"), "embedding", "label")
    hits = vector.knn_batch(graph.nodes, queries, k, "cue").select("qid", F.col("rank").alias("ord"), F.col("node_id").alias("id"), "score")
    found = first_by(read.expand_contents(graph, hits, "cue_of"), ["qid", "content_id"], ["ord", "edge_seq"])
    contents = graph.nodes.where("node_type = 'content'").join(found.select(F.col("content_id").alias("id")).distinct(), "id", "left_semi")
    words = contents.select(F.col("id").alias("content_id"), F.regexp_count(F.coalesce("body", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"))
    ways = Window.partitionBy("qid").orderBy("ord", "edge_seq")  # at most the contents of k cues
    packed = found.join(words, "content_id").withColumns({"place": F.row_number().over(ways), "running_words": F.sum("n_words").over(ways.rowsBetween(Window.unboundedPreceding, 0))})
    packed = packed.where((F.col("place") == 1) | (F.col("running_words") <= budget))
    tagged = graph.edges.where("edge_type = 'tagged_with'").join(contents.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    labels = read.content_summaries(Graph(graph.nodes, tagged), contents).select(F.col("id").alias("content_id"), F.col("label").alias("content_label"), F.array_join("tags", ",").alias("tags"))
    out = packed.join(labels, "content_id").join(queries.select("qid", "label"), "qid")
    out = out.select("qid", "place", "content_id", "content_label", "tags", "score", "n_words", "running_words", "label")
    out.write.mode("overwrite").partitionBy("label").parquet(output)
    wrote = read_packs(spark, output).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("qid").alias("packs")).first()
    logger.info("read %s, wrote %d rows of %d packs to %s", tables, wrote.n, wrote.packs, output)
    return wrote.n


PACKS = "qid string, place int, content_id string, content_label string, tags string, score double, n_words long, running_words long, label int"


def read_packs(spark: SparkSession, output: str):
    return spark.read.schema(PACKS).parquet(output)


if __name__ == "__main__":
    from .common import main

    main("context_packs", run, __doc__)
