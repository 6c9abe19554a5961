"""Connected components of a graph given by rows of edges, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v); the label is the component's least node.

    Each round maps every node to the first of itself and its neighbours, and
    turns an edge (u, v) into the edge of their images.  A node and its image
    stay joined, and a node that no edge is left to has its component's name.
    Rounds order nodes by themselves and by a hash in turn: stars around a
    least node collapse in one of the former, paths shrink by a constant factor
    in each of the latter.  All steps are partial aggregates and joins over
    edges; a node with very many edges is an aggregate's key or a join's
    repeated key, never a group held by one task.
    """
    scratch = Scratch(edges.sparkSession)
    current = scratch.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    labels = None
    for turn in range(rounds):
        if current.isEmpty():
            break
        ends = current.select(F.col("u").alias("node"), F.col("v").alias("near"))
        ends = ends.unionByName(current.select(F.col("v").alias("node"), F.col("u").alias("near")))
        if turn % 2:
            rank = lambda c, t=turn: F.struct(F.xxhash64(F.lit(t), c).alias("h"), F.col(c).alias("n"))
            image = ends.groupBy("node").agg(F.min(rank("near")).alias("near")).select("node", F.least(rank("node"), "near")["n"].alias("image"))
        else:
            image = ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("image"))
        image = scratch.table(image, "images")
        if labels is None:
            labels = scratch.table(image.select("node", F.col("image").alias("label")), "labels")
        else:
            moved = labels.join(image.select(F.col("node").alias("label"), "image"), "label", "left")
            moved = scratch.table(moved.select("node", F.coalesce("image", "label").alias("label")), "labels")
            scratch.drop(labels)
            labels = moved
        u = image.select(F.col("node").alias("u"), F.col("image").alias("u2"))
        v = image.select(F.col("node").alias("v"), F.col("image").alias("v2"))
        after = current.join(u, "u").join(v, "v").where("u2 <> v2")
        after = scratch.table(after.select(F.greatest("u2", "v2").alias("u"), F.least("u2", "v2").alias("v")).distinct(), "edges")
        scratch.drop(current, image)
        current = after
    else:
        raise RuntimeError("components did not settle")
    if labels is None:
        scratch.close()
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).limit(0)
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    out = scratch.table(labels.join(least, "label").select("node", F.col("least").alias("label")), "components")
    scratch.close(out)
    return out
