"""Mixing sources to target weights, with DataFrame functions alone.

Each row gets a hash-random key.  Keys are range-sorted within each source:
a source of n rows has about sqrt(n) key ranges, so neither a range nor the
list of ranges of a hot source is large.  Prefix sums of the sizes are built in
two steps (over the ranges, then inside each range), and every source is cut at
its exact budget: whole epochs first, then the first rows by key.

Defined cases: null text has size 0; null sources form one source, ordered
last; a null doc_id hashes as the empty string; equal rows get equal keys, and
their order among each other changes nothing; an empty table gives no rows;
further columns are ignored by :func:`mix` and kept by :func:`apply_mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, documents, materialise, text_or_empty

MOST_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def hash_key(doc_id: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 digest."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sized: DataFrame, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """One row per source: source, source_size, rows, target.

    Sources by code point weigh 1, 2, 3, repeating.  The target is
    min(most_epochs * size, level * weight), where the level makes all targets
    add up to the size of everything: where resharing the excess ends.  The
    windows here span one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    per = per.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    per = per.withColumn("cap", F.col("source_size") * most_epochs)
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "*",
        (F.col("cap") / F.col("weight")).alias("ratio"),
        F.row_number().over(by_ratio).alias("pos"),
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left_size"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"),
    )
    per = per.withColumn("level", F.col("left_size") / F.col("left_weight"))
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("pos", "level"))).over(every)["level"]
    return per.select("source", "source_size", "rows", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"))


def sized_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(text_or_empty()).alias("size"), hash_key(F.col("doc_id")).alias("key"))


def cut(sized: DataFrame, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Add source_size, target and taken to rows of (doc_id, source, size, key, ...)."""
    rows = sized.alias("r").join(targets(sized.select("source", "size"), most_epochs).alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    ranges = F.ceil(F.sqrt("t.rows"))
    # A source name that is never null: the join and the window below then share one exchange of the rows.
    name = F.coalesce(F.concat(F.lit("="), F.col("r.source")), F.lit(""))
    rows = rows.select("r.*", "t.source_size", "t.target", name.alias("source_name"), F.floor(F.col("r.key") * ranges).alias("key_range"))
    sums = rows.groupBy("source_name", "key_range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source_name").orderBy("key_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("range_start", F.coalesce(F.sum("range_size").over(earlier), F.lit(0))).drop("range_size")
    rows = rows.join(sums, ["source_name", "key_range"])
    inside = Window.partitionBy("source_name", "key_range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("range_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rows = rows.withColumns({"row_start": start, "epochs": epochs})
    rest = budget - F.col("epochs") * F.col("source_size") - F.col("row_start")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return rows.withColumn("taken", taken.cast("long")).drop("source_name", "key_range", "range_start", "row_start", "epochs")


def mix(docs: DataFrame, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words) of every row."""
    sized, _ = materialise(sized_rows(docs), "mix-sizes")
    return cut(sized, most_epochs).drop("key")


def apply_mix(docs: DataFrame, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """The mixed rows themselves, with the columns of ``docs``.

    A row stands in the mix as often as it is taken whole; the one row of a
    source at which the budget ends gives the words up to it.
    """
    columns = docs.columns
    inner = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc_row"),
        "doc_id",
        "source",
        word_count(text_or_empty()).alias("size"),
        hash_key(F.col("doc_id")).alias("key"),
    )
    inner, _ = materialise(inner, "mix-rows")
    rows = cut(inner, most_epochs).where("taken > 0")
    whole, part = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    counts = F.concat(F.array_repeat(F.col("size").cast("int"), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    rows = rows.select("doc_row", "size", F.explode(counts).alias("words"))
    # The words up to the budget, with the white space between them.
    pieces = F.regexp_extract_all(F.col("doc_row.text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    head = F.array_join(F.slice(pieces, F.lit(1), F.col("words")), "")
    text = F.when(F.col("words") == F.col("size"), F.col("doc_row.text")).otherwise(head)
    new = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in columns else {"text": text}
    return rows.select(*[(new[c] if c in new else F.col(f"doc_row.`{c}`")).alias(c) for c in columns])


def query(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS key
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
steps AS (
  SELECT *, 3 * source_size / weight AS ratio,
         row_number() OVER by_ratio AS pos,
         CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (by_ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (by_ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM per WINDOW by_ratio AS (ORDER BY 3 * source_size / weight, source NULLS LAST)),
goals AS (
  SELECT source, source_size,
         least(CAST(3 * source_size AS DOUBLE), (SELECT arg_min(level, pos) FROM steps WHERE ratio >= level) * weight) AS target
  FROM steps),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, CAST(floor(g.target) AS BIGINT) AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
counted AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - start)) AS BIGINT) AS taken
FROM counted
"""
