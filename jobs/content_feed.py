"""Feed of changed contents: what is new in a growing folder of documents, in the form that the memory keeps.

Files of documents (doc_id, text, lang, source) arrive in a folder.  Each run
takes the files that the checkpoint has not seen, as one or more batches of a
file stream, and appends a row for every document that is new or whose content
or metadata is not what the feed has: its content id, git blob sha, label,
snippet, tags and number of words.  A document that comes again unchanged gives
nothing, so the memory need not parse or embed it again.

The feed is Parquet, partitioned by batch and language.  A batch is written by
overwriting its own partitions and compares itself with earlier batches only,
so one that failed half-way or is replayed gives the same rows.  An output
belongs to one checkpoint.

Of several rows of one document in a batch the one of the newest file counts,
and of equally new ones the one with the greatest fingerprint.  Rows without a
doc_id are one document.  A null text counts as empty.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.functions import scalar
from cuelattice.operators.graph import first_by

logger = logging.getLogger("jobs.content_feed")

FEED = (
    "doc_id long, content_id string, change string, fingerprint string, git_sha string, source string, label string, snippet string, "
    "tags array<string>, n_words long, batch long, lang string"
)
LABEL = 80


def shaped(documents: DataFrame) -> DataFrame:
    """Documents as rows of the feed, without change and batch."""
    body = F.coalesce("text", F.lit(""))
    rows = documents.withColumns({"body": body, "git_sha": scalar.git_blob_sha(body)})
    tag = lambda category, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{category}="), F.col(c)))
    return rows.select(
        "doc_id",
        F.concat(F.lit("content:doc:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("content_id"),
        F.sha1(F.to_json(F.struct("git_sha", "lang", "source")).cast("binary")).alias("fingerprint"),
        "git_sha",
        "source",
        scalar.truncated(F.substring_index("body", "\n", 1), LABEL).alias("label"),
        scalar.truncated("body").alias("snippet"),
        F.array_compact(F.array(tag("language", "lang"), tag("module_path", "source"))).alias("tags"),
        F.regexp_count("body", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"),
        "lang",
        F.col("_metadata.file_modification_time").alias("arrived"),
    )


def read_feed(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(FEED).parquet(output)


def write_batch(documents: DataFrame, batch: int, output: str) -> None:
    """Append what a batch changes."""
    spark = documents.sparkSession
    last = first_by(shaped(documents), ["doc_id"], [F.desc("arrived"), F.desc("fingerprint")]).drop("arrived")
    if batch == 0:  # nothing is before it
        changed = last.withColumn("change", F.lit("added"))
    else:
        before = read_feed(spark, output).where(F.col("batch") < batch)
        held = before.groupBy("content_id").agg(F.max_by("fingerprint", "batch").alias("known"))
        changed = last.join(held, "content_id", "left").where("known IS NULL OR known <> fingerprint")
        changed = changed.withColumn("change", F.when(F.col("known").isNull(), "added").otherwise("changed")).drop("known")
    rows = changed.withColumn("batch", F.lit(batch).cast("long")).select(*[c.split()[0] for c in FEED.split(", ")])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "lang").parquet(output)
    wrote = {r.change: r.n for r in read_feed(spark, output).where(F.col("batch") == batch).groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
    logger.info("batch %d: %d added, %d changed", batch, wrote.get("added", 0), wrote.get("changed", 0))


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, max_files: int | None = None) -> int:
    """Take what is new in ``documents`` (a path or glob) since the checkpoint; returns the number of rows read."""
    stream = spark.readStream.schema(spark.read.parquet(documents).select("doc_id", "text", "lang", "source").schema)
    if max_files:
        stream = stream.option("maxFilesPerTrigger", max_files)
    # A file stream takes a single file only from a pattern.  The hidden column of file metadata does not go through to a batch by itself.
    pattern = documents if any(c in documents for c in "*?[{") else f"{documents.rstrip('/')[:-1]}[{documents.rstrip('/')[-1]}]"
    rows = stream.parquet(pattern).select("*", "_metadata")
    query = rows.writeStream.foreachBatch(lambda df, batch: write_batch(df, batch, output)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    read = sum(p["numInputRows"] for p in query.recentProgress)
    logger.info("read %d rows of new files in %s, wrote to %s", read, documents, output)
    return read


if __name__ == "__main__":
    from jobs.common import main

    main("content_feed", run, __doc__)
