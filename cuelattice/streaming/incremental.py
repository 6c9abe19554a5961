"""Continuous indexing: a stream of file versions into a store.

The stream carries (source_file, content, version); a null content says that the
file is gone.  :func:`ordered` keeps the last version and its blob sha of every
file as Spark's own state, so that an older version that arrives late, in
whatever micro-batch, or a version that comes again changes nothing, and what is
left goes through the incremental indexer.  The state has one small row a file;
contents are not kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..index import index_files
from ..sources.store import Store

SCHEMA = "source_file string, content binary, version long"
CHANGES = "source_file string, content binary, version long, deleted boolean"


def file_versions(spark, folder: str, max_files: int | None = None) -> DataFrame:
    """The stream of Parquet files that appear in a folder."""
    reader = spark.readStream.schema(SCHEMA)
    return (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).parquet(folder)


def _sha(content: bytes | None) -> str:
    return "" if content is None else hashlib.sha1(b"blob %d\0" % len(content) + content).hexdigest()  # noqa: S324 - a blob's name


def _newest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The last version of a file, if it is newer than the one known and of other content."""
    known = state.get if state.exists else None
    best = None
    for frame in frames:
        for content, version in zip(frame["content"], frame["version"], strict=True):
            if pd.isna(version):
                continue
            content = None if content is None else bytes(content)
            found = (int(version), _sha(content))
            if best is None or found > best[0]:
                best = (found, content)
    if best is None or known is not None and best[0] <= tuple(known):
        return
    (version, sha), content = best
    state.update((version, sha))
    if sha != (known[1] if known is not None else ""):
        yield pd.DataFrame({"source_file": [key[0]], "content": [content], "version": [version], "deleted": [content is None]})


def ordered(stream: DataFrame) -> DataFrame:
    """The changes of a stream of versions: each file's newest content where it is news, or that it is deleted.

    Rows of a batch with one version count by their blob sha; rows without a version or a file name are left out.
    """
    rows = stream.where("source_file IS NOT NULL").select("source_file", "content", "version")
    return rows.groupBy("source_file").applyInPandasWithState(_newest, CHANGES, "version long, sha string", "update", GroupStateTimeout.NoTimeout)


def start(
    stream: DataFrame,
    store: Store,
    embed: Callable[[Column], Column],
    model: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    def apply(batch: DataFrame, _: int) -> None:
        batch = batch.persist()  # the state is read and written once
        try:
            index_files(store, batch.where("NOT deleted").select("source_file", "content"), embed, model, removed=batch.where("deleted").select("source_file"))
        finally:
            batch.unpersist()

    writer = ordered(stream).writeStream.foreachBatch(apply).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
