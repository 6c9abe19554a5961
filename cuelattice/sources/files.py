"""Python files of a repository as rows, and their bytes.

The driver walks the tree (names alone), executors read the files; the tree
must lie on a path that all of them see.  Spark's own file source is not used:
it leaves out names that begin with an underscore, such as ``__init__.py``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Folders that are never walked, besides those whose name begins with a dot.
SKIP = {"venv", "__pycache__", "node_modules", "build", "dist"}


def discover(root: str | Path) -> list[str]:
    """Relative posix paths of Python files, sorted; pruned folders are not entered."""
    root, out = Path(root).resolve(), []
    for folder, names, files in os.walk(root):
        names[:] = [n for n in names if n not in SKIP and not n.startswith(".")]
        out += [(Path(folder) / f).relative_to(root).as_posix() for f in files if f.endswith(".py")]
    return sorted(out)


def scan(spark: SparkSession, root: str | Path) -> DataFrame:
    """(source_file, content) of a repository's Python files."""
    base = str(Path(root).resolve())
    paths = spark.createDataFrame([(p,) for p in discover(root)], "source_file string")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"source_file": frame["source_file"], "content": [Path(base, p).read_bytes() for p in frame["source_file"]]})

    return paths.mapInPandas(read, "source_file string, content binary")
