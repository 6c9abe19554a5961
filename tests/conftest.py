from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

from helpers import NOW  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def make_graph(spark):
    """A graph from short lists: (id, type, **columns) and (source, target, type)."""
    from cuelattice.operators.graph import Graph
    from cuelattice.schema import EDGES, NODES

    def make(nodes, edges):
        rows = []
        for i, (node_id, node_type, more) in enumerate(nodes):
            row = {"id": node_id, "node_type": node_type, "status": "active", "indexed_at": NOW, "source_file": "a.py", "node_seq": i, **more}
            if node_type == "content":
                row = {"kind": "function", "memory_layer": "semantic", "body": node_id, **row}
            rows.append(tuple(row.get(f.name) for f in NODES))
        links = [(s, t, k, "a.py", None, NOW, i) for i, (s, t, k) in enumerate(edges)]
        return Graph(spark.createDataFrame(rows, NODES), spark.createDataFrame(links, EDGES))

    return make
