"""Every query of the library against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from cuelattice.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame, columns):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else repr(v) for v in r) for r in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    got = QUERIES[name](spark, str(DATA)).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = sql.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_every_document_has_its_candidates(spark, sql):
    """Every document with a source is a current node, and rows grow with edges: a document's topic is one candidate."""
    got = QUERIES["walk_candidates_all"](spark, str(DATA)).toPandas()
    sources = sql.sql("SELECT 'content:doc:' || doc_id AS id FROM documents WHERE source IS NOT NULL").df()
    assert set(got.qid) >= set(sources.id) and (got.branch == 1).sum() == len(sources)


def test_every_vector_walks(spark, sql):
    """Vectors from the 100th on walk too."""
    got = QUERIES["reconstruct_rule"](spark, str(DATA)).toPandas()
    ids = {int(i) for i in got.qid}
    everything = {i for (i,) in sql.sql("SELECT vec_id FROM embeddings").fetchall()}
    assert ids <= everything and len(ids) > 100 and max(ids) >= 100


def test_the_whole_package_is_extracted(spark, monkeypatch):
    """Each source file of the package is parsed."""
    import cuelattice
    from cuelattice.operators import extract

    seen, parse = [], extract.parse_files
    monkeypatch.setattr(extract, "parse_files", lambda scanned: parse(seen.append(scanned) or scanned))
    assert QUERIES["extract_sources"](spark, str(DATA)).count()
    assert seen[0].count() == len(list(Path(cuelattice.__file__).parent.rglob("*.py")))


def test_the_script_of_walks_is_found_once(spark, monkeypatch):
    """Every hop reads the decisions, so they come from tables and not from the joins that they are made by."""
    from cuelattice.operators import walk

    plans, planner = [], walk.scripted_planner
    monkeypatch.setattr(walk, "scripted_planner", lambda decisions: planner(plans.append(decisions._jdf.queryExecution().analyzed().toString()) or decisions))
    assert QUERIES["reconstruct_scripted"](spark, str(DATA)).count()
    assert len(plans) == 1 and "Join" not in plans[0]
