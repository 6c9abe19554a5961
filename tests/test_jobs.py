"""The jobs over growing and changing input, and their command lines."""

from __future__ import annotations

import json
import logging
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import common, content_feed, context_packs
from jobs.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
needs_data = pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables are not here")


def arrive(spark, rows, folder, name):
    """One more file in the folder; it is written elsewhere and moved in whole."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}-{name}")
    part = next(Path(f"{folder}-{name}").glob("part-*.parquet"))
    Path(folder).mkdir(exist_ok=True)
    part.rename(Path(folder) / f"{name}.parquet")


def feed(spark, output):
    rows = content_feed.read_feed(spark, output).orderBy("batch", "doc_id").collect()
    return [(r.batch, r.doc_id, r.change, r.label) for r in rows]


@pytest.fixture
def places(tmp_path):
    return str(tmp_path / "docs"), str(tmp_path / "feed"), str(tmp_path / "checkpoint")


def test_only_what_is_new_is_taken(spark, places, caplog):
    """New and changed documents give rows; unchanged ones, and a run without new files, give none."""
    docs, out, check = places
    arrive(spark, [(1, "one\nmore", "en", "a", 8), (2, "two", None, "a", 3), (None, None, "de", None, None)], docs, "f1")
    with caplog.at_level(logging.INFO):
        assert content_feed.run(spark, docs, out, check) == 3
    first = [(0, None, "added", ""), (0, 1, "added", "one"), (0, 2, "added", "two")]
    assert feed(spark, out) == first
    assert "batch 0: 3 added, 0 changed" in caplog.text and "read 3 rows" in caplog.text
    assert content_feed.run(spark, docs, out, check) == 0 and feed(spark, out) == first
    arrive(spark, [(1, "one\nmore", "en", "a", 8), (2, "two", "fr", "a", 3), (3, "three", "en", "b", 5), (3, "three", "en", "b", 5)], docs, "f2")
    assert content_feed.run(spark, docs, out, check) == 4
    assert feed(spark, out) == [*first, (1, 2, "changed", "two"), (1, 3, "added", "three")]
    arrive(spark, [(2, "two", None, "a", 3)], docs, "f3")  # back to what it was first: a change from what it was last
    content_feed.run(spark, docs, out, check)
    assert feed(spark, out)[-1] == (2, 2, "changed", "two")


def test_a_batch_written_again_changes_nothing(spark, places):
    """What a failed or replayed batch has left is overwritten by the same rows."""
    docs, out, check = places
    arrive(spark, [(1, "a", "en", "s", 1)], docs, "f1")
    content_feed.run(spark, docs, out, check)
    arrive(spark, [(1, "b", "en", "s", 1), (2, "c", "de", "s", 1)], docs, "f2")
    content_feed.run(spark, docs, out, check)
    before = feed(spark, out)
    content_feed.write_batch(spark.read.parquet(f"{docs}/f2.parquet").select("*", "_metadata"), 1, out)
    assert feed(spark, out) == before


def test_the_newest_file_counts(spark, places):
    docs, out, check = places
    arrive(spark, [(1, "zzz old", "en", "s", 1)], docs, "f1")
    arrive(spark, [(1, "aaa new", "en", "s", 1)], docs, "f2")
    import os

    os.utime(f"{docs}/f1.parquet", (1_000_000, 1_000_000))
    content_feed.run(spark, docs, out, check)
    assert feed(spark, out) == [(0, 1, "added", "aaa new")]


def test_several_batches(spark, places):
    docs, out, check = places
    for i in range(3):
        arrive(spark, [(i, f"t{i}", "en", "s", 1), (9, f"v{i}", "en", "s", 1)], docs, f"f{i}")
    content_feed.run(spark, docs, out, check, max_files=1)
    assert [x[:3] for x in feed(spark, out)] == [(0, 0, "added"), (0, 9, "added"), (1, 1, "added"), (1, 9, "changed"), (2, 2, "added"), (2, 9, "changed")]


def test_an_empty_table(spark, places):
    docs, out, check = places
    arrive(spark, [], docs, "f1")
    content_feed.run(spark, docs, out, check)
    assert feed(spark, out) == []
    arrive(spark, [(1, "x", None, None, 1)], docs, "f2")
    content_feed.run(spark, docs, out, check)
    assert [x[1:3] for x in feed(spark, out)] == [(1, "added")]


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, name):
    got = QUERIES[name](spark, str(DATA)).toPandas()
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got)

    def rows(frame):
        return sorted([f"{v:.6f}" if isinstance(v, float) else str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v) for v in r] for r in frame[columns].astype(object).values.tolist())

    assert rows(got) == rows(want)


@needs_data
def test_packs_keep_the_budget(spark, tmp_path):
    """A pack holds at least one content and otherwise no more words than the budget; a rerun writes the same."""
    out = str(tmp_path / "packs")
    before = spark.conf.get("spark.sql.unionOutputPartitioning")
    spark.conf.set("spark.sql.unionOutputPartitioning", "true")
    n = context_packs.run(spark, str(DATA), out, k=8, budget=300, every=10)
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "true"
    spark.conf.set("spark.sql.unionOutputPartitioning", before)
    rows = context_packs.read_packs(spark, out).collect()
    assert len(rows) == n and all(r.place == 1 or r.running_words <= 300 for r in rows)
    assert len({(r.qid, r.content_id) for r in rows}) == n
    assert context_packs.run(spark, str(DATA), out, k=8, budget=300, every=10) == n
    assert sorted(context_packs.read_packs(spark, out).collect()) == sorted(rows)
    assert {p.name.split("=")[0] for p in Path(out).iterdir() if p.is_dir()} == {"label"}


def test_settings_and_session(monkeypatch, tmp_path):
    """The command line reads the config file, replaces settings and stops the session, also after a failure."""
    stopped, seen = [], {}

    class Builder:
        def appName(self, name):
            return self

        def getOrCreate(self):
            return type("Session", (), {"stop": lambda self: stopped.append(1)})()

    monkeypatch.setattr(common.SparkSession, "builder", Builder())
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"a": 1, "b": "x"}))
    common.main("content_feed", lambda spark, **s: seen.update(s), "", ["--config", str(config), "--set", "a=2", "--set", "c=/p=q"])
    assert seen == {"a": 2, "b": "x", "c": "/p=q"} and stopped == [1]
    with pytest.raises(ZeroDivisionError):
        common.main("content_feed", lambda spark, **s: 1 / 0, "", ["--config", str(config)])
    assert stopped == [1, 1]
    for job, name in ((content_feed, "content_feed"), (context_packs, "context_packs")):
        settings = json.loads(Path(common.__file__).with_name(f"{name}.json").read_text())
        assert set(settings) <= set(job.run.__code__.co_varnames[: job.run.__code__.co_argcount])


def test_hidden_settings_stay(spark, places):
    docs, out, check = places
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    arrive(spark, [(1, "x", "en", "s", 1)], docs, "f1")
    content_feed.run(spark, docs, out, check)
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
    assert content_feed.read_feed(spark, out).where(F.col("lang") == "en").count() == 1
