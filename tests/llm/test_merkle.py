"""The Merkle manifest against trees built in one piece."""

from __future__ import annotations

from hashlib import sha256
from pathlib import Path

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuelattice.llm import merkle_manifest as mm

DATA = Path("/root/testdata/sf0.001")


def digest(*texts):
    return sha256("".join(texts).encode()).hexdigest()


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def way(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 3 * 3
        out.append((level[first:i], level[i + 1 : first + 3]))
        i //= 3
    return out


def leaf_of(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, row.text)))


def plain(rows):
    """(doc_id, leaf, subroot, root, siblings) of each row; equal keys follow by digest."""
    trees = {}
    for r in rows:
        trees.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf_of(r), r.doc_id))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: levels_of([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in names}
    over = levels_of([built[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, x in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            siblings = "".join("".join(b + a) for b, a in way(built[s], i) + way(over, k))
            out.append((x[3], x[2], built[s][-1][0], over[-1][0], siblings))
    return out


def got_of(out):
    rows = out.select("carried.doc_id", "leaf", "subroot", "root", "siblings", mm.fold(F.col("leaf"), F.col("siblings"), F.col("steps")).alias("folded")).collect()
    assert all(r.folded == r.root for r in rows)
    return [tuple(r)[:5] for r in rows]


def same(got, want):
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(got, key=key) == sorted(want, key=key)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 120), st.lists(st.integers(1, 119), max_size=8), st.integers(1, 5))
def test_runs_cut_anywhere_give_the_tree(n, cuts, levels):
    """Stacks of unaligned runs and the merge of their edges, within one block, against the tree in one piece."""
    leaves = [sha256(str(i).encode()).digest() for i in range(min(n, 3**levels))]
    counts = mm.sizes(len(leaves), levels)
    borders = sorted({0, len(leaves), *(c for c in cuts if c < len(leaves))})
    edges, stacks = [], []
    for lo, hi in zip(borders, borders[1:], strict=False):
        stack = mm.Mountain(lo, counts)
        for d in leaves[lo:hi]:
            stack.push(d)
        stacks.append((lo, hi, stack))
        edges += stack.close()
    found = mm.merge(edges, counts)
    whole = levels_of([d.hex() for d in leaves])
    assert found[len(counts) - 1, 0].hex() == whole[-1][0]
    assert all(whole[level][at] == d.hex() for (level, at), d in found.items())
    for lo, hi, _ in stacks:
        assert set(mm.beside(lo, hi, counts)) <= set(found)


@pytest.mark.parametrize("levels, chunk", [(1, 2), (2, 5), (3, 4), (12, 8192)])
def test_small_blocks_and_runs(spark, monkeypatch, levels, chunk):
    """Several rounds of blocks, and runs of a few leaves."""
    monkeypatch.setattr(mm, "CHUNK", chunk)
    docs = spark.range(100).selectExpr("id AS doc_id", "concat('text ', id) AS text", "'en' AS lang", "CASE WHEN id < 60 THEN 'a' WHEN id = 61 THEN null ELSE concat('é', id % 4) END AS source", "id AS n_chars")
    same(got_of(mm.manifest(docs, levels=levels)), plain(docs.collect()))


def test_odd_rows(spark, odd):
    same(got_of(mm.manifest(odd)), plain(odd.collect()))


def test_other_columns(spark):
    """Any columns of strings or integers, any key."""
    df = spark.createDataFrame([("x", 1), ("x", None), ("y", 3)], "k string, carried int")
    rows = mm.manifest(df, columns=["k", "carried"], by="k", order="carried").collect()
    assert {(r.carried.k, r.carried.carried) for r in rows} == {("x", 1), ("x", None), ("y", 3)}
    assert {r.leaf for r in rows} == {digest("1:x", "1:1"), digest("1:x", "-"), digest("1:y", "1:3")}


def test_empty(spark, empty):
    assert mm.manifest(empty).collect() == []


def test_equal_rows_are_spread(spark):
    """A row that stands many times is dealt to many tasks."""
    docs = spark.range(0, 3000, 1, 8).selectExpr("1L AS doc_id", "'t' AS text", "'en' AS lang", "'a' AS source", "1L AS n_chars")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = mm.manifest(docs)
    assert out.count() == 3000 and out.select("root").distinct().count() == 1
    runs = mm.runs_of(docs.select(F.lit("=a").alias("tree"), F.col("doc_id").alias("ord"), F.unhex(mm.leaf_digest(F.col("text"))).alias("leaf"), F.struct("doc_id").alias("carried")))
    try:
        assert runs.agg(F.max("n")).first()[0] < 3000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_tampering_is_found(spark, tmp_path):
    rows = [(i, f"line one\nline {i}" if i % 3 else f"no line {i}" if i else None, "en", "s", 3) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    from zlib import crc32

    for r in mm.query(spark, str(tmp_path)).collect():
        text = rows[r.doc_id][1]
        touched = crc32(str(r.doc_id).encode()) % 2 == 0 and text is not None and "\n" in text
        assert r.verified is (not touched) and (r.folded_root == r.root) is r.verified


@pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables are not here")
def test_against_sql(spark):
    got = mm.query(spark, str(DATA)).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(mm.ORACLE).df()
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, want[columns].values.tolist()))
