"""Jaccard self-join on word shingles with Bayesian candidate pruning.

Documents are sets of five-word shingles (64-bit hashes of them).  Documents
with the same set form a class with one representative, so copies are never
paired.  Representatives get MinHash values; those that agree on a band of
values are tied to the least of the band's representatives, and the connected
components of these ties are the clusters that may hold links.  A cluster is
dealt to blocks of bounded weight and each pair of blocks goes to one task:

* pairs that agree on a band are candidates;
* their MinHash values are compared in steps; a pair is dropped once the
  posterior probability (uniform prior) that its similarity reaches the
  threshold falls below ``TOLERANCE``;
* what is left is verified exactly, on the whole sets.

A task gives link counts and a spanning forest of its links, never the pairs,
so rows stay in proportion to documents.

At similarity 0.8 a pair agrees on no band with probability 3e-6, and pruning
drops it with a smaller one.

Defined cases: null text counts as empty; documents without words have no
shingles and are copies of each other; with one to four words all words are the
one shingle; rows with equal doc_id are rows of their own; further columns are
ignored by :func:`join` and kept by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, TokenHashes, column, documents, free_name, mix64, slices, text_or_empty
from .components import components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
TOLERANCE = 1e-9
STEP = 16
#: Shingles (and 100 for each document) of a block.
BLOCK = 400_000

_RANDOM = np.random.Generator(np.random.PCG64(9))
_MULTIPLY = _RANDOM.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_PLACE = _RANDOM.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_HASHES = TokenHashes()


def shingle_hashes(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    split = [t.split() for t in texts]
    sizes = [len(w) for w in split]
    flat = np.array([_HASHES[w] for ws in split for w in ws], np.int64).view(np.uint64)
    n = max(0, len(flat) - words + 1)
    total = np.zeros(n, np.uint64)
    for k in range(words):
        total += mix64(flat[k : n + k] ^ _PLACE[k]) * _PLACE[k]
    total = mix64(total)
    out, at = [], 0
    for ws, size in zip(split, sizes, strict=True):
        if size >= words:
            out.append(np.unique(total[at : at + size - words + 1]))
        elif size:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), seed=1)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES values for each set (all ones for an empty one)."""
    out = np.full((len(sets), HASHES), 0xFFFFFFFF, np.uint32)
    some = [i for i, s in enumerate(sets) if len(s)]
    if not some:
        return out
    flat = (np.concatenate([sets[i] for i in some]) >> np.uint64(32)).astype(np.uint32)
    sizes = np.array([len(sets[i]) for i in some])
    starts = np.cumsum(sizes) - sizes
    work = np.empty_like(flat)
    for h in range(HASHES):
        np.multiply(flat, _MULTIPLY[h], out=work)
        np.add(work, _ADD[h], out=work)
        out[some, h] = np.minimum.reduceat(work, starts)
    return out


@lru_cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of compared values: the least matches at which a pair stays.

    With a uniform prior and m of n matches, the posterior probability of a
    similarity of ``threshold`` or more is that of at most m successes among
    n + 1 trials.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        sets = shingle_hashes(column(b, "text"))
        keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        values = [row.tobytes() for row in minhash(sets)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(values, pa.binary())],
            names=["doc_id", "text_hash", "key", "size", "minhash"],
        )


def _bands(row: np.ndarray) -> np.ndarray:
    """One 64-bit value for each band of each row of MinHash values."""
    total = np.zeros((len(row), BANDS), np.uint64)
    for r in range(ROWS):
        total = mix64(total + row[:, r::ROWS].astype(np.uint64) + np.uint64(r + 1))
    return total


class _Block:
    """Documents of one block in a task."""

    def __init__(self, rows: list[tuple]):
        rows = list({r[0]: r for r in rows}.values())  # a key once, though its text may have come in several rows
        self.keys = [r[0] for r in rows]
        self.weights = np.array([r[1] for r in rows], np.int64)
        self.sets = shingle_hashes([r[2] for r in rows])
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.minhash = minhash(self.sets)
        self.bands = _bands(self.minhash)


def _links(a: _Block, b: _Block) -> Iterator[tuple[int, np.ndarray]]:
    """For each document of a: the documents of b linked to it (if a is b, those that follow)."""
    same = a is b
    vocabulary, ids = np.unique(np.concatenate([*a.sets, *([] if same else b.sets)]), return_inverse=True)
    ends = np.cumsum([len(s) for s in a.sets] + ([] if same else [len(s) for s in b.sets]))
    parts = np.split(ids, ends[:-1])
    mine, theirs = parts[: len(a.sets)], parts if same else parts[len(a.sets) :]
    flags = np.zeros(len(vocabulary), bool)
    need = least_matches()
    for i in range(len(a.keys)):
        lo = i + 1 if same else 0
        small, large = np.minimum(b.sizes[lo:], a.sizes[i]), np.maximum(b.sizes[lo:], a.sizes[i])
        found = np.flatnonzero((small >= THRESHOLD * large) & (b.bands[lo:] == a.bands[i]).any(1)) + lo
        matches = np.zeros(len(found), np.int64)
        for n in range(STEP, HASHES + 1, STEP):
            if not len(found):
                break
            matches += (b.minhash[found, n - STEP : n] == a.minhash[i, n - STEP : n]).sum(1)
            stay = matches >= need[n]
            found, matches = found[stay], matches[stay]
        if not len(found):
            continue
        flags[mine[i]] = True
        sizes = b.sizes[found]
        both = np.add.reduceat(flags[np.concatenate([theirs[j] for j in found])], np.cumsum(sizes) - sizes, dtype=np.int64)
        flags[mine[i]] = False
        linked = found[both >= THRESHOLD * (a.sizes[i] + sizes - both) - 1e-9]
        if len(linked):
            yield i, linked


def _join_blocks(first: int, second: int, rows: list[tuple]) -> list[tuple[bytes, int, bytes]]:
    """(key, links, a key of its tree) of the documents with links in a pair of blocks; rows are (key, weight, text, block)."""
    a = _Block([r for r in rows if r[3] == first])
    b = a if first == second else _Block([r for r in rows if r[3] == second])
    offset = 0 if a is b else len(a.keys)
    n = len(a.keys) + (0 if a is b else len(b.keys))
    counts, parent = np.zeros(n, np.int64), list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    if not a.keys or not b.keys:
        return []
    for i, linked in _links(a, b):
        counts[i] += b.weights[linked].sum()
        counts[linked + offset] += a.weights[i]
        for j in linked.tolist():
            x, y = root(i), root(j + offset)
            if x != y:
                parent[max(x, y)] = min(x, y)
    keys = a.keys + ([] if a is b else b.keys)
    return [(keys[x], int(counts[x]), keys[root(x)]) for x in np.flatnonzero(counts).tolist()]


def _join_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (label, first, second): one pair of blocks after the other."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        keys, counts, trees = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(trees, pa.binary())],
            names=["key", "links", "tree"],
        )

    at, held, done = None, [], []
    for b in slices(batches):
        names = ["label", "first", "second", "key", "weight", "text", "block"]
        for label, first, second, *row in zip(*(column(b, n) for n in names), strict=True):
            if at != (label, first, second):
                if held:
                    done += _join_blocks(at[1], at[2], held)
                at, held = (label, first, second), []
            held.append(tuple(row))
        if len(done) > 10_000:
            yield out(done)
            done = []
    if held:
        done += _join_blocks(at[1], at[2], held)
    yield out(done)


def _hashed(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, key), and one row for each key: rep (doc_id, text_hash), copies, label, links."""
    scratch = Scratch(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = _hashed(docs).mapInArrow(_signatures, f"doc_id {kind}, text_hash long, key binary, size long, minhash binary")
    signed = scratch.table(signed, "minhash")
    sets = signed.groupBy("key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "size", "minhash")).alias("rep"),
        F.count(F.lit(1)).alias("copies"),
    )
    sets = scratch.table(sets, "sets")
    # Ties: of those that agree on a band, each to the least.
    width = 4 * ROWS
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.xxhash64(i, F.substring(F.col("rep.minhash"), i * width + 1, F.lit(width))),
    )
    banded = sets.where("rep.size > 0").select("key", F.explode(bands).alias("band"))
    least = banded.groupBy("band").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least <> most").select("band", "least")
    ties = banded.join(least, "band").where("key <> least").select(F.col("key").alias("u"), F.col("least").alias("v"))
    clusters = components(ties).withColumnRenamed("node", "key").withColumnRenamed("label", "cluster")
    members = scratch.table(sets.join(clusters, "key").select("key", "copies", "cluster", "rep.doc_id", "rep.text_hash", "rep.size"), "members")
    blocks = members.groupBy("cluster").agg(F.ceil(F.sum(F.col("size") + 100) / BLOCK).alias("blocks"))
    members = members.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    texts = _hashed(docs).alias("d").join(
        members.alias("m"),
        F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.text_hash") == F.col("m.text_hash")),
    )
    other = F.explode(F.transform(F.sequence(F.lit(0), F.col("m.blocks").cast("int") - 1), lambda i: i)).alias("other")
    dealt = texts.select(
        F.col("m.cluster").alias("label"),
        other,
        F.col("m.block").alias("block"),
        F.col("m.key").alias("key"),
        F.col("m.copies").alias("weight"),
        F.col("d.text").alias("text"),
    )
    dealt = dealt.select(
        "label",
        F.least("block", "other").alias("first"),
        F.greatest("block", "other").alias("second"),
        "key",
        "weight",
        "text",
        "block",
    )
    dealt = dealt.repartition("label", "first", "second").sortWithinPartitions("label", "first", "second", "key")
    found = scratch.table(dealt.mapInArrow(_join_tasks, "key binary, links long, tree binary"), "links")
    trees = components(found.select(F.col("key").alias("u"), F.col("tree").alias("v"))).withColumnRenamed("node", "key")
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    sets = sets.join(trees, "key", "left").join(counts, "key", "left")
    sets = sets.select(
        "key",
        F.struct("rep.no_id", "rep.doc_id", "rep.text_hash").alias("rep"),
        "copies",
        F.coalesce("label", "key").alias("label"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    sets = scratch.table(sets, "classes")
    scratch.close(signed, sets)
    return signed.select("doc_id", "text_hash", "key"), sets


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and n_links of every row.

    A class is a connected component of links, named by its least doc_id;
    n_links counts the other rows with a similarity of THRESHOLD or more,
    copies included.
    """
    rows, sets = _classes(docs)
    named = sets.groupBy("label").agg(F.min("rep.doc_id").alias("class_id"))
    sets = sets.join(named, "label").select("key", "class_id", "n_links")
    return rows.join(sets, "key").select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows without near duplicates: of each class the row with the least doc_id (nulls last)."""
    _, sets = _classes(docs)
    kept = sets.groupBy("label").agg(F.min("rep").alias("rep"))
    # Ids as text that is never null: the join and the removal of repeated rows then share one exchange of the texts.
    name = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    doc = free_name("doc", docs.columns)
    text = free_name("text_hash", [*docs.columns, doc])
    kept = kept.select(name(F.col("rep.doc_id")).alias(doc), F.col("rep.text_hash").alias(text))
    rows = docs.withColumns({doc: name(F.col("doc_id")), text: F.xxhash64(text_or_empty())})
    rows = rows.join(kept, [doc, text]).dropDuplicates([doc, text])
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM split),
items AS (SELECT doc_id, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE n >= 0.8 * (len(p.s) + len(q.s) - n) - 1e-9
  UNION ALL
  SELECT p.doc_id, q.doc_id FROM sets p JOIN sets q ON p.doc_id <> q.doc_id WHERE len(p.s) = 0 AND len(q.s) = 0),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT r.a AS doc_id, min(r.b) AS class_id, (SELECT count(*) FROM links l WHERE l.a = r.a) AS n_links
FROM reach r GROUP BY r.a
"""
