"""Near duplicates, fingerprints and passages against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import zstandard

from conftest_llm import words
from cuelattice.llm import bwt_dedup as bw
from cuelattice.llm import components as cc
from cuelattice.llm import edit_embedding as ee
from cuelattice.llm import jaccard_join as jj

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# ------------------------------------------------------------------ components


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(150)] + [(5000, 5001 + i) for i in range(100)] + [(7, 7), (3, 9), (9, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    want = {x: root(x) for x in list(parent)}
    got = {r.node: r.label for r in cc.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
    assert cc.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ------------------------------------------------------------------ Jaccard join


def shingles(text):
    ws = (text or "").encode().split()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def brute_join(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    n, links, parent = len(rows), [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for k in range(i):
            a, b = sets[i], sets[k]
            if a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9 and a and b:
                links[i] += 1
                links[k] += 1
                x, y = root(i), root(k)
                parent[max(x, y)] = min(x, y)
    ids = {}
    for i in range(n):
        d = rows[i][0]
        r = root(i)
        ids.setdefault(r, []).append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in ids.items()}
    return [(rows[i][0], least[root(i)], links[i]) for i in range(n)]


def order(rows):
    return sorted((d is None, d or 0, c is None, c or 0, n) for d, c, n in rows)


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(12)
    rows = [(i, words(rng, rng.randrange(0, 120), 3000), None, None, None) for i in range(60)]
    for g in range(12):
        base = words(rng, rng.randrange(6, 150), 3000).split()
        for k in range(rng.randrange(2, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9)}"
            if rng.random() < 0.3:
                copy = copy[: len(copy) - rng.randrange(0, 9)]
            rows.append((100 + g * 20 + k, " ".join(copy), None, None, None))
    return rows + [rows[70], rows[71], rows[71]]


@pytest.mark.parametrize("block", [jj.BLOCK, 900])
def test_join(spark, near_rows, odd, odd_rows, empty, block, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", block)
    docs = spark.createDataFrame(near_rows, SCHEMA).repartition(4)
    got = [(r.doc_id, r.class_id, r.n_links) for r in jj.join(docs).collect()]
    assert order(got) == order(brute_join(near_rows)) and sum(n for *_, n in got) > 100
    assert order((r.doc_id, r.class_id, r.n_links) for r in jj.join(odd).collect()) == order(brute_join(odd_rows))
    assert jj.join(empty).count() == 0


def test_keep_one(spark, near_rows, odd, odd_rows, empty):
    for docs, rows in ((spark.createDataFrame(near_rows, SCHEMA), near_rows), (odd, odd_rows)):
        kept = jj.keep_one(docs)
        assert kept.columns == docs.columns
        found = [(r.doc_id, r.text) for r in kept.collect()]
        # A class is named by its least doc_id; a null one is kept where there is no other.
        classes = brute_join([(i, t) for i, (_, t, *_) in enumerate(rows)])
        groups = {}
        for (i, c, _) in classes:
            groups.setdefault(c, []).append(rows[i])
        assert len(found) == len(groups)
        for members in groups.values():
            ids = [m[0] for m in members]
            want = min((i for i in ids if i is not None), default=None)
            assert sum((want, m[1]) in found for m in {(m[0], m[1]) for m in members if m[0] == want}) == 1
    assert jj.keep_one(empty).count() == 0


def test_pruning_keeps_what_reaches_the_threshold():
    """The bound itself: dropping needs a posterior under the tolerance."""
    need = jj.least_matches()
    rng = np.random.default_rng(2)
    assert need[jj.HASHES] > 0.4 * jj.HASHES
    alive = np.ones(200_000, bool)
    matches = np.zeros(len(alive), int)
    for n in range(jj.STEP, jj.HASHES + 1, jj.STEP):
        matches += rng.binomial(jj.STEP, 0.8, len(alive))
        alive &= matches >= need[n]
    assert alive.all()


# ------------------------------------------------------------------ edit embedding


def walk(text):
    """One walk, step by step."""
    moves, out, i = ee._moves(), [], 0
    classes = [1 + ord(c) % 255 for c in text] + [0]
    for j in range(ee.STEPS * len(text)):
        out.append(classes[i])
        i += int(moves[j % ee.PERIOD][classes[i]])
    return out


def test_fingerprints_are_sampled_walks():
    rng = random.Random(3)
    texts = ["", "a", "ab" * 40, words(rng, 50), words(rng, 300), "🙂é" * 30, "a"]
    prints = ee.fingerprints(texts)
    for t, p in zip(texts, prints, strict=True):
        steps = ee.sampled_steps(ee.STEPS * len(t))
        w = walk(t)
        salt = ee.mix64(np.arange(len(steps), dtype=np.uint64) + np.uint64(ee.SEED))
        kept = np.array([w[s] for s in steps], np.uint64)
        digits = (ee.mix64(kept + salt) >> np.uint64(40)) & np.uint64(15)
        assert p == "".join("0123456789abcdef"[int(d)] for d in digits)
    assert prints[1] == prints[6]


def test_likeness_follows_edits():
    rng = random.Random(9)
    near, far = [], []
    for _ in range(30):
        t = words(rng, 200)
        edited = list(t)
        for _ in range(5):
            edited[rng.randrange(len(edited))] = "z"
        other = words(rng, 200)
        a, b, c = ee.fingerprints([t, "".join(edited), other])
        near.append(ee.likeness(a, b, len(t), len(edited)))
        far.append(ee.likeness(a, c, len(t), len(other)))
    assert np.mean(near) > 0.6 and np.mean(far) < 0.3 and ee.likeness("", "", 0, 0) == 1


def brute_pairs(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for i, (d, t, *_) in enumerate(ordered):
        t, f = t or "", ordered[(i + 1) % len(ordered)][1] or ""
        e = t[: len(t) - len(t) // 3] + f[: len(t) // 3]
        p, q, r = ee.fingerprints([t, e, f])
        out.append((d is None, d or 0, len(t), hashlib.sha256(e.encode()).hexdigest(), p, q, round(ee.likeness(p, q, len(t), len(e)), 9), round(ee.likeness(p, r, len(t), len(f)), 9)))
    return sorted(out)


def pair_rows(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect())


def test_pairs(spark, odd, odd_rows, empty, near_rows):
    assert pair_rows(ee.fingerprint_pairs(odd)) == brute_pairs(odd_rows)
    assert pair_rows(ee.fingerprint_pairs(spark.createDataFrame(near_rows, SCHEMA))) == brute_pairs(near_rows)
    one = [(5, "only me", None, None, None)]
    assert pair_rows(ee.fingerprint_pairs(spark.createDataFrame(one, SCHEMA))) == brute_pairs(one)
    nulls = [(None, "a" * 9, None, None, None), (None, "b" * 9, None, None, None)]
    assert pair_rows(ee.fingerprint_pairs(spark.createDataFrame(nulls, SCHEMA))) == brute_pairs(nulls)
    assert ee.fingerprint_pairs(empty).count() == 0


def brute_near(rows):
    texts = [t or "" for _, t, *_ in rows]
    prints = dict(zip(texts, ee.fingerprints(texts), strict=True))
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(texts):
        for k in range(i):
            b = texts[k]
            if a == b or a and b and ee.likeness(prints[a], prints[b], len(a), len(b)) >= ee.NEAR:
                links[i] += 1
                links[k] += 1
                x, y = root(i), root(k)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, least.get(root(i)), links[i]) for i, (d, *_) in enumerate(rows)]


@pytest.mark.parametrize("block", [ee.BLOCK, 3000])
def test_near_links(spark, near_rows, odd, odd_rows, empty, block, monkeypatch):
    monkeypatch.setattr(ee, "BLOCK", block)
    for docs, rows in ((spark.createDataFrame(near_rows, SCHEMA), near_rows), (odd, odd_rows)):
        got = order((r.doc_id, r.class_id, r.n_links) for r in ee.near_links(docs).collect())
        want = order(brute_near(rows))
        assert sum(n for *_, n in got) >= 0.97 * sum(n for *_, n in want) and len(got) == len(want)
        assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.9 * len(want)
    assert ee.near_links(empty).count() == 0


def full_distance(a, b):
    """Share of equal steps of two whole walks over the longer text's steps: no samples, no hashes."""
    x, y, n = walk(a), walk(b), 2 * max(len(a), len(b))
    return sum(p == q for p, q in zip(x[:n], y[:n], strict=False)) / n


def test_likeness_estimates_the_whole_walk():
    rng = random.Random(21)
    errors = []
    for i in range(60):
        t = words(rng, rng.randrange(80, 400))
        e = list(t)
        for _ in range(rng.choice([0, 2, 10, 60])):
            e[rng.randrange(len(e))] = rng.choice("qxyz ")
        e = "".join(e)
        p, q = ee.fingerprints([t, e])
        errors.append(ee.likeness(p, q, len(t), len(e)) - full_distance(t, e))
    assert abs(np.mean(errors)) < 0.03 and max(map(abs, errors)) < 0.2


def test_query_finds_planted_near_copies(spark, tmp_path):
    """Classes and links beside the fingerprints; recall of planted near copies, precision against unrelated texts."""
    rng = random.Random(5)
    rows, pairs = [], []
    for i in range(60):
        t = words(rng, 200 + 10 * i, 3000)
        e = t.split()
        for k in rng.sample(range(len(e)), len(e) // 60):
            e[k] = "changed"
        rows += [(2 * i, t, "en", "s", 1), (2 * i + 1, " ".join(e), "en", "s", 1)]
        pairs.append((2 * i, 2 * i + 1))
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in ee.query(spark, str(tmp_path)).collect()}
    prints = {d: ee.fingerprints([t])[0] for d, t, *_ in rows}
    near = [(a, b) for a, b in pairs if ee.likeness(prints[a], prints[b], len(rows[a][1]), len(rows[b][1])) >= ee.NEAR]
    found = [(a, b) for a, b in near if got[a].class_id == got[b].class_id == a and got[a].n_links == 1]
    assert len(near) >= 30 and len(found) >= 0.95 * len(near)
    assert all(r.class_id in (d, d - d % 2) for d, r in got.items()) and all(got[d].fingerprint == p for d, p in prints.items())


# ------------------------------------------------------------------ passages


def brute_removal(rows, n=50):
    first = {}
    for d, t, *_ in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - n + 1):
                w = b[i : i + n]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if d is not None:
            for i in range(len(b) - n + 1):
                if first[b[i : i + n]] < d:
                    gone[i : i + n] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d is None, d or 0, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


def removed(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_passages(spark, odd, odd_rows, empty):
    assert removed(bw.dedup(odd)) == brute_removal(odd_rows)
    rng = random.Random(21)
    pool = ["".join(rng.choice("ab \n") for _ in range(rng.randrange(40, 200))) for _ in range(25)]
    rows = []
    for i in rng.sample(range(500), 120):
        text = "".join(rng.choice(pool)[rng.randrange(30) :] + rng.choice(["", "é", "\0", words(rng, 3)]) for _ in range(rng.randrange(0, 6)))
        rows.append((i, text, None, None, None))
    rows += [(900, "a" * 5000, None, None, None), (901, "b" + "a" * 300, None, None, None), (902, "ab" * 400, None, None, None), (903, "ba" * 100, None, None, None)]
    assert removed(bw.dedup(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute_removal(rows)
    assert bw.dedup(empty).count() == 0


def test_expand_finds_all_boundaries():
    rng = random.Random(4)
    for length in (8, 14, 50):
        for _ in range(15):
            parts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 90))) for _ in range(rng.randrange(1, 6))]
            symbols = np.array([c for p in parts for c in [*(ord(x) for x in p), 0]], np.uint16)
            suffixes, edge = bw.expand(symbols, length)
            flat = symbols.tolist() + [0] * length
            heads = [tuple(flat[s : s + length]) for s in suffixes]
            assert sorted(suffixes) == list(range(len(symbols)))
            for i in range(1, len(heads)):
                if 0 not in heads[i] and 0 not in heads[i - 1]:
                    assert edge[i] == (heads[i] != heads[i - 1])
                elif heads[i] != heads[i - 1] and (0 in heads[i]) != (0 in heads[i - 1]):
                    assert edge[i]


@pytest.mark.parametrize("part, bucket", [(1 << 10, 1 << 30), (1 << 30, 1 << 10), (3000, 3000)])
def test_tiny_partitions_remove_the_same(odd, odd_rows, monkeypatch, part, bucket):
    """Many more partitions or buckets than the session has, and only one bucket."""
    monkeypatch.setattr(bw, "PART_BYTES", part)
    monkeypatch.setattr(bw, "BUCKET_BYTES", bucket)
    assert removed(bw.dedup(odd)) == brute_removal(odd_rows)


def test_hot_anchors_are_parted(odd, odd_rows):
    """Every anchor of two texts or more, by the second one."""
    assert removed(bw.dedup(odd, hot=1)) == brute_removal(odd_rows)
    text = (b"some words that come again and again, " * 9)[:300]
    anchor, starts, sizes = bw._anchor_runs(text)
    cut = bw._parted(text, anchor.tolist(), starts.tolist(), sizes.tolist(), [True] * len(anchor))
    assert sum(n for _, _, n in cut) == 251 and sorted(s for _, s, _ in cut)[0] == 0
    windows = {}
    for key, s, n in cut:
        for i in range(s, s + n):
            assert windows.setdefault(text[i : i + 50], key) == key  # equal windows meet


def test_small_blocks(monkeypatch, odd, odd_rows):
    monkeypatch.setattr(bw, "BLOCK", 300)
    monkeypatch.setattr(bw, "LONGEST", 64)
    assert removed(bw.dedup(odd)) == brute_removal(odd_rows)


def test_very_hot_anchors_are_parted_further(odd, odd_rows):
    """Every anchor, by all further ones that requests know."""
    assert removed(bw.dedup(odd, hot=0)) == brute_removal(odd_rows)


def test_a_passage_everywhere_takes_bounded_transforms(monkeypatch):
    """Very many surroundings of one passage, all under one anchor: the blocks of a bucket stay small, and its answers right."""
    rng = random.Random(8)
    around = lambda n: bytes(rng.choice(b"abcd") for _ in range(n))
    snippets = sorted({around(rng.randrange(0, 30)) + b"a passage that stands in all documents, 52 bytes long" + around(rng.randrange(0, 30)) for _ in range(400)})
    docs = np.array([rng.randrange(1000) for _ in snippets], np.int64)
    want: dict[bytes, int] = {}
    windows = [[s[i : i + 50] for i in range(len(s) - 49)] for s in snippets]
    for own, doc in zip(windows, docs.tolist(), strict=True):
        for w in own:
            want[w] = min(want.get(w, doc), doc)
    most, expand = [], bw.expand
    monkeypatch.setattr(bw, "BLOCK", 2000)
    monkeypatch.setattr(bw, "expand", lambda symbols, length=50: most.append(len(symbols)) or expand(symbols, length))
    row = (0, 7, zstandard.ZstdCompressor().compress(b"".join(snippets)), bw.pack(np.array([len(s) for s in snippets])), np.full(len(snippets), 5, np.uint64).tobytes(), docs.tobytes(), b"", b"")
    (batch,) = bw._answer(iter([bw._batch([row], bw.SNIPPETS)]))
    values, lengths = bw.expand_arrays(batch.column(2)[0].as_py())
    assert np.repeat(values, lengths).tolist() == [want[w] for own in windows for w in own]
    assert len(most) > 5 and max(most) <= 4000


@pytest.mark.parametrize("n_chars", [500, 2000, 3800])
@pytest.mark.parametrize("where", [0.0, 0.5, 1.0])
def test_bands_propose_near_texts_wherever_they_differ(n_chars, where):
    """Texts with a replaced head, middle or tail that are near by their likeness share a band."""
    rng = random.Random(n_chars)
    text = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(n // 3 + 1))[:n]
    near = proposed = 0
    for i in range(80):
        t, k = text(n_chars), n_chars // (20 if i % 2 else 10)
        at = int((n_chars - k) * where)
        e = t[:at] + text(k) + t[at + k :]
        p, q = ee.fingerprints([t, e])
        if ee.likeness(p, q, len(t), len(e)) >= ee.NEAR:
            near += 1
            proposed += not set(ee.band_values(p, len(t))).isdisjoint(ee.band_values(q, len(e)))
    assert near >= 30 and proposed >= 0.9 * near, (near, proposed)
