from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelattice.llm import suffix_tree as x

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_model(texts, most=x.DEPTH):
    """The model of the docstring with dictionaries, over all words: a function of one text, and the number of states."""
    lists = [t.encode().lower().split() + ["$"] for h, t in texts if not h]
    c = Counter(w for ws in lists for w in ws)
    total, kinds, d = sum(c.values()), len(c), x.DISCOUNT
    states, depth = [], 0

    def prob(history, s, level):
        p = (c[s] - d) / total if c[s] else d * kinds / total if total else 1.0
        for k, found in enumerate(states[:level], 1):
            if k <= len(history) and history[-k:] in found:
                share, left = found[history[-k:]]
                p = share.get(s, 0.0) + left * p
        return p

    while depth < most:
        depth += 1
        follow, new = defaultdict(Counter), {}
        for ws in lists:
            for i in range(depth, len(ws)):
                follow[tuple(ws[i - depth : i])][ws[i]] += 1
        for ctx, after in follow.items():
            n = sum(after.values())
            if n < 2:
                continue
            listed = {s: m for s, m in after.items() if m >= 2}
            parent = {s: prob(ctx, s, depth - 1) for s in listed}
            gain, rest, k = sum(m * math.log(m / n / parent[s]) for s, m in listed.items()), n - sum(listed.values()), len(listed)
            if rest:
                gain += rest * math.log(rest / n / max(1 - sum(parent.values()), 1e-12))
            if 2 * gain > k + x.LEAST_Z * math.sqrt(2 * k) + x.LEAST_Z:
                new[ctx] = ({s: (m - d) / n for s, m in listed.items()}, 1 - sum(m - d for m in listed.values()) / n)
        if not new:
            break
        states.append(new)

    def measure(text):
        ws = tuple(text.encode().lower().split()) + ("$",)
        base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws)
        return sum(math.log10(prob(ws[:i], w, len(states))) for i, w in enumerate(ws)), base, len(ws), sum(c[w] > 0 for w in ws), total

    return measure, sum(map(len, states)), len(states)


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 10 == 0


@pytest.fixture(scope="module")
def chain():
    """Texts from a chain of the fourth order, rare words that occur twice or three times, and one that makes most of the tokens."""
    rng = random.Random(4)
    names = [f"n{i}" for i in range(4)]
    rows = []
    for i in range(400):
        ws = ["n0", "n1", "n2", "n3"]
        for _ in range(rng.randrange(5, 60)):
            known = [names.index(w) if w in names else 0 for w in ws[-4:]]
            ws.append(names[(known[0] * 3 + known[1] + known[2] * 2 + known[3] + 1) % 4] if rng.random() < 0.9 else rng.choice([*names, f"Rare{rng.randrange(500)}"]))
        rows.append((i, " ".join([*ws, f"seldom{i // 3} thread{i // 3}"]), "en", "s", 1))
    rows += [(1000 + i, " ".join(["filler"] * 1500), "en", "s", 1) for i in range(20)]
    return rows


@pytest.mark.parametrize(("depth", "hot"), [(1, None), (6, None), (6, 300)])
def test_against_the_plain_model(spark, chain, depth, hot):
    """hot: contexts from so many tokens on are spread over partitions, here at several levels."""
    measure, states, deepest = plain_model([(held(d), t) for d, t, *_ in chain], depth)
    got = {r.doc_id: r for r in x.score(spark.createDataFrame(chain, SCHEMA).repartition(5), depth, hot).collect()}
    assert len(got) == len(chain) and deepest == min(depth, 6) and next(iter(got.values())).n_states == states
    for d, t, *_ in [*chain[:400:3], chain[-1]]:
        logp, base, n, known, total = measure(t)
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(d), n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score == pytest.approx(logp, abs=1e-6)


def test_longer_contexts_pay(spark, chain):
    """On texts that the model has not seen."""
    docs = spark.createDataFrame(chain, SCHEMA).repartition(5)
    gains = [sum(r.score for r in x.score(docs, depth).collect() if r.held_out and r.doc_id < 1000) for depth in (1, 4)]
    assert gains[1] > gains[0]


def test_odd_rows(spark, odd, odd_rows, empty):
    measure, _, _ = plain_model([(held(d), t or "") for d, t, *_ in odd_rows])
    order = lambda rows: sorted((d is None, d or 0, n, round(base, 4), round(logp, 4)) for d, logp, base, n in rows)
    got = order((r.doc_id, r.score, r.base_score, r.n_tokens) for r in x.score(odd).collect())
    want = order((d, *measure(t or "")[:3]) for d, t, *_ in odd_rows)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-4)
    assert x.score(empty).count() == 0
    ids = [i for i in range(40) if held(i)][:2]
    rows = x.score(spark.createDataFrame([(ids[0], "some words", None, None, None), (ids[1], None, None, None, None)], SCHEMA)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)] and all(math.isfinite(r.score) for r in rows)


def test_windows_are_on_disk_in_turns(spark, chain, monkeypatch):
    """Each turn has partitions of its own, and no turn most of the windows' bytes."""
    turns, dealt_by = [], x.dealt_by

    def seen(df, parts, key, *order):
        if "level" in order:
            turns.append({r.part: r.size for r in df.where("level = 2").groupBy("part").agg(F.sum(F.length("data")).alias("size")).collect()})
        return dealt_by(df, parts, key, *order)

    monkeypatch.setattr(x, "dealt_by", seen)
    x.score(spark.createDataFrame(chain, SCHEMA).repartition(5)).count()
    sizes = [sum(t.values()) for t in turns]
    assert len(sizes) > 1 and max(sizes) < 0.8 * sum(sizes)
    assert sum(map(len, turns)) == len(set().union(*turns))


def test_what_was_read_goes(spark, chain, monkeypatch):
    """Words go share by share once they are counted, and of an earlier turn only each document's sum stays."""
    top, words, turns, dealt_by = x.shared_dir(spark).removeprefix("file://").removeprefix("file:"), [], [], x.dealt_by
    there = lambda what: {str(p) for p in Path(top).glob(what)}
    before = there("*")

    def seen(df, parts, key, *order):
        new = [p for what in ("*/asks=1/share=*", "solved-*") for p in there(what) if not any(p.startswith(b) for b in before)]
        if "level" in order:
            turns.append([p for p in new if "solved-" in p])
        elif key == "part" and len(words) < x.SHARES:
            words.append(len(new))
        return dealt_by(df, parts, key, *order)

    monkeypatch.setattr(x, "dealt_by", seen)
    x.score(spark.createDataFrame(chain, SCHEMA).repartition(5)).count()
    assert words == list(range(x.SHARES, 0, -1))
    assert len(turns) > 1 and not any(turns)


def test_turns_follow_the_windows(spark, chain, monkeypatch):
    """The fewer words a turn may have, the more turns there are, one for each partition at most; the scores stay."""
    docs, dealt_by, found = spark.createDataFrame(chain, SCHEMA).repartition(5), x.dealt_by, []

    def seen(df, parts, key, *order):
        found[-1][0] += "level" in order
        return dealt_by(df, parts, key, *order)

    monkeypatch.setattr(x, "dealt_by", seen)
    for share in (100.0, 1.0, 1e-9):
        monkeypatch.setattr(x, "TURN_WORDS", share)
        found.append([0, None])
        found[-1][1] = {r.doc_id: r.score for r in x.score(docs).collect()}
    assert found[0][0] == 1 < found[1][0] <= found[2][0] == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert all(f[1] == pytest.approx(found[0][1], abs=1e-9) for f in found[1:])


def test_order_of_values():
    """Also where keys are too wide to be sorted with their places."""
    rng = np.random.default_rng(0)
    wide = (rng.integers(0, 1 << 20, 5000).astype(np.uint64) << np.uint64(44)) + rng.integers(0, 3, 5000).astype(np.uint64)
    for k in (np.empty(0, np.int64), rng.integers(-(1 << 63), (1 << 63) - 1, 5000), rng.integers(0, 50, 5000).astype(np.uint32), wide, np.array([1 << 63, (1 << 64) - 1, 0], np.uint64)):
        k = np.concatenate([k, k[::3]])
        assert x._order(k).tolist() == np.argsort(k, kind="stable").tolist()
        if len(k):
            assert x._from_steps(x._steps(k.astype(np.int64) >> 3)).tolist() == (k.astype(np.int64) >> 3).tolist()
            starts = np.arange(0, len(k), 7)
            assert x._from_gaps_of_runs(x._gaps_of_runs(k, starts), np.diff(starts, append=len(k))).tolist() == k.tolist()
