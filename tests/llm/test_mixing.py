from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from cuelattice.llm import mixing as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water_fill(sizes, weights, most=3):
    """Reshare by weight until no target is above its cap."""
    target, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), float(sum(sizes.values()))
    while open_:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / total > most * sizes[s] + 1e-9}
        if not over:
            for s in open_:
                target[s] = left * weights[s] / total
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_odd_rows(odd, odd_rows, empty):
    rows = m.mix(odd).collect()
    assert len(rows) == len(odd_rows)
    sizes = Counter()
    for _, t, _, s, _ in odd_rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_fill(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert taken[s] == int(want[s] + 1e-6) or abs(taken[s] - want[s]) <= 1
    assert sorted(map(str, rows)) == sorted(map(str, m.mix(odd.repartition(7)).collect()))
    assert m.mix(empty).count() == 0


def test_no_words_at_all(spark):
    rows = m.mix(spark.createDataFrame([(1, "", "en", "a", 0), (2, None, "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert [(r.size, r.taken, r.target) for r in rows] == [(0, 0, 0.0)] * 2


def test_apply_mix_gives_what_mix_counts(odd, odd_rows, empty):
    want = Counter()
    for r in m.mix(odd).collect():
        want[r.doc_id] += r.taken
    got, whole = Counter(), {t for _, t, *_ in odd_rows}
    out = m.apply_mix(odd)
    assert out.columns == odd.columns
    cut = 0
    for r in out.collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        assert r.size == "clash" and (r.n_chars is None or r.n_chars > 0)
        if r.text not in whole:
            cut += 1
            assert any(t and t.startswith(r.text) for t in whole)
    assert {k: v for k, v in want.items() if v} == dict(got) and cut <= 4
    assert m.apply_mix(empty).count() == 0


def test_plan_has_no_python(odd):
    plan = m.mix(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
