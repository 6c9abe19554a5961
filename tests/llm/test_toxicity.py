from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from conftest_llm import words
from cuelattice.llm import toxicity as x

BAD = ["vile", "rotten", "filthy"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        sentences = [words(rng, rng.randrange(3, 12), 80) for _ in range(rng.randrange(1, 8))]
        toxic = rng.random() < 0.25
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] = f"you {rng.choice(BAD)} {sentences[at]}"
        text = ". ".join(sentences) + "."
        rows.append((i, text, "en", "s", len(text)))
        if i % 10:
            labels.append((i, 0, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame([*labels, labels[0], (None, 1, 1), (10_000, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int"), {r[0]: any(b in r[1] for b in BAD) for r in rows}, {r[0]: r[1] for r in rows}


def test_held_out_accuracy_and_location(corpus):
    docs, labels, truth, texts = corpus
    rows = x.score(docs, x.train(docs, labels)).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.predicted == truth[r.doc_id]
        spans = [texts[r.doc_id][int(a) : int(b)] for a, b in (s.split(":") for s in r.offending.split(",") if s)]
        assert bool(spans) == truth[r.doc_id] and all(any(b in s for b in BAD) for s in spans)


def test_held_out_labels_train_nothing(spark, corpus):
    docs, labels, _, _ = corpus
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    assert x.train(docs, labels) == x.train(docs, turned)


def test_score_is_the_noisy_or():
    model = x.Model(leak=0.05, bias=-3.0, weights={"vile": 4.0, "nice": -1.0})
    text = "A vile thing. Nice! plain one\n\nvile nice nice. ..."
    s = lambda v: 1 / (1 + np.exp(-v))
    clear = 0.95 * (1 - s(1.0)) * (1 - s(-4.0)) * (1 - s(-3.0)) * (1 - s(-1.0))
    assert model.score(text) == pytest.approx(1 - clear)
    assert [text[a:b] for a, b, _ in model.sentence_scores(text)] == ["A vile thing", " Nice", "vile nice nice"]


def test_gradient():
    """The fit ends where small changes of any parameter do not help."""
    rng = np.random.default_rng(3)
    bags, plain, labels = [], [], []
    for _ in range(300):
        bag = []
        for _ in range(rng.integers(1, 4)):
            bag += [int(w) for w in rng.integers(0, 4, rng.integers(1, 3))] + [-1]
        bags.append(np.array(bag, np.int32).tobytes())
        plain.append(int(rng.integers(0, 5)))
        labels.append(int(0 in bag or rng.random() < 0.1))
    w, bias, leak = x.fit(bags, np.array(plain), np.array(labels), 4, steps=3000)

    def loss(w, bias, leak):
        total = -0.25 * float((w**2).sum())
        for bag, n, y in zip(bags, plain, labels, strict=True):
            clear, at = (1 - leak) * (1 - 1 / (1 + np.exp(-bias))) ** n, 0.0
            for i in np.frombuffer(bag, np.int32):
                if i < 0:
                    clear *= 1 - 1 / (1 + np.exp(-(bias + at)))
                    at = 0.0
                else:
                    at += w[i]
            total += np.log(1 - clear if y else clear)
        return total

    best = loss(w, bias, leak)
    for i in range(4):
        for step in (-0.05, 0.05):
            v = w.copy()
            v[i] += step
            assert loss(v, bias, leak) <= best + 1e-3
    assert loss(w, bias + 0.05, leak) <= best + 1e-3 and loss(w, bias - 0.05, leak) <= best + 1e-3


def test_odd_rows(spark, odd, odd_rows, empty, corpus):
    docs, labels, _, _ = corpus
    model = x.train(docs, labels)
    rows = x.score(odd, model).collect()
    assert len(rows) == len(odd_rows) and all(r.score == pytest.approx(model.leak) for r in rows if r.doc_id in (0, 1, 2))
    kept = x.reject(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows)
    assert x.score(empty, model).count() == 0 == x.reject(empty, model).count()
    none = x.train(docs, labels.limit(0))
    assert none.score("anything. At all") == pytest.approx(0, abs=1e-6) and x.train(empty, labels).weights == {}
    assert x.train(odd, spark.createDataFrame([(5, 0, 1), (14, 1, 0)], labels.schema)).score("x") <= 1


def test_reject_drops_the_toxic(corpus):
    docs, labels, truth, _ = corpus
    assert {r.doc_id for r in x.reject(docs, x.train(docs, labels)).collect()} == {d for d, t in truth.items() if not t}


def test_stems_count_in_forms_that_are_seldom(spark):
    """No form stands in eight documents, so only the stem's letters can say it."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        sentences = [words(rng, rng.randrange(3, 12), 80) for _ in range(rng.randrange(1, 6))]
        toxic = i % 5 == 0
        if toxic:
            sentences.append("das achlich" + "".join(rng.choice("aeioubcd") for _ in range(5)) + " da")
        rows.append((i, ". ".join(sentences), "de", "s", 1))
        labels.append((i, 0, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = x.score(docs, x.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held) and any(r.predicted for r in held)


def test_words_and_beginnings():
    assert x.features("ab") == ["ab$"] and x.features("abcde") == ["abcde$", "abcd", "abcde"] and len(x.features("a" * 30)) == 6
