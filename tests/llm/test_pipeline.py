"""The pipeline against a plain version of each stage on its own input."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline as cp
from conftest_llm import words
from cuelattice.llm import bpe_automaton, mixing, secrets, toxicity
from test_mixing import WORD
from test_near_and_passages import brute_join


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(31)
    rows, labels = [], []
    for i in range(260):
        text = ". ".join(words(rng, rng.randrange(4, 30), 2500) for _ in range(rng.randrange(1, 6)))
        if i % 6 == 0:
            text += " you filthy scoundrel."
        if i % 17 == 0:
            text += ' api_key: "zXcVbNm1234567890" end'
        rows.append((i, text, "en", f"src{i % 4}", len(text)))
        if i % 5:
            labels.append((i, 1, int(i % 6 == 0)))
    rows += [(300 + k, rows[1][1] + " tail" * (k % 2), "en", "src1", 1) for k in range(5)] + [(400, None, None, None, None), (401, "", "en", "src2", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "tokens"]
    for n, (name, stage) in enumerate(cp.STAGES):
        before = docs.collect()
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        after = docs.collect()
        if n < 4:
            assert docs.columns == columns
        if name == "toxicity":
            model = toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
            assert {r.doc_id for r in after} == {r.doc_id for r in before if model.score(r.text or "") < 0.3}
            assert {r.doc_id for r in before} - {r.doc_id for r in after} == {r.doc_id for r in before if "filthy" in (r.text or "")}
        elif name == "near_duplicates":
            classes = brute_join([(r.doc_id, r.text) for r in before])
            assert sorted(r.doc_id for r in after) == sorted({c for _, c, _ in classes}) and len(after) < len(before)
        elif name == "secrets":
            measure = secrets.efficiency(cp.public_tokenizers.path("byte_bpe_50k.tiktoken"))
            assert len(after) == len(before)
            texts = {r.doc_id: r.text for r in before}
            for r in after:
                found = secrets.find(texts[r.doc_id] or "", measure)
                assert (r.text != texts[r.doc_id]) == bool(found) and not secrets.find(r.text or "", measure)
        elif name == "mixing":
            want = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
            got = Counter()
            for r in after:
                got[r.doc_id] += len(WORD.findall(r.text))
            assert dict(got) == {d: t for d, t in want.items() if t}
        else:
            t = bpe_automaton.tokenizer(cp.public_tokenizers.path("word_bpe_49k.json"))
            assert sorted((r.doc_id, r.ids) for r in after) == sorted((r.doc_id, t.encode(r.text)) for r in before)


def test_run(spark, folder):
    rows = cp.run(spark, folder).collect()
    assert rows and {"doc_id", "ids", "n_tokens", "decoded_sha256"} <= set(rows[0].asDict())


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
