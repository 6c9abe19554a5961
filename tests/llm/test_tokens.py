"""Tokenizers against the library, and the file format against its ids."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cuelattice.llm import bpe_automaton as b
from cuelattice.llm import directly_addressable as d

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


def agree(library, text):
    want = library[WORD].encode(text, add_special_tokens=False).ids
    assert b.tokenizer(WORD).encode(text) == want
    assert b.tokenizer(WORD).decode(want) == library[WORD].decode(want, skip_special_tokens=False)
    assert np.frombuffer(d.word_ids(BYTE).encode(text), "<u4").tolist() == library[BYTE].encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    agree({p: Tokenizer.from_file(p) for p in (WORD, BYTE)} if not hasattr(test_any_text, "lib") else test_any_text.lib, text)


test_any_text.lib = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abeinrst 'SLd1½!-\n\t", max_size=80))
def test_latin_text(text):
    agree(test_any_text.lib, text)


def test_special_cases(library, sample):
    for text in ["", " ", "a</w>b </w>", "<|endoftext|>x<|startoftext|>", "a" * 4000, "=" * 2000, "aaa aaaa", "ΣΑΣ İ", "漢字 🙂🙂", "we'll 'S '", "a\x85b\xa0c\x1cd", "ﬁ ² Ⅷ", *sample.text[:60]]:
        agree(library, text)


def plain_bpe(word, ranks):
    parts = list(word)
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get((parts[i], parts[i + 1]), 1 << 30), i))
        if (parts[best], parts[best + 1]) not in ranks:
            break
        pair = (parts[best], parts[best + 1])
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def test_small_automata():
    """All words up to length 7 over two letters, for random merge lists, repeated letters and unreachable merges included."""
    import itertools
    import random

    rng = random.Random(8)
    for _ in range(40):
        tokens, merges = ["a", "b"], []
        for _ in range(rng.randrange(7)):
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in tokens:
                merges.append((u, v))
                tokens.append(u + v)
        vocab = {t: i for i, t in enumerate(tokens)}
        automaton, ranks = b.Automaton(vocab, merges), {m: i for i, m in enumerate(merges)}
        for n in range(1, 8):
            for word in map("".join, itertools.product("ab", repeat=n)):
                assert [tokens[i] for i in automaton.encode_word(word)] == plain_bpe(word, ranks), (merges, word)


@pytest.mark.parametrize("most", [3, 50, 100_000])
def test_the_table_is_bounded(most):
    """However few transitions are kept, words have the same ids; with a suffix that ends them, too."""
    import random

    rng = random.Random(5)
    tokens = ["a", "b", "a.", "b."]
    merges = [("a", "b"), ("ab", "a."), ("a", "a"), ("aa", "b."), ("ab", "ab"), ("b", "b."), ("aa", "ab.")]
    tokens += ["ab", "aba.", "aa", "aab.", "abab", "bb."]
    automaton, ranks = b.Automaton({t: i for i, t in enumerate(tokens)}, merges[:6], "."), {m: i for i, m in enumerate(merges[:6])}
    automaton.most = most
    for _ in range(500):
        word = [rng.choice("ab") for _ in range(rng.randrange(1, 30))]
        assert [tokens[i] for i in automaton.encode_word("".join(word))] == plain_bpe([*word[:-1], word[-1] + "."], ranks)
        assert automaton.filled <= most + 31


def test_a_word_without_a_path():
    automaton = b.Automaton({"a": 0}, [])
    for word in ("x", "ax"):
        with pytest.raises(ValueError, match="no path"):
            automaton.encode_word(word)
    assert automaton.encode_word("aa") == [0, 0] and automaton.encode_word("") == []


def test_digests_of_odd_rows(odd, odd_rows, empty, library):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.ids_sha256, r.n_tokens, r.decoded_sha256) for r in b.digests(odd, WORD).collect())
    want = []
    for doc, t, *_ in odd_rows:
        ids = library[WORD].encode(t or "", add_special_tokens=False).ids
        want.append((doc is None, doc or 0, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), len(ids), hashlib.sha256(library[WORD].decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert b.digests(empty, WORD).count() == 0


def test_encode_decode_columns(odd, odd_rows, empty):
    rows = b.decode(b.encode(odd, WORD), WORD).collect()
    assert len(rows) == len(odd_rows) and all(r.size == "clash" and r.n_tokens == "clash" for r in rows)
    for r in rows:
        assert r.ids == b.tokenizer(WORD).encode(r.text or "") and r.decoded == b.tokenizer(WORD).decode(r.ids)
    one_pass = b.tokenize(odd, WORD).collect()
    assert sorted(map(str, (r.ids for r in one_pass))) == sorted(map(str, (r.ids for r in rows))) and all(r.n_tokens == len(r.ids) and r.key == "clash" for r in one_pass)
    assert b.tokenize(empty, WORD).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 60_000), st.integers(0, 2**32 - 1)), max_size=1500), st.data())
def test_levels(ids, data):
    levels = d.Levels(d.encode_levels(np.array(ids, np.uint32)))
    assert len(levels) == len(ids) and levels.slice(0, len(ids)).tolist() == ids
    if ids:
        lo = data.draw(st.integers(0, len(ids) - 1))
        hi = data.draw(st.integers(lo, len(ids)))
        assert levels.slice(lo, hi).tolist() == ids[lo:hi] and levels.access(lo) == ids[lo]


def test_every_id_by_access():
    ids = np.random.default_rng(1).integers(0, 70_000, 3000).astype(np.uint32)
    ids[::3] %= 256
    levels = d.Levels(d.encode_levels(ids))
    assert [levels.access(i) for i in range(len(ids))] == ids.tolist()


def test_file():
    ids = np.arange(10, dtype=np.uint32) * 1000
    docs, counts, levels = d.unpack_file(d.pack_file([None, 5, -3], [2, 0, 8], ids))
    assert docs == [None, 5, -3] and counts.tolist() == [2, 0, 8] and levels.slice(0, 10).tolist() == ids.tolist()
    with pytest.raises(ValueError):
        d.unpack_file(b"nope" + bytes(30))


@pytest.mark.parametrize("file_ids", [1, 500, 1 << 18])
def test_files_of_odd_rows(odd, odd_rows, empty, library, file_ids):
    files, _ = d.write_files(odd, BYTE, file_ids=file_ids)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in d.read_documents(files).collect()), key=lambda r: r[0])
    want, at = [], 0
    for doc, t, *_ in sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = [*library[BYTE].encode(t or "", add_special_tokens=False).ids, d.END_ID]
        want.append((at, doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert d.read_documents(d.write_files(empty, BYTE)[0]).count() == 0


def test_lookup_of_single_ids(spark, sample, library):
    docs = spark.createDataFrame([(int(i), t) for i, t in zip(sample.doc_id, sample.text, strict=True)], "doc_id long, text string")
    files, _ = d.write_files(docs, BYTE, file_ids=500)
    ids = {int(i): library[BYTE].encode(t or "", add_special_tokens=False).ids + [2] for i, t in zip(sample.doc_id, sample.text, strict=True)}
    wanted = [(i, k) for i in list(ids)[::7] for k in (0, len(ids[i]) // 2, len(ids[i]) - 1, len(ids[i]), -1)]
    got = d.lookup(files, spark.createDataFrame(wanted, "doc_id long, nth long")).collect()
    assert sorted((r.doc_id, r.nth, r.id) for r in got) == sorted((i, k, ids[i][k]) for i, k in wanted if 0 <= k < len(ids[i]))


def test_lookup_reads_few_files(spark, library):
    """Rows that share a doc_id, or have none, each give their id, and only files that hold one are read."""
    rows = [(i, f"text number {i} " * 20) for i in range(40)] + [(7, "another seven"), (None, "no id"), (None, "none either")]
    files, _ = d.write_files(spark.createDataFrame(rows, "doc_id long, text string"), BYTE, file_ids=50)
    got = d.lookup(files, spark.createDataFrame([(7, 0), (None, 1), (99, 0)], "doc_id long, nth long"))
    ids = lambda t: library[BYTE].encode(t, add_special_tokens=False).ids
    want = [(7, 0, ids(rows[7][1])[0]), (7, 0, ids("another seven")[0]), (None, 1, ids("no id")[1]), (None, 1, ids("none either")[1])]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "In(part" in plan or "EqualTo(part" in plan
    assert "content" not in d.index_of(files)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
