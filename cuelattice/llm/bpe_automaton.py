"""BPE encoding and decoding by a deterministic tokenization automaton.

The automaton reads tokens.  It starts as one state with an arc for every base
symbol, and each merge (u, v), taken in order, adds a gadget:

* the state reached by u loses its arc v (what follows u is now merged);
* the new token t = uv gets an arc from every state that had the path u, v,
  and leads to a state with the arcs that v's state had just before.

So the state reached depends on the last token alone, and the arcs of a state
are those of its right part at the time of the merge, less what later gadgets
took away.  Written out, the arcs would number tokens times tokens; instead the
gadgets are kept (a time and two parts for each token, a time for each removed
arc), and an arc is looked up through them once and then kept in the table.

A word has one path through the automaton whose labels spell it, and so has each
of its prefixes.  Read by base symbols, the automaton is made deterministic: a
state holds, for each place where a label may have begun, the label before it,
the symbols read since, and the labels that are not yet sure; a transition on a
symbol gives the next state and emits the labels on which all of these agree.
Transitions are worked out when they are first taken and kept in a table of
bounded size, so encoding a word is one look-up a symbol, from left to right.

Defined cases: null and empty texts have no tokens; special tokens found in a
text become their ids, as the library does; any further columns are ignored by
the digests and kept by :func:`encode`, :func:`decode` and :func:`tokenize`,
except that columns which have the name of a result are replaced: ``ids``,
``decoded``, and for the last ``ids``, ``n_tokens`` and ``decoded_sha256``.
"""

from __future__ import annotations

import contextlib
import gc
import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, column, documents, free_name, slices, text_or_empty
from .presplit import WORD_LEVEL, byte_symbols, is_latin1

NEVER = 1 << 60
#: Follows the last symbol of a word; no symbol is empty.
END = ""


class Automaton:
    """The tokenization automaton of a vocabulary and its ordered merges."""

    #: Transitions that the table holds at most, about; then it is filled anew.
    most = 400_000

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.labels = {i: t for t, i in vocab.items()}
        self.suffix = suffix
        ends = lambda t: bool(suffix) and t.endswith(suffix) and len(t) > len(suffix)
        self.born = {i: 0 for i in vocab.values()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.removed: dict[tuple[int, int], int] = {}
        self.arcs: dict[tuple[int, int], bool] = {}
        products = {u + v for u, v in merges}
        final = {i for t, i in vocab.items() if t not in products and ends(t)}
        made = {t for t, i in vocab.items() if t not in products}
        for time, (u, v) in enumerate(merges, 1):
            a, b, t = vocab[u], vocab[v], vocab[u + v]
            if t in self.parts:
                raise ValueError(f"two merges make {u + v!r}")
            # Without the path u, v there is nothing that the gadget would join.
            if u in made and v in made and self._arc_at(a, b, time - 1):
                self.parts[t], self.born[t] = (a, b), time
                made.add(u + v)
                if b in final:
                    final.add(t)
            self.removed.setdefault((a, b), time)
        #: Tokens by their spelling: those inside a word, and those that end it (without the suffix).
        self.inner = {t: vocab[t] for t in made if vocab[t] not in final}
        self.final = {t[: len(t) - len(suffix)]: vocab[t] for t in made if vocab[t] in final} if suffix else self.inner
        #: Every beginning of a label, and the label that it is, if any.
        self.readable = {t[:i]: self.inner.get(t[:i]) for t in {*self.inner, *self.final} for i in range(1, len(t) + 1)}
        self.restart()

    def _arc_at(self, a: int, b: int, time: int) -> bool:
        """Whether token b may follow token a, once the gadgets up to ``time`` are in."""
        while True:
            if self.removed.get((a, b), NEVER) <= time:
                return False
            born_a, born_b = self.born[a], self.born[b]
            if born_a > born_b:  # a's state has the arcs of its right part's state just before a's gadget
                a, time = self.parts[a][1], born_a - 1
            elif born_b:  # b's gadget gave an arc wherever its left part had one
                b, time = self.parts[b][0], born_b
            else:
                return True

    def arc(self, a: int, b: int) -> bool:
        """The transition table, filled as it is used."""
        key = (a, b)
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) > 300_000:
                self.arcs.clear()
            found = self.arcs[key] = self._arc_at(a, b, NEVER - 1)
        return found

    def restart(self) -> None:
        start = ((None, "", ()),)
        self.states, self.numbers = [start], {start: 0}
        self.table: list[dict[str, tuple[int, tuple[int, ...]]]] = [{}]
        self.filled = 0

    def _transition(self, state: int, symbol: str) -> tuple[int, tuple[int, ...]]:
        """The next state and the labels emitted.  At the end of a word all labels are sure."""
        places = self.states[state]
        if symbol == END:
            for before, read, unsure in places:
                if self.suffix:
                    label = self.final.get(read)
                    if label is not None and (before is None or self.arc(before, label)):
                        return 0, (*unsure, label)
                elif not read:
                    return 0, unsure
            raise ValueError("no path spells the word")
        after, ended, readable = [], None, self.readable
        for before, read, unsure in places:
            read += symbol
            if read in readable:
                after.append((before, read, unsure))
                if ended is None:
                    label = readable[read]
                    if label is not None and (before is None or self.arc(before, label)):
                        ended = (label, "", (*unsure, label))  # the one path of this prefix
        if ended is not None:
            after.append(ended)
        if not after:
            raise ValueError(f"no path goes on with {symbol!r}")
        shortest, longest = min(x[2] for x in after), max(x[2] for x in after)  # what these two share, all do
        sure = next((i for i, (x, y) in enumerate(zip(shortest, longest, strict=False)) if x != y), min(len(shortest), len(longest)))
        places = tuple((before, read, unsure[sure:]) for before, read, unsure in after)
        to = self.numbers.get(places)
        if to is None:
            to = self.numbers[places] = len(self.states)
            self.states.append(places)
            self.table.append({})
        self.filled += 1
        return to, shortest[:sure]

    def encode_word(self, word: str) -> list[int]:
        """The labels' ids on the one path that spells ``word`` (in the vocabulary's symbols, without the suffix)."""
        if not word:
            return []
        if self.filled > self.most:
            self.restart()
        state, out, table = 0, [], self.table
        for symbol in (*word, END):
            row = table[state]
            step = row.get(symbol)
            if step is None:
                try:
                    step = row[symbol] = self._transition(state, symbol)
                except ValueError as e:
                    raise ValueError(f"{e}: {word!r}") from None
            state, labels = step
            if labels:
                out += labels
        return out


class Tokenizer:
    """Text to ids and back for a tokenizer file with word-level BPE (pre-splitting as the file says)."""

    most = 300_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.labels = dict(self.automaton.labels)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels |= {i: t for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        self.path = path
        self.symbols = str.maketrans({chr(b): s for b, s in enumerate(byte_symbols())})
        #: Words seen of late, and those seen before them; when the first are too many, they replace the second.
        self.words: dict[str, tuple[str, str]] = {}
        self.former: dict[str, tuple[str, str]] = {}
        self.rare: dict[str, tuple[str, str]] = {}

    def forget(self) -> None:
        self.words, self.former, self.rare = {}, {}, {}
        self.automaton.arcs.clear()
        self.automaton.restart()

    @cached_property
    def library(self):
        """The library's tokenizer, for its normaliser and pre-splitter alone; read when a text is beyond Latin-1."""
        from tokenizers import Tokenizer as Library

        return Library.from_file(self.path)

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs; without a decoder in the file they are joined by a space."""
        return " ".join([self.labels[i] for i in ids])

    def _word(self, symbols: str) -> tuple[str, str]:
        ids = self.automaton.encode_word(symbols)
        return " ".join(map(str, ids)), self.decode(ids)

    def _plain(self, text: str) -> list[tuple[str, str]]:
        out = []
        if is_latin1(text):
            words = self.words
            for w in WORD_LEVEL.findall(text.lower()):
                found = words.get(w)
                if found is None:
                    found = self.former.get(w) or self._word(w.encode().decode("latin-1").translate(self.symbols))
                    if len(words) >= self.most:
                        self.former, words = words, {}
                        self.words = words
                    words[w] = found
                out.append(found)
            return out
        for symbols, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text)):
            found = self.rare.get(symbols)
            if found is None:
                if len(self.rare) >= self.most:
                    self.rare.clear()
                found = self.rare[symbols] = self._word(symbols)
            out.append(found)
        return out

    def pieces(self, text: str) -> list[tuple[str, str]]:
        """(ids joined by a space, labels joined by a space) of each word."""
        if not any(s in text for s in self.special):
            return self._plain(text)
        out = []
        for piece in self.split_special.split(text):
            if piece in self.special:
                out.append((str(self.special[piece]), piece))
            elif piece:
                out += self._plain(piece)
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for p, _ in self.pieces(text) for i in p.split(" ")]


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


@contextlib.contextmanager
def at_work(path: str, keep: bool = False) -> Iterator[Tokenizer]:
    """A tokenizer for one task.  What it knows of the words goes at the end, unless it is kept for further tasks of the same kind in this worker."""
    t, before = tokenizer(path), gc.get_threshold()
    # Tables of hundreds of thousands of small tuples, none in a cycle, would be searched for cycles again and again.
    gc.set_threshold(200_000, 50, 50)
    try:
        yield t
    finally:
        gc.set_threshold(*before)
        if not keep:
            t.forget()


def _with(docs: DataFrame, path: str, name: str, kind: str, arrow: pa.DataType, work) -> DataFrame:
    kept, source = [c for c in docs.columns if c != name], free_name("given", docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with at_work(path) as t:
            for b in slices(batches, source) if name == "ids" else batches:
                values = pa.array([work(t, x) for x in b.column(0).to_pylist()], arrow)
                yield pa.RecordBatch.from_arrays([*b.columns[1:], values], names=[*b.schema.names[1:], name])

    given = "text" if name == "ids" else "ids"
    inner = docs.select(F.col(f"`{given}`").alias(source), *[F.col(f"`{c}`") for c in kept])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[1:]), f"`{name}` {kind}"])
    return inner.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Add ``ids`` (array of int) for ``text``; an existing column of that name is replaced."""
    return _with(docs, path, "ids", "array<int>", pa.list_(pa.int32()), lambda t, x: t.encode(x or ""))


def decode(rows: DataFrame, path: str) -> DataFrame:
    """Add ``decoded`` for ``ids`` (null ids: empty)."""
    return _with(rows, path, "decoded", "string", pa.string(), lambda t, x: t.decode(x or []))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with at_work(path, keep=True) as t:
            for b in slices(batches):
                counts, ids_sha, decoded_sha = [], [], []
                for text in column(b, "text"):
                    pieces = t.pieces(as_text(text))
                    ids = " ".join([p[0] for p in pieces])
                    counts.append(ids.count(" ") + 1 if ids else 0)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256(" ".join([p[1] for p in pieces]).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """The rows with ``text`` replaced by ids, n_tokens and decoded_sha256 (of what the ids decode to), in one pass over Python."""
    kept = [c for c in docs.columns if c not in ("text", "ids", "n_tokens", "decoded_sha256")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with at_work(path) as t:
            for b in slices(batches):
                ids, digests = [], []
                for text in column(b, "text"):
                    pieces = t.pieces(as_text(text))
                    joined = " ".join([p[0] for p in pieces])
                    ids.append(np.fromstring(joined, np.int32, sep=" ") if joined else np.zeros(0, np.int32))
                    digests.append(hashlib.sha256(" ".join([p[1] for p in pieces]).encode()).hexdigest())
                counts = np.array([len(i) for i in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[1:], lists, pa.array(counts), pa.array(digests, pa.string())],
                    names=[*kept, "ids", "n_tokens", "decoded_sha256"],
                )

    inner = docs.select("text", *[F.col(f"`{c}`") for c in kept])
    schema = ", ".join(
        [*(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[1:]), "ids array<int>, n_tokens long, decoded_sha256 string"]
    )
    return inner.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
