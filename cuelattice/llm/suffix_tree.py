"""Language-model scoring with a probabilistic suffix tree of the whole corpus.

Symbols are all words of the texts (A-Z lowered) and one end.  The root has the
smoothed distribution of all of them.  A context is the last one to ``DEPTH``
words before a token.  With absolute counts, the same at every size of corpus,

* a context is a candidate if it stands ``LEAST_CONTEXT`` times or more in the
  training texts, and a next symbol is listed from ``LEAST_NEXT`` times on;
* a candidate is retained if its next symbols diverge from those of its longest
  retained suffix: twice the log likelihood ratio must exceed the number of its
  listed symbols by ``LEAST_Z`` standard deviations of a chi-square.

The probability at a retained context is its discounted share plus what it
leaves times that of its longest retained suffix.  A token has the probability
of its longest retained context.

Nothing of the tree is in one place.  Batches of documents keep their tokens as
places in a list of their own words, and ask for what they need of others:

1. words: each distinct word goes to the partition of its hash, which gives it
   a number and its count;
2. contexts of one word: each distinct pair of a context and a next symbol goes
   to the partition of the context, which gives back the pair's count and what
   the context's test came to;
3. longer contexts: a token whose last two words are a candidate goes, with the
   words before it as far as candidates can reach, to the partition of these
   two words.  All contexts that end with them are there, level by level, and
   so are all tokens to score; what comes back is each document's sum.  This
   is done in turns, as many as keep what is on disk at a time to a share of
   the input, and each turn's sums are added up when it ends.

The words before a token reach back while neighbours stand together LEAST_CONTEXT
times, and no further than a pair that stands just that often: a longer
context would then hold the same tokens, and no test could tell it apart.

A context with more than HOT tokens (a number that follows the corpus, so that
there are MOST_HOT of them at most) is spread by what follows it: its pairs are
asked for in step 2, at any level, and the sums of its test are added up by
Spark and broadcast.

Defined cases: null text counts as empty and is one end token; rows with equal
doc_id are rows of their own; an empty table, or one without training rows,
gives scores from an untrained root; further columns are ignored.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, dealt_by, documents, drop_table, expand, mix64, remainder, runs, shared_dir, shuffles_go, slices, squeeze, text_or_empty

DEPTH = 8
LEAST_CONTEXT = 2
LEAST_NEXT = 2
LEAST_Z = 4.0
DISCOUNT = 0.75
HELD_OUT = 10
#: A hot context holds so many training tokens, and this share of all of them.
HOT, MOST_HOT = 1 << 20, 1 << 16
#: Bytes of text of a batch.
BATCH = 6 << 20
#: Bytes of text for each partition of words, pairs and windows, which a task holds at once; and how many buckets Spark allows a table.
PART_BYTES, MOST_BUCKETS = 32 << 20, 100_000
#: Words are counted, and batches learn their numbers, in so many shares; what a share has read goes when it ends.
SHARES = 3
#: The windows are dealt out in turns, each with its share of the partitions, and those of one turn are on disk at a time: so many of their words for a byte of text.
TURN_WORDS = 0.15

_END = 0x454E44


class _OwnWords(dict):
    """A batch's words, numbered from 1 as they come; 0 is the end."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


def tokens(text: bytes) -> list[bytes]:
    """Words with A-Z lowered.  bytes.lower and bytes.split know just A-Z and ASCII white space."""
    return text.lower().split()


def rows_of(docs: DataFrame) -> DataFrame:
    held = remainder(F.col("doc_id"), HELD_OUT) == 0
    return docs.select("doc_id", held.alias("held_out"), text_or_empty().alias("text"))


def _table(names: str, *values: list) -> pa.RecordBatch:
    """A batch of rows by a schema of longs, ints, doubles and binaries."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(values, fields, strict=True)], names=[n for n, _ in fields])


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return ((mix64(key.view(np.uint64)) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _order(key: np.ndarray) -> np.ndarray:
    """As np.argsort with a stable sort, by sorting values with their places in the low bits, which is several times faster."""
    if key.dtype.kind == "i":
        key = key.astype(np.int64).view(np.uint64) ^ np.uint64((1 << 63) * bool(key.min(initial=0) < 0))
    key = key.astype(np.uint64, copy=False)
    bits = np.uint64(len(key).bit_length())
    drop = max(0, int(key.max(initial=0)).bit_length() + int(bits) - 64)
    packed = key >> np.uint64(drop)
    packed <<= bits
    packed |= np.arange(len(key), dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    if drop:  # where numbers differ in the dropped bits alone, their order is mended
        packed >>= bits
        same, ordered = packed[1:] == packed[:-1], key[order]
        wrong = same & (ordered[1:] != ordered[:-1])
        if wrong.any():
            run = np.concatenate([[0], np.cumsum(~same)])
            several = np.zeros(run[-1] + 1, bool)
            several[run[1:][wrong]] = True
            at = np.flatnonzero(several[run])
            order[at] = order[at][np.argsort(ordered[at], kind="stable")]
    return order


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, in the order of keys, and each key's place among the distinct ones."""
    order = _order(key)
    ordered, new = key[order], np.ones(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    inverse = np.empty(len(key), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in their order, and each key's place among them."""
    first, inverse = _groups(key)
    return key[first], inverse


def _gaps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def _narrow(a: np.ndarray) -> np.ndarray:
    """In four bytes a number where that is enough."""
    return a.astype(np.uint32) if a.max(initial=0) < 1 << 32 else a


def _steps(a: np.ndarray) -> np.ndarray:
    """Differences, either sign in few bytes: counts in the order of words' numbers nearly descend."""
    d = np.diff(a.astype(np.int64), prepend=0)
    return ((d << 1) ^ (d >> 63)).view(np.uint64)


def _from_steps(steps: np.ndarray) -> np.ndarray:
    return np.cumsum((steps >> np.uint64(1)).view(np.int64) ^ -(steps & np.uint64(1)).view(np.int64))


def _gaps_of_runs(a: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Gaps within runs that begin at ``starts``, and each run's first number."""
    out = _gaps(a)
    out[starts] = a[starts]
    return out


def _from_gaps_of_runs(gaps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    sums, starts = np.cumsum(gaps, dtype=gaps.dtype), _starts(sizes.astype(np.int64))
    return sums - np.repeat(sums[starts] - gaps[starts], sizes)


# ------------------------------------------------------------------ words

#: words: the batch's distinct words by (partition, hash); counts: of them in its training texts; bounds: where each partition's begin; places: each token's word.
#: A batch has a row of its documents and one of each share of its words, in folders of their own: a share goes once it has been counted, or its numbers are known.
BATCHES = "batch long, docs array<{kind}>, held array<boolean>, sizes binary, places binary, words binary, counts binary, bounds binary, trained long, asks int, share int"


def _shares(parts: int) -> list[int]:
    """Where each share's partitions of words begin, and the end."""
    return [parts * s // SHARES for s in range(SHARES + 1)]


#: The share of a batch: its task and its number there.
_SHARE = f"(shiftright(batch, 32) + (batch & 4294967295)) % {SHARES}"


def _read(parts: int):
    """Batches of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for b in slices(batches, most=BATCH):
            own, found, sizes = _OwnWords(), [], []
            for t in column(b, "text"):
                ws = tokens(t)
                found += map(own.__getitem__, ws)
                found.append(0)
                sizes.append(len(ws) + 1)
            hashes = np.array([_END, *(xxhash.xxh3_64_intdigest(w) - (1 << 63) for w in own)], np.int64)
            first, inverse = _groups(hashes)
            key = hashes[first]
            part = _part(key, parts)
            order = _order(part)
            back = np.empty(len(order), np.uint32)
            back[order] = np.arange(len(order), dtype=np.uint32)
            places = back[inverse][np.array(found, np.uint32)]
            train = np.repeat(~np.array(column(b, "held_out"), bool), sizes)
            counts = np.bincount(places[train], minlength=len(key)).astype(np.uint32)
            bounds = np.searchsorted(part[order], np.arange(parts + 1)).astype(np.uint32)
            key = key[order]
            docs, held = (
                pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(b.schema.get_field_index(c))) for c in ("doc_id", "held_out")
            )
            none = pa.nulls(1, docs.type), pa.nulls(1, held.type)
            rows = [(0, (task + number) % SHARES, docs, held, squeeze(np.array(sizes, np.uint32)), squeeze(places), None, None, None)]
            for share, (lo, hi) in enumerate(pairwise(_shares(parts))):
                at = slice(bounds[lo], bounds[hi])
                rows.append((1, share, *none, None, None, key[at].tobytes(), squeeze(counts[at]), squeeze(bounds[lo : hi + 1] - bounds[lo])))
            for asks, share, *row in rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([(task << 32) + number]),
                        *row[:2],
                        *(pa.array([x], pa.binary()) for x in row[2:]),
                        pa.array([0 if asks else int(train.sum())]),
                        pa.array([asks], pa.int32()),
                        pa.array([share], pa.int32()),
                    ],
                    names=[x.split()[0] for x in BATCHES.split(", ")],
                )
            number += 1

    return run


ASKED = "part int, batch long, data binary"


def _ask_words(lowest: int):
    """lowest: the first partition of the share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, words, counts, bounds in zip(*(column(b, c) for c in ("batch", "words", "counts", "bounds")), strict=True):
                words, counts, bounds = np.frombuffer(words, np.int64), expand(counts)[0], expand(bounds)[0]
                used = np.flatnonzero(np.diff(bounds))
                data = [squeeze(words[bounds[p] : bounds[p + 1]], counts[bounds[p] : bounds[p + 1]]) for p in used]
                yield _table(ASKED, used + lowest, [batch] * len(used), data)

    return run


COUNTED = "batch long, part int, data binary, kinds long"


def _count_words(parts: int):
    """Per partition of words: their numbers and counts, given back to each batch in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in runs(batches, "part", ["batch", "data"]):
            asked = [expand(d) for _, d in rows]
            key, inverse = _distinct(np.concatenate([k for k, _ in asked]))
            total = np.bincount(inverse, np.concatenate([c for _, c in asked]), minlength=len(key)).astype(np.int64)
            rank = np.empty(len(key), np.int64)
            rank[np.argsort(-total, kind="stable")] = np.arange(len(key))
            number = rank * parts + part + 1  # frequent words have small numbers, which take few bytes
            data, at = [], 0
            for k, _ in asked:
                mine = inverse[at : at + len(k)]
                at += len(k)
                data.append(squeeze(number[mine], total[mine]))
            kinds = [int((total > 0).sum())] + [0] * (len(rows) - 1)
            yield _table(COUNTED, [r[0] for r in rows], [part] * len(rows), data, kinds)

    return run


#: tokens: sizes, places, gaps between the numbers of the words, and their counts; open: places in the tokens that still look for a longer context, and their probability so far.
STATE = "batch long, docs array<{kind}>, held array<boolean>, tokens binary, open binary"
#: What the pairs of level 1 came to; far: words of the windows, at most.
PAIRS = "batch long, pairs binary, far long"


def _by_part(answers: list) -> list[list[np.ndarray]]:
    """A batch's answers, decoded, by partition."""
    return [expand(a["data"]) for a in sorted(answers, key=lambda a: a["part"])]


def _joined(list_columns: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, dict]]:
    """Each row with its documents as Arrow arrays and the rest as Python values."""
    for b in list_columns:
        rest = [c for c in b.schema.names if c not in ("docs", "held")]
        for i in range(b.num_rows):
            docs, held = (b.column(b.schema.get_field_index(c))[i].values for c in ("docs", "held"))
            yield docs, held, {c: b.column(b.schema.get_field_index(c))[i].as_py() for c in rest}


def _lists(values: list[pa.Array]) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values]


@dataclass(frozen=True)
class _Plan:
    """parts: number of partitions; hot: tokens of a hot context; depth: of the tree; states: (total, listed, kinds) of the hot contexts just tested, the last two 0 where one is not retained."""

    parts: int
    hot: int
    depth: int
    states: dict[int, tuple] = field(default_factory=dict)


class _Root:
    """The smoothed distribution of all words, by count."""

    def __init__(self, total: int, kinds: int):
        self.total, self.kinds = total, kinds

    def probability(self, count: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(count))
        return np.where(count > 0, (count - DISCOUNT) / self.total, DISCOUNT * self.kinds / self.total)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10(count + 0.1) - np.log10(self.total + 0.1 * (self.kinds + 1))


def _learn_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the numbers and counts of their words, all tokens open."""
    for docs, held, row in _joined(batches):
        number, count = (np.concatenate(x) for x in zip(*_by_part(row["answers"]), strict=True))
        (sizes,), (places,) = expand(row["sizes"]), expand(row["places"])
        order = _order(number)  # by frequency: most places are then small numbers
        back = np.empty(len(order), np.uint32)
        back[order] = np.arange(len(order), dtype=np.uint32)
        places, number, count = back[places], _gaps(number[order]), count[order]
        state = [squeeze(sizes, places, number, count), b""]  # level 1 starts from the root, whose probabilities follow from the counts
        yield pa.RecordBatch.from_arrays(
            [pa.array([row["batch"]]), *_lists([docs, held]), *(pa.array([x], pa.binary()) for x in state)],
            names=[x.split()[0] for x in STATE.split(", ")],
        )


# ------------------------------------------------------------------ pairs of a context and a next symbol


class _Batch:
    """The tokens of a batch."""

    def __init__(self, row: dict, held: pa.Array, root: _Root):
        self.sizes, self.places, number, self.count = expand(row["tokens"])
        self.number = np.cumsum(number)
        self.sizes = self.sizes.astype(np.int64)
        if self.number.max(initial=0) < 1 << 32:
            self.number = self.number.astype(np.uint32)
        self.starts = _starts(self.sizes)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.inside = np.arange(len(self.places)) - self.starts[self.doc]
        self.train = ~np.asarray(held, bool)[self.doc]
        self.words = self.number[self.places]
        self.root = root
        if row["open"]:
            self.at, self.p = expand(row["open"])
        elif "pairs" in row:  # after the answers of level 1
            self.at = np.empty(0, np.int64)
        else:
            self.at = np.flatnonzero((self.inside > 0) & (self.count[np.roll(self.places, 1)] >= LEAST_CONTEXT))

    def context(self, at: np.ndarray, level: int) -> np.ndarray:
        """A number for the last ``level`` words before tokens."""
        out = self.words[at - 1].astype(np.uint64)
        for k in range(2, level + 1):
            out = mix64(out) + self.words[at - k].astype(np.uint64)
        return out.view(np.int64)

    def packed(self, part: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A partition and two places as one number."""
        most = np.uint64(len(self.number))
        return (part.astype(np.uint64) * most + a.astype(np.uint64)) * most + b.astype(np.uint64)

    def pairs(self, level: int, plan: _Plan) -> dict:
        """Distinct pairs of open tokens by (partition, context), each token's pair, and the contexts' places among the pairs."""
        if level == 1 and plan.parts * len(self.number) ** 2 < 1 << 64:  # one sort, as places follow numbers
            number = self.number.astype(np.int64)
            last, here, heated = self.places[self.at - 1], self.places[self.at], self.count >= plan.hot
            part = _part(number, plan.parts)[last]
            some = np.flatnonzero(heated[last])
            part[some] = _part((mix64(number[last[some]].view(np.uint64)) + number[here[some]].view(np.uint64)).view(np.int64), plan.parts)
            first, pair = _groups(self.packed(part, last, here))
            part, context, symbol, heat = part[first], number[last[first]], number[here[first]], heated[last[first]]
        else:
            if level == 1:
                context = self.words[self.at - 1].astype(np.int64)
                heat = self.count[self.places[self.at - 1]] >= plan.hot
            else:  # only hot contexts are asked for
                context, heat = self.context(self.at, level), np.ones(len(self.at), bool)
            symbol = self.words[self.at].astype(np.int64)
            key = mix64(context.view(np.uint64)) + symbol.view(np.uint64)
            first, inverse = _groups(key)
            part = _part(np.where(heat[first], key[first].view(np.int64), context[first]), plan.parts)
            order = np.lexsort((context[first], part))
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            first = first[order]
            pair = back[inverse]
            part, context, symbol, heat = part[order], context[first], symbol[first], heat[first]
        new = np.ones(len(part), bool)
        new[1:] = (context[1:] != context[:-1]) | (part[1:] != part[:-1])
        n = np.bincount(pair, self.train[self.at], minlength=len(first)).astype(np.uint32)
        return {"pair": pair, "first": first, "part": part, "context": context, "symbol": symbol, "n": n, "hot": heat, "new": new}


def _ask_pairs(level: int, root: _Root, plan: _Plan):
    """Each batch's pairs by partition: contexts, their heat and numbers of pairs; of the pairs, the symbols' places among distinct ones, and n; the distinct symbols, and the counts (at level 1) or the pairs' probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held, row in _joined(batches):
            b = _Batch(row, held, root)
            if not len(b.at):
                continue
            x = b.pairs(level, plan)
            used, lows = np.unique(x["part"], return_index=True)
            data = []
            for lo, hi in zip(lows, [*lows[1:], len(x["part"])], strict=True):
                starts = np.flatnonzero(x["new"][lo:hi])
                symbol, at = _distinct(x["symbol"][lo:hi])
                sizes = np.diff([*starts, hi - lo])
                if level == 1:
                    count = np.zeros(len(symbol), np.int64)
                    count[at] = b.count[b.places[b.at[x["first"][lo:hi]]]]
                    more = _steps(count)
                else:
                    more = b.p[x["first"][lo:hi]]
                data.append(
                    squeeze(
                        _gaps(x["context"][lo:hi][starts]),
                        x["hot"][lo:hi][starts].astype(np.uint8),
                        sizes.astype(np.uint32),
                        _gaps_of_runs(at.astype(np.uint32), starts),  # pairs of a context are in the order of symbols
                        x["n"][lo:hi],
                        _gaps(symbol),
                        more,
                    )
                )
            yield _table(ASKED, used, [row["batch"]] * len(used), data)

    return run


def _asked_pairs(level: int, data: bytes) -> list[np.ndarray]:
    contexts, heat, sizes, at, n, symbols, more = expand(data)
    return [np.cumsum(contexts), heat, sizes, _from_gaps_of_runs(at, sizes), n, np.cumsum(symbols), _from_steps(more) if level == 1 else more]


def tested(total, listed, kinds, gain, by_parent):
    """Whether a context is retained, and what it leaves to its suffix: from its number of tokens, and of its listed symbols the tokens, the number, the sum of n log(n / p) and of p."""
    rest = total - listed
    with np.errstate(divide="ignore", invalid="ignore"):
        by_rest = np.where(rest > 0, rest * np.log(np.maximum(rest, 1) / np.maximum(total, 1) / np.maximum(1 - by_parent, 1e-12)), 0.0)
        gain = gain - listed * np.log(np.maximum(total, 1)) + by_rest
    return (total >= LEAST_CONTEXT) & (2 * gain > kinds + LEAST_Z * np.sqrt(2.0 * kinds) + LEAST_Z)


def mixed(n, total, kinds, listed, p):
    """The probability of a symbol of ``n`` tokens after a context of ``total``, of which ``listed`` are those of its ``kinds`` listed symbols (0: not retained); p: after its suffix."""
    kept, total = kinds > 0, np.maximum(total, 1)
    share = np.where(kept & (n >= LEAST_NEXT), (n - DISCOUNT) / total, 0.0)
    return share + np.where(kept, 1 - (listed - DISCOUNT * kinds) / total, 1.0) * p


class _Sums:
    """Sums over the pairs of each context: context is each pair's context, n its training tokens, p its probability so far."""

    def __init__(self, context: np.ndarray, contexts: int, n: np.ndarray, p: np.ndarray):
        on = n >= LEAST_NEXT
        c, m = context[on], n[on].astype(float)
        add = lambda c, x=None: np.bincount(c, x, minlength=contexts)
        self.total, self.listed, self.kinds = add(context, n), add(c, m), add(c).astype(float)
        self.gain, self.by_parent = add(c, m * np.log(m / p[on])), add(c, p[on])

    def all(self) -> list[np.ndarray]:
        return [self.total, self.listed, self.kinds, self.gain, self.by_parent]


#: data: the pairs' counts, and of the contexts the listed symbols and their tokens, both 0 where it is not retained (or hot); sums: of one hot context in this partition.
ANSWERED = "batch long, part int, data binary, context long, sums array<double>, retained long, most long"


def _answer_pairs(root: _Root, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in runs(batches, "part", ["batch", "data"]):
            asked = [_asked_pairs(level, d) for _, d in rows]
            contexts, heat, sizes, at, n, symbols, more = zip(*asked, strict=True)
            symbol = np.concatenate([s[a] for s, a in zip(symbols, at, strict=True)])
            p = np.concatenate([root.probability(m[a]) if level == 1 else m for m, a in zip(more, at, strict=True)])
            names, context = _distinct(np.concatenate(contexts))
            hot = np.zeros(len(names), bool)
            hot[context] = np.concatenate(heat).astype(bool)
            context_of_chunk = np.split(context, np.cumsum([len(c) for c in contexts])[:-1])
            context = np.repeat(context, np.concatenate(sizes))
            key = mix64(context.astype(np.uint64)) + symbol.view(np.uint64)
            first, inverse = _groups(key)
            total = np.bincount(inverse, np.concatenate(n), minlength=len(first)).astype(np.int64)
            sums = _Sums(context[first], len(names), total, p[first])
            kept = tested(*sums.all()) & ~hot
            kinds, listed = (np.where(kept, x, 0).astype(np.uint32) for x in (sums.kinds, sums.listed))
            pieces = np.split(total[inverse], np.cumsum([len(x) for x in n])[:-1])
            data = [squeeze(t, kinds[c], listed[c]) for t, c in zip(pieces, context_of_chunk, strict=True)]
            k = len(rows)
            yield _table(
                ANSWERED,
                [r[0] for r in rows],
                [part] * k,
                data,
                [None] * k,
                [None] * k,
                [int(kept.sum())] + [0] * (k - 1),
                [int(total.max(initial=0))] * k,
            )
            if hot.any():
                some = np.flatnonzero(hot)
                values = np.stack(sums.all(), 1)[some]
                k = len(some)
                yield _table(ANSWERED, [None] * k, [part] * k, [None] * k, names[some], values.tolist(), [0] * k, [0] * k)

    return run


def _answers(b: _Batch, x: dict, answers: list, level: int, plan: _Plan) -> tuple[np.ndarray, ...]:
    """Of each pair its count, and of its context the training tokens, and the listed symbols and their tokens, both 0 where it is not retained."""
    n, kinds, listed = (np.concatenate(c) for c in zip(*_by_part(answers), strict=True))
    of = np.cumsum(x["new"]) - 1
    kinds, listed = kinds[of].astype(float), listed[of].astype(float)
    total = b.count[b.places[b.at[x["first"]] - 1]].astype(float) if level == 1 else np.ones(len(n))
    if plan.states:
        known = np.array(sorted(plan.states), np.int64)
        values = np.array([plan.states[c] for c in known.tolist()])
        at = np.minimum(np.searchsorted(known, x["context"]), len(known) - 1)
        hit = x["hot"] & (known[at] == x["context"])
        total[hit], listed[hit], kinds[hit] = values[at[hit]].T
    return n, total, kinds, listed


def _learn_pairs(root: _Root, plan: _Plan):
    """The answers to batches' pairs: each token's count as the pair of the word before and itself, 0 if it was not open; the listed symbols of each word as a context, and their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held, row in _joined(batches):
            b = _Batch(row, held, root)
            together, (kinds, listed) = np.zeros(len(b.places), np.int64), np.zeros((2, len(b.number)), np.int64)
            if len(b.at):
                x = b.pairs(1, plan)
                n, _, some, of_them = _answers(b, x, row["answers"], 1, plan)
                word = b.places[b.at[x["first"]] - 1]
                kinds[word], listed[word] = some, of_them
                together[b.at] = n[x["pair"]]
            yield _table(PAIRS, [row["batch"]], [squeeze(*map(_narrow, (together, kinds, listed)))], [_far(together, plan.depth)])

    return run


def _far(together: np.ndarray, depth: int) -> int:
    """How many words before tokens can be in windows: as many as recur as neighbours without a break."""
    at = np.arange(len(together))
    run = at - np.maximum.accumulate(np.where(together >= LEAST_CONTEXT, -1, at))
    return int(np.minimum(run[run > 0] + 1, depth).sum()) if depth > 1 else 0


# ------------------------------------------------------------------ longer contexts

#: A batch's own row has its documents and level 0; the others are chunks of windows, for the partition of their context of ``level`` words.
WINDOWS = "part int, batch long, level int, docs array<{kind}>, held array<boolean>, data binary"


class _Answered:
    """A batch after the answers to its pairs of ``level`` words.

    p: each token's probability so far; together: its count as the pair of its
    context and itself, 0 if it was not open; pairs: the same of level 1;
    kinds, listed: of each word as a context, at level 1; longer: the tokens
    whose context of one word more may be a candidate, and whether that is hot.
    """

    def __init__(self, b: _Batch, row: dict, level: int, plan: _Plan):
        self.b, self.pairs, *states = b, *expand(row["pairs"])
        if level == 1:
            self.together, (self.kinds, self.listed) = self.pairs, states
            longer = np.flatnonzero(b.inside > level) if level < plan.depth else np.empty(0, np.int64)
            # The context of two words is the pair of the token before.
            count = self.pairs[longer - 1]
            # Of two tokens after the same context, one that alone follows its last word differs from the other, so nothing is listed there.
            alone = (count == LEAST_CONTEXT) & (self.pairs[longer] == 1) & b.train[longer] & (LEAST_CONTEXT == LEAST_NEXT == 2)
            longer = longer[(count >= LEAST_CONTEXT) & ~alone]
        else:
            self.p, self.together = np.ones(len(b.places)), np.zeros(len(b.places), np.int64)
            if len(b.at):
                x = b.pairs(level, plan)
                n, *state = _answers(b, x, row["answers"], level, plan)
                self.p[b.at] = mixed(n, *state, b.p[x["first"]])[x["pair"]]
                self.together[b.at] = n[x["pair"]]
            longer = b.at[b.inside[b.at] > level] if level < plan.depth else b.at[:0]
        self.longer, self.heat = longer, self.together[longer - 1] >= plan.hot

    def probability(self, at: np.ndarray, level: int) -> np.ndarray:
        if level > 1:
            return self.p[at]
        b, before = self.b, self.b.places[at - 1]
        p, inside = b.root.probability(b.count[b.places[at]]), b.inside[at] > 0
        return np.where(inside, mixed(self.together[at], b.count[before], self.kinds[before], self.listed[before], p), p)


def _windows(level: int, root: _Root, plan: _Plan, turn: int, turns: int):
    """After the answers to pairs of ``level`` words: each batch's own row (later: its sums; in the first turn), and this turn's windows of its tokens that reach further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, held, row in _joined(batches):
            schema = pa.schema(
                [
                    ("part", pa.int32()),
                    ("batch", pa.int64()),
                    ("level", pa.int32()),
                    ("docs", pa.list_(docs.type)),
                    ("held", pa.list_(pa.bool_())),
                    ("data", pa.binary()),
                ]
            )
            b = _Batch(row, held, root)
            x = _Answered(b, row, level, plan)
            if turn == 0:
                yield _own(b, x, row, level, plan, docs, held, schema)
            chunks = list(_cut(b, _in_turn(b, x.longer[~x.heat], level + 1, plan, turn, turns), x, level + 1, plan))
            for lo in range(0, len(chunks), 64):
                parts, data = zip(*chunks[lo : lo + 64], strict=True)
                k = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(parts, pa.int32()),
                        pa.array([row["batch"]] * k),
                        pa.array([level + 1] * k, pa.int32()),
                        *(pa.nulls(k, schema.field(c).type) for c in ("docs", "held")),
                        pa.array(data, pa.binary()),
                    ],
                    schema=schema,
                )

    return run


def _own(b: _Batch, x: _Answered, row: dict, level: int, plan: _Plan, docs: pa.Array, held: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
    """A batch's own row: its documents (at level 1), and what their tokens come to that go no further."""
    closed = np.full(len(b.places), level == 1)
    closed[b.at] = True
    closed[x.longer] = False
    logs = np.bincount(b.doc[closed], np.log10(x.probability(np.flatnonzero(closed), level)), minlength=len(b.sizes))
    count = b.count[b.places]
    if level == 1:
        base, known = np.add.reduceat(b.root.base(count), b.starts), np.add.reduceat((count > 0).astype(np.int64), b.starts)
        own, lists = squeeze(b.sizes.astype(np.uint32), known.astype(np.uint32), base, logs), _lists([docs, held])
    else:
        own, lists = squeeze(np.arange(len(logs), dtype=np.uint32), logs), [pa.nulls(1, schema.field(c).type) for c in ("docs", "held")]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([row["batch"] % plan.parts], pa.int32()),
            pa.array([row["batch"]]),
            pa.array([0], pa.int32()),
            *lists,
            pa.array([own], pa.binary()),
        ],
        schema=schema,
    )


def _in_turn(b: _Batch, at: np.ndarray, level: int, plan: _Plan, turn: int, turns: int) -> np.ndarray:
    """The tokens whose context of ``level`` words is in a partition of this turn."""
    return at[_part(b.context(at, level), plan.parts) % turns == turn] if turns > 1 else at


def _keep_hot(level: int, root: _Root, plan: _Plan):
    """Batches in which the tokens with a hot context of level + 1 words are open, and the counts of all pairs of neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, held, row in _joined(batches):
            b = _Batch(row, held, root)
            x = _Answered(b, row, level, plan)
            at = x.longer[x.heat].astype(np.int64)
            state = [row["tokens"], squeeze(at, x.probability(at, level)), squeeze(x.pairs)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["batch"]]), *_lists([docs, held]), *(pa.array([v], pa.binary()) for v in state)],
                names=[*(c.split()[0] for c in STATE.split(", ")), "pairs"],
            )

    return run


def _short(p: np.ndarray) -> np.ndarray:
    """Rounded to 28 bits after the first one: three planes of bytes are then empty."""
    low = np.uint64(24)
    return (((p.view(np.uint64) + np.uint64(1 << 23)) >> low) << low).view(np.float64)


def _cut(b: _Batch, at: np.ndarray, x: _Answered, level: int, plan: _Plan) -> Iterator[tuple[int, bytes]]:
    """Windows of the tokens ``at``, equal ones once, by the partition of their last ``level`` words."""
    if not len(at):
        return
    reach = np.full(len(at), level)
    key = np.zeros(len(at), np.uint64)
    history, inside = [], b.inside[at]
    going, tail, least = np.arange(len(at)), at, np.full(len(at), np.iinfo(np.int64).max)  # those that reach further, and the least count of their pairs
    for k in range(1, plan.depth + 1):
        if k > 1:
            # The pair of the (k - 1)th and kth word before.
            n = x.pairs[tail - k + 1]
            if k > level:
                on = (inside[going] >= k) & (least > LEAST_CONTEXT) & (n >= LEAST_CONTEXT)
                going, tail, least, n = going[on], tail[on], least[on], n[on]
            least = np.minimum(least, n)
        words = np.zeros(len(at), b.words.dtype)
        words[going] = b.words[tail - k]
        reach[going] = k
        key[going] = mix64(key[going] + words[going].astype(np.uint64))
        history.append(words)
    route = history[0].astype(np.uint64)
    for k in range(2, level + 1):
        route = mix64(route) + history[k - 1].astype(np.uint64)
    symbol = b.words[at]
    key = mix64(key) + symbol.astype(np.uint64)
    first, inverse = _groups(key)
    part = _part(route[first].view(np.int64), plan.parts)
    if plan.parts * len(b.number) ** 2 < 1 << 64:  # places follow numbers
        order = _order(b.packed(part, b.places[at[first] - 1], b.places[at[first] - 2]))
    else:
        order = np.lexsort((history[1][first], history[0][first], part))
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    window = back[inverse]
    first, part = first[order], part[order]
    by_window = _order(window)
    docs, times = b.doc[at][by_window].astype(np.uint32), np.bincount(window, minlength=len(first))
    n = np.bincount(window, b.train[at], minlength=len(first)).astype(np.uint32)
    ends = np.cumsum(times)
    used, lows = np.unique(part, return_index=True)
    for which, lo, hi in zip(used.tolist(), lows, [*lows[1:], len(part)], strict=True):
        rows = first[lo:hi]
        words = [history[k][rows][reach[rows] > k] for k in range(plan.depth)]
        own = [n[lo:hi], times[lo:hi].astype(np.uint32), docs[ends[lo] - times[lo] : ends[hi - 1]]]
        if level == 2:  # what the probability follows from takes less room: counts of pairs, and of each last word and symbol once
            starts = np.flatnonzero(_gaps(words[0]))
            last = b.places[at[rows[starts]] - 1]
            symbols, of = _distinct(symbol[rows])
            count = np.empty(len(symbols), np.int64)
            count[of] = b.count[b.places[at[rows]]]
            words[0] = _gaps(words[0][starts])
            sizes, kinds = np.diff(starts, append=hi - lo).astype(np.uint32), x.kinds[last]
            kept = last[kinds > 0]  # after the other words the probability is the symbol's own
            together = x.together[at[rows]][np.repeat(kinds > 0, sizes)]
            states = [sizes, kinds, _steps(b.count[kept]), x.listed[kept]]
            yield which, squeeze(reach[rows].astype(np.uint8), *words, *states, _gaps(symbols), _steps(count), of.astype(np.uint32), together, *own)
        else:
            yield which, squeeze(reach[rows].astype(np.uint8), *words, symbol[rows], _short(x.p[at[rows]]), *own)


def _window_arrays(level: int, data: bytes, root: _Root) -> list[np.ndarray]:
    """Of a chunk's windows: how far they reach, the words before, the symbols, probabilities and training tokens, the numbers of documents, and these."""
    c = expand(data)
    if level > 2:
        return c
    reach, last, *words, sizes, kinds, total, listed, symbols, count, of, together, n, times, docs = c
    each = lambda a: np.repeat(a, sizes)
    p, kept = root.probability(_from_steps(count))[of], each(kinds > 0)
    after = sizes[kinds > 0]
    p[kept] = mixed(together, *(np.repeat(a, after) for a in (_from_steps(total), kinds[kinds > 0], listed)), p[kept])
    return [reach, each(np.cumsum(last, dtype=np.uint64)), *words, np.cumsum(symbols, dtype=np.uint64)[of], p, n, times, docs]


SOLVED = "batch long, docs array<{kind}>, held array<boolean>, data binary, retained long"


def _solve(root: _Root):
    """Per partition: the contexts of all windows, level by level, and what each document's tokens come to.  Other rows go through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, at = None, [], None
        for b in batches:
            get = lambda c, b=b: b.column(b.schema.get_field_index(c))
            schema = schema or pa.schema(
                [("batch", pa.int64()), ("docs", get("docs").type), ("held", get("held").type), ("data", pa.binary()), ("retained", pa.int64())]
            )
            for i, (part, level, batch, data) in enumerate(zip(*(get(c).to_pylist() for c in ("part", "level", "batch", "data")), strict=True)):
                if level == 0:
                    yield pa.RecordBatch.from_arrays(
                        [get("batch").slice(i, 1), get("docs").slice(i, 1), get("held").slice(i, 1), get("data").slice(i, 1), pa.array([0])],
                        schema=schema,
                    )
                    continue
                if held and at != (part, level):
                    yield _solved(at[1], held, root, schema)
                    held = []
                at = part, level
                held.append((batch, data))
        if held:
            yield _solved(at[1], held, root, schema)

    return run


def _solved(level: int, rows: list[tuple], root: _Root, schema: pa.Schema) -> pa.RecordBatch:
    chunks = [_window_arrays(level, d, root) for _, d in rows]
    reach = np.concatenate([c[0] for c in chunks])
    symbol = np.concatenate([c[-5] for c in chunks]).astype(np.uint64)
    p = np.concatenate([c[-4] for c in chunks])
    n = np.concatenate([c[-3] for c in chunks])
    retained, alive, code = 0, np.arange(len(reach)), np.zeros(len(reach), np.uint64)
    for k in range(1, len(chunks[0]) - 5):
        stay = reach[alive] >= k
        alive, code = alive[stay], code[stay]
        if not len(alive):
            break
        words = np.zeros(len(reach), np.uint64)
        words[reach >= k] = np.concatenate([c[k] for c in chunks])
        code = mix64(code + words[alive])
        if k < level:
            continue
        first, inverse = _groups(mix64(code) + symbol[alive])
        total = np.bincount(inverse, n[alive], minlength=len(first)).astype(np.int64)
        names, context = _distinct(code[first])
        before = p[alive][first]
        sums = _Sums(context, len(names), total, before)
        kept = tested(*sums.all())
        retained += int(kept.sum())
        left = np.where(kept, 1 - (sums.listed - DISCOUNT * sums.kinds) / np.maximum(sums.total, 1), 1.0)
        share = np.where(kept[context] & (total >= LEAST_NEXT), (total - DISCOUNT) / np.maximum(sums.total, 1)[context], 0.0)
        p[alive] = (share + left[context] * before)[inverse]
        on = (sums.total >= LEAST_CONTEXT)[context][inverse]  # a rarer context has no longer ones
        alive, code = alive[on], code[on]
    logs, at, out = np.log10(p), 0, []
    for i, (batch, c) in enumerate(zip((r[0] for r in rows), chunks, strict=True)):
        windows = len(c[0])
        docs = c[-1]
        sums = np.bincount(docs, np.repeat(logs[at : at + windows], c[-2]))
        at += windows
        some = np.flatnonzero(np.bincount(docs))
        out.append((batch, None, None, squeeze(some.astype(np.uint32), sums[some]), retained if i == 0 else 0))
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own rows as they are, and for each batch one row of the sums that were found for its documents."""
    at, logs, retained = None, np.empty(0), 0

    def out() -> pa.RecordBatch:
        some = np.flatnonzero(logs)
        data = [[at], [None], [None], [squeeze(some.astype(np.uint32), logs[some])], [retained]]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(data, b.schema, strict=True)], schema=b.schema)

    for b in batches:
        docs = b.column(b.schema.get_field_index("docs"))
        for i, (batch, data, states) in enumerate(zip(*(column(b, c) for c in ("batch", "data", "retained")), strict=True)):
            if docs[i].is_valid:
                yield b.slice(i, 1)
                continue
            if batch != at:
                if at is not None:
                    yield out()
                at, logs, retained = batch, np.empty(0), 0
            some, sums = expand(data)
            if len(some) and some[-1] >= len(logs):
                logs = np.concatenate([logs, np.zeros(int(some[-1]) + 1 - len(logs))])
            logs[some] += sums
            retained += states
    if at is not None:
        yield out()


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own rows, each followed by the sums that were found for its documents."""
    at, own, logs = None, None, None

    def out() -> pa.RecordBatch:
        docs, held, (sizes, known, base, _) = own
        return pa.RecordBatch.from_arrays(
            [docs, held, pa.array(sizes.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(logs)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )

    for b in batches:
        docs, held = (b.column(b.schema.get_field_index(c)) for c in ("docs", "held"))
        for i, (batch, data) in enumerate(zip(column(b, "batch"), column(b, "data"), strict=True)):
            if docs[i].is_valid:
                if own is not None:
                    yield out()
                at, own = batch, (docs[i].values, held[i].values, expand(data))
                logs = own[2][3].copy()
            else:
                assert batch == at
                some, sums = expand(data)
                logs[some] += sums
    if own is not None:
        yield out()


class _Bucketed:
    """A table dealt to buckets of its batches, so that no join moves it again."""

    def __init__(self, df: DataFrame, parts: int, *folders: str):
        self.spark, self.name, self.parts, self.folders = df.sparkSession, f"suffix_tree_{uuid.uuid4().hex}", parts, folders
        self.path = f"{shared_dir(self.spark)}/{self.name}"
        atexit.register(self.drop)  # in case the computation fails
        self.add(df)

    def add(self, df: DataFrame) -> None:
        with shuffles_go(self.spark):
            writer = df.write.mode("append").partitionBy(*self.folders) if self.folders else df.write.mode("append")
            writer.bucketBy(min(self.parts, MOST_BUCKETS), "batch").option("path", self.path).saveAsTable(self.name)
        self.df = self.spark.table(self.name)

    def drop(self) -> None:
        atexit.unregister(self.drop)
        try:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            drop_table(self.spark, self.path)
        except Exception:  # noqa: BLE001 - at exit the session may be gone
            return


def _gathered(answers: DataFrame) -> DataFrame:
    return answers.where("batch IS NOT NULL").groupBy("batch").agg(F.collect_list(F.struct("part", "data")).alias("answers"))


def score(docs: DataFrame, depth: int = DEPTH, hot: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and n_states (of the whole tree) of every row."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))  # what a task holds does not grow with the input
    kind = docs.schema["doc_id"].dataType.simpleString()
    scratch = Scratch(spark)
    batches = _Bucketed(rows_of(docs).mapInArrow(_read(parts), BATCHES.format(kind=kind)), parts, "asks", "share")
    total = batches.df.where("asks = 0").agg(F.sum("trained")).first()[0] or 0
    plan = _Plan(parts, hot or max(HOT, total // MOST_HOT), depth)
    counts, kinds = [], 0
    for share, (lo, hi) in enumerate(pairwise(_shares(parts))):
        asked = batches.df.where(f"asks = 1 AND share = {share}").select("batch", "words", "counts", "bounds").mapInArrow(_ask_words(lo), ASKED)
        counts.append(scratch.table(dealt_by(asked, max(hi - lo, 1), "part", "batch").mapInArrow(_count_words(parts), COUNTED), f"word-counts-{share}"))
        kinds += counts[-1].agg(F.sum("kinds")).first()[0] or 0
        drop_table(spark, f"{batches.path}/asks=1/share={share}")
    root, counted, state = _Root(total, kinds), reduce(DataFrame.unionByName, counts), None
    for share in range(SHARES):
        own = batches.df.where(f"asks = 0 AND share = {share}").select("batch", "docs", "held", "sizes", "places")
        joined = own.join(_gathered(counted.where(f"{_SHARE} = {share}")).hint("merge"), "batch")
        learnt = joined.mapInArrow(_learn_words, STATE.format(kind=kind))
        if state:
            state.add(learnt)
        else:
            state = _Bucketed(learnt, parts)
        drop_table(spark, f"{batches.path}/asks=0/share={share}")
    batches.drop()
    scratch.drop(*counts)
    level, states, solved, pairs, turns = 1, 0, [], None, 1
    while state:
        asked = state.df.mapInArrow(_ask_pairs(level, root, plan), ASKED)
        answered = scratch.table(dealt_by(asked, parts, "part", "batch").mapInArrow(_answer_pairs(root, level), ANSWERED), f"pairs-{level}")
        retained, most = answered.agg(F.sum("retained"), F.max("most")).first()
        plan = replace(plan, states=_hot_states(answered))
        states += (retained or 0) + sum(s[2] > 0 for s in plan.states.values())
        known = state.df.join(_gathered(answered).hint("merge"), "batch", "left")
        if level == 1:  # looked up once, for all turns
            pairs = _Bucketed(known.mapInArrow(_learn_pairs(root, plan), PAIRS), parts)
            scratch.drop(answered)
            known = state.df.join(pairs.df.select("batch", "pairs").hint("merge"), "batch")
            turns = min(parts, -(-(pairs.df.agg(F.sum("far")).first()[0] or 0) // max(int(TURN_WORDS * size), 1))) or 1
        for turn in range(turns):
            windows = known.mapInArrow(_windows(level, root, plan, turn, turns), WINDOWS.format(kind=kind))
            dealt = dealt_by(windows, -(-parts // turns), "part", "level", "batch")
            found = scratch.table(dealt.mapInArrow(_solve(root), SOLVED.format(kind=kind)), f"solved-{level}-{turn}")
            solved.append(scratch.table(dealt_by(found, parts, "batch").mapInArrow(_add_up, SOLVED.format(kind=kind)), f"sums-{level}-{turn}"))
            scratch.drop(found)
        following = None
        if (most or 0) >= plan.hot and level < depth:
            following = _Bucketed(known.mapInArrow(_keep_hot(level, root, plan), STATE.format(kind=kind) + ", pairs binary"), parts)
        for table in [state, pairs] if level == 1 else [state]:
            table.drop()
        scratch.drop(answered)
        state, level, turns = following, level + 1, 1
    sums = reduce(DataFrame.unionByName, solved)
    states += sums.agg(F.sum("retained")).first()[0] or 0
    sums = dealt_by(sums.withColumn("later", F.col("docs").isNull()), parts, "batch", "later")
    rows = sums.select("batch", "docs", "held", "data").mapInArrow(
        _results,
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double",
    )
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.lit(states).cast("long").alias("n_states"),
    )


def _hot_states(answered: DataFrame) -> dict[int, tuple]:
    """(total, listed, kinds) of each hot context, the last two 0 where it is not retained.  There are MOST_HOT at most."""
    sums = answered.where("context IS NOT NULL").groupBy("context").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(5)]).collect()
    out = {}
    for c, *s in sums:
        kept = bool(tested(*(np.array([x]) for x in s))[0])
        out[c] = (s[0], s[1] if kept else 0.0, s[2] if kept else 0.0)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
