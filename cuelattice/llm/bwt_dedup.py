"""Removal of passages that stand in earlier documents, by interval expansion on a Burrows-Wheeler transform.

A byte goes if a 50-byte string that covers it also starts in a document with a
smaller doc_id.  The work is brought to where equal strings meet:

1. Every 50-byte window has an *anchor*, the least hash of its 20-byte
   substrings.  Equal windows have equal anchors, so only runs of windows whose
   anchor stands in two different texts go on.  An anchor of more than HOT texts
   is parted by a second one, the least of another hash of the same substrings,
   which equal windows share as well; those of very many texts are parted by
   anchors of longer substrings as well, so that the surroundings of a passage
   that stands everywhere do not meet at one place.
2. Such a run of windows is a snippet.  Slices of documents send each distinct
   snippet once, with its least doc_id, to the bucket of its anchor.
3. A bucket joins its distinct snippets to strings of bounded length (snippets of
   one anchor are parted by further anchors, and at last window by window, where
   they are too many for one), builds the transform of each and
   expands intervals breadth-first by backward extension: the level-l step
   finds all boundaries where neighbouring suffixes share just l symbols, for
   ascending l, and stops at 50.  What no boundary parts shares 50 bytes or
   more; the least doc_id of such a group is the answer for its windows.
4. Answers go back to the slices, which cut the documents.

Everything that moves is packed per slice of documents, so a passage that very
many documents share moves once per slice, not once per document.

Defined cases: null text counts as empty; rows with equal text are settled by
their least doc_id (all bytes of the later ones go); rows with equal doc_id
take nothing from each other; a row with a null doc_id neither gives nor loses
anything; texts under 50 bytes stay; further columns are ignored.  doc_id must be an integer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, documents, drop_table, materialise, mix64, pack, runs, slices, squeeze, text_or_empty, unpack
from .common import expand as expand_arrays

LENGTH = 50
GRAM = 20
#: Windows of one snippet at most; longer runs are cut, with their windows whole.
LONGEST = 4096
#: Symbols of one transform, about; it takes some 80 bytes a symbol.
BLOCK = 1 << 20
SLICE = 4 << 20
#: Bytes of input text for each bucket of snippets; a task holds one.
BUCKET_BYTES = 16 << 20
#: Bytes of input text for each partition of anchors, which a task holds at once.
PART_BYTES = 16 << 20
#: Texts of an anchor from which on it is parted, and how many times as many part it once more.
HOT = 256
HOTTER = 32
#: Length of the substrings of each further anchor; the last is the window itself.  Requests are parted by all but that one.
FURTHER = (GRAM, 35, 45, LENGTH)


# ----------------------------------------------------------------- anchors


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        a = np.minimum(a[:-n], a[n:])
        n *= 2
    rest = width - n
    return np.minimum(a[: len(a) - rest], a[rest:]) if rest else a


def _grams(text: bytes, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """A hash of each 20-byte substring, if the text has a window."""
    n = len(text) - gram + 1
    if len(text) < length:
        return np.zeros(0, np.uint64)
    at = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))
    h = at[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    for k in range(8, gram - 8, 8):
        h += at[k : k + n]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    h += at[gram - 8 : gram - 8 + n]
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """The anchor of each window of the text."""
    h = _grams(text, length, gram)
    return _sliding_min(h, length - gram + 1) if len(h) else h


def further_anchors(text: bytes, level: int, length: int = LENGTH) -> np.ndarray:
    """Another anchor of each window: the first further one by another hash, the later ones of longer substrings."""
    h = _grams(text, length, FURTHER[level])
    return _sliding_min(mix64(h), length - FURTHER[level] + 1) if len(h) else h


def _parted(text: bytes, keys: list[int], starts: list[int], sizes: list[int], hot: list[int]) -> list[tuple[int, int, int]]:
    """Runs (key, first window, windows), the hot ones cut where one of their windows' further anchors changes: as many of these as ``hot`` says."""
    out = list(zip(keys, starts, sizes, hot, strict=True))
    for level in range(max(hot, default=0)):
        further, rest, out = further_anchors(text, level), out, []
        for key, start, size, more in rest:
            if more <= level:
                out.append((key, start, size, more))
                continue
            inner = further[start : start + size]
            cuts = [0, *(np.flatnonzero(inner[1:] != inner[:-1]) + 1).tolist(), size]
            both = mix64(inner[cuts[:-1]] ^ mix64(np.array([key], np.uint64)))
            out += [(k, start + lo, hi - lo, more) for k, lo, hi in zip(both.tolist(), cuts[:-1], cuts[1:], strict=True)]
    return [run[:3] for run in out]


def _anchor_runs(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each run of windows with one anchor."""
    a = anchors(text)
    if not len(a):
        return a, np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1])
    sizes = np.diff(np.concatenate([starts, [len(a)]]))
    if sizes.max() > LONGEST:
        pieces = -(-sizes // LONGEST)
        first = np.repeat(np.cumsum(pieces) - pieces, pieces)
        inside = (np.arange(int(pieces.sum())) - first) * LONGEST
        ends = np.repeat(starts + sizes, pieces)
        starts = np.repeat(starts, pieces) + inside
        sizes = np.minimum(LONGEST, ends - starts)
    return a[starts], starts, sizes


# ----------------------------------------------------------------- the transform


def _rank(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and the rank of each from 1 on (equal keys alike)."""
    order = np.argsort(key)  # not the stable kind, which is several times slower; ties are equal
    ordered = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return order, rank


def _longer(rank: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and ranks by pairs of ranks: each with the one ``by`` further on (0 behind the end)."""
    n = len(rank)
    second = np.zeros(n, np.int64)
    second[: max(0, n - by)] = rank[by:]
    bits = int(n).bit_length()
    if 3 * bits > 63:
        return _rank((rank << 32) | second)
    # Pair and place fit one number: sorting numbers is quicker than sorting places by numbers.
    packed = np.sort((((rank << bits) | second) << bits) | np.arange(n))
    order = packed & ((1 << bits) - 1)
    packed >>= bits
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(np.concatenate([[True], packed[1:] != packed[:-1]]))
    return order, out


_HEAD = 7


def expand(symbols: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by their first ``length`` symbols, and boundaries of the groups that share all of these.

    ``symbols`` are 0 to 256, where 0 parts strings.  Groups of suffixes with a
    0 among their first symbols are not told apart further on; callers skip them.
    """
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64), np.ones(1, bool)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(_HEAD, np.int64)])
    head = np.zeros(n, np.int64)
    for k in range(_HEAD):
        head = (head << 9) | padded[k : k + n]
    suffixes, rank = _rank(head)
    reach = _HEAD
    while reach < length:
        by = min(reach, length - reach)
        suffixes, rank = _longer(rank, by)
        reach += by
    # The transform and its last-to-first mapping.
    before = symbols[suffixes - 1]
    to_first = np.empty(n, np.int64)
    to_first[np.argsort(before, kind="stable")] = np.arange(n)
    # Boundaries of common prefixes under 7 symbols show in the packed heads.
    ordered = head[suffixes]
    edge = np.ones(n + 1, bool)
    edge[1:n] = ordered[1:] != ordered[:-1]
    shorter = ordered >> 9
    just = np.zeros(n + 1, bool)
    just[1:n] = edge[1:n] & (shorter[1:] == shorter[:-1])
    bounds = np.flatnonzero(edge)
    queued = just[bounds[1:]]
    low, high = bounds[:-1][queued], bounds[1:][queued]
    for _ in range(_HEAD, length):
        if not len(low):
            break
        alone = high - low == 1
        one = low[alone]
        one = one[before[one] > 0]
        lows, highs = [to_first[one]], [to_first[one] + 1]
        low, high = low[~alone], high[~alone]
        if len(low):
            sizes = high - low
            owner = np.repeat(np.arange(len(low)), sizes)
            at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[owner]
            kept = before[at] > 0
            at, owner = at[kept], owner[kept]
            first = to_first[at]
            order = np.argsort(first)
            first, owner, symbol = first[order], owner[order], before[at[order]]
            if len(first):
                cut = np.flatnonzero((first[1:] != first[:-1] + 1) | (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])) + 1
                lows.append(first[np.concatenate([[0], cut])])
                highs.append(first[np.concatenate([cut, [len(first)]]) - 1] + 1)
        low, high = np.concatenate(lows), np.concatenate(highs)
        fresh = ~edge[high]
        low, high = low[fresh], high[fresh]
        # Of intervals that end at one place the first found counts; they are of one length, so there is one.
        edge[high] = True
    return suffixes, edge


def least_documents(snippets: list[bytes], docs: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each window of each snippet: the least document among all equal windows."""
    sizes = np.array([len(s) for s in snippets], np.int64)
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    flat = np.frombuffer(b"\0".join([*snippets, b""]), np.uint8)
    symbols = flat.astype(np.uint16) + 1
    symbols[ends - 1] = 0
    suffixes, edge = expand(symbols, length)
    nothing = np.iinfo(np.int64).max
    own = np.full(len(symbols), nothing)
    windows = np.maximum(sizes - length + 1, 0)
    at = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(starts, windows)
    own[at] = np.repeat(docs, windows)
    heads = np.flatnonzero(edge[:-1])
    least = np.minimum.reduceat(own[suffixes], heads)
    out = np.empty(len(symbols), np.int64)
    out[suffixes] = np.repeat(least, np.diff(np.concatenate([heads, [len(symbols)]])))
    return np.split(out[at], np.cumsum(windows)[:-1])


def _in_runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of runs: windows that follow each other mostly have one least document."""
    heads = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    return a[heads], np.diff(np.concatenate([heads, [len(a)]])).astype(np.uint32)


def _pieces(snippets: list[bytes], docs: np.ndarray, level: int) -> tuple[list[bytes], np.ndarray, np.ndarray, list[list[int]]]:
    """Distinct pieces of snippets, cut where a further anchor changes, with their anchors and least documents; and each snippet's pieces."""
    where: dict[bytes, int] = {}
    keys, least, uses = [], [], []
    sizes = np.array([len(s) for s in snippets], np.int64)
    block = np.cumsum(sizes + 1) // BLOCK
    cuts = (np.flatnonzero(np.diff(block)) + 1).tolist()
    for first, last in zip([0, *cuts], [*cuts, len(snippets)], strict=True):
        flat, own = b"".join(snippets[first:last]), sizes[first:last]
        starts = np.cumsum(own) - own
        further = further_anchors(flat, level)
        windows = own - LENGTH + 1
        owner = np.repeat(np.arange(len(own)), windows)
        at = np.arange(len(owner)) + (starts - np.cumsum(windows) + windows)[owner]
        further = further[at]
        heads = np.flatnonzero(np.concatenate([[True], (further[1:] != further[:-1]) | (owner[1:] != owner[:-1])]))
        lows, highs = at[heads], at[np.concatenate([heads[1:], [len(at)]]) - 1] + LENGTH
        uses += [[] for _ in own]
        for o, k, lo, hi in zip(owner[heads].tolist(), further[heads].tolist(), lows.tolist(), highs.tolist(), strict=True):
            piece, doc = flat[lo:hi], int(docs[first + o])
            place = where.setdefault(piece, len(keys))
            if place == len(keys):
                keys.append(k)
                least.append(doc)
            elif doc < least[place]:
                least[place] = doc
            uses[first + o].append(place)
    return list(where), np.array(keys, np.uint64), np.array(least, np.int64), uses


def least_in_runs(snippets: list[bytes], keys: np.ndarray, docs: np.ndarray, level: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """:func:`least_documents` in runs, of distinct snippets whose equal windows are in snippets of equal keys.

    Blocks hold whole keys, up to two blocks' symbols.  A key of more symbols is parted by
    the further anchors, from ``level`` on; in the end equal windows are one piece.
    """
    order = np.argsort(keys, kind="stable")
    ordered, sizes = keys[order], np.array([len(s) + 1 for s in snippets], np.int64)[order]
    heads = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
    symbols, members = np.add.reduceat(sizes, heads), np.diff(np.concatenate([heads, [len(order)]]))
    large = (symbols > BLOCK) & (members > 1) & (level < len(FURTHER))
    found: list = [None] * len(snippets)
    for head, n in zip(heads[large].tolist(), members[large].tolist(), strict=True):
        own = order[head : head + n]
        pieces, piece_keys, least, uses = _pieces([snippets[i] for i in own.tolist()], docs[own], level)
        parts = least_in_runs(pieces, piece_keys, least, level + 1)
        for i, use in zip(own.tolist(), uses, strict=True):
            values, lengths = zip(*(parts[k] for k in use), strict=True)
            found[i] = np.concatenate(values), np.concatenate(lengths)
    order, symbols = order[~np.repeat(large, members)], symbols[~large]
    if not len(order):
        return found
    ordered = keys[order]
    heads = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    cuts = heads[np.diff(symbols.cumsum() // BLOCK) > 0]
    for own in np.split(order, cuts):
        for i, windows in zip(own.tolist(), least_documents([snippets[i] for i in own.tolist()], docs[own]), strict=True):
            found[i] = _in_runs(windows)
    return found


# ----------------------------------------------------------------- moving parts


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _distinct_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[int, int]], list[int], list[bytes]]]:
    """Slices as distinct texts: their two hashes, least doc_id and bytes."""
    for b in slices(batches, most=SLICE):
        found: dict[tuple[int, int], list] = {}
        for h1, h2, doc, text in zip(*(column(b, c) for c in ("h1", "h2", "doc_id", "text")), strict=True):
            if (h1, h2) in found:
                found[h1, h2][0] = min(found[h1, h2][0], doc)
            else:
                found[h1, h2] = [doc, text]
        yield list(found), [v[0] for v in found.values()], [v[1] for v in found.values()]


def _bounds(a: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """The values of a sorted array and where each begins and ends, whatever the number of values that it might have."""
    heads = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]]).tolist() if len(a) else []
    for lo, hi in zip(heads, heads[1:], strict=False):
        yield int(a[lo]), lo, hi


ANCHORS = "part int, texts binary, counts binary, anchors binary"
TEXTS = "h1 long, h2 long, doc_id long, text binary"


def _send_anchors(parts: int):
    """Each slice's anchors by partition, text by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, _, texts in _distinct_texts(batches):
            found = [np.unique(anchors(t)) for t in texts]
            text = np.repeat(np.arange(len(texts)), [len(f) for f in found])
            key = np.concatenate(found)
            part = ((key >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((text, part))
            part, text, key = part[order], text[order], key[order]
            h1 = np.array([h for h, _ in hashes], np.int64)
            rows = []
            for p, lo, hi in _bounds(part):
                t, n = np.unique(text[lo:hi], return_counts=True)
                rows.append((p, h1[t].tobytes(), pack(n), key[lo:hi].tobytes()))
            yield _batch(rows, ANCHORS)

    return run


SHARED = "part int, texts binary, anchors binary, hot binary"


def _find_shared(parts: int, most: int):
    """Of one partition of anchors, those that stand in different texts and by how many further ones they are parted, sent on by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, "part", ["texts", "counts", "anchors"]):
            key = np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows])
            text = np.concatenate([np.repeat(np.frombuffer(r[0], np.int64), unpack(r[1])) for r in rows])
            order = np.argsort(key)
            key, text = key[order], text[order]
            heads = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            differ = np.minimum.reduceat(text, heads) != np.maximum.reduceat(text, heads)
            times = np.diff(np.concatenate([heads, [len(key)]]))
            levels = sum((times > most * HOTTER**k).astype(np.uint8) for k in range(len(FURTHER) - 1))
            shared, hot = np.repeat(differ, times), np.repeat(levels, times)
            key, text, hot = key[shared], text[shared], hot[shared]
            part = (text.view(np.uint64) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            key, text, hot = key[order], text[order], hot[order]
            yield _batch([(p, text[lo:hi].tobytes(), key[lo:hi].tobytes(), hot[lo:hi].tobytes()) for p, lo, hi in _bounds(part[order])], SHARED)

    return run


BY_TEXT = "key long, shared binary, hot binary"


def _gather_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text with shared anchors."""
    for _, rows in runs(batches, "part", ["texts", "anchors", "hot"]):
        text = np.concatenate([np.frombuffer(r[0], np.int64) for r in rows])
        key = np.concatenate([np.frombuffer(r[1], np.uint64) for r in rows])
        hot = np.concatenate([np.frombuffer(r[2], np.uint8) for r in rows])
        order = np.lexsort((key, text))
        text, key, hot = text[order], key[order], hot[order]
        heads = np.concatenate([[0], np.flatnonzero(text[1:] != text[:-1]) + 1])
        ends = np.concatenate([heads[1:], [len(text)]])
        yield _batch([(int(text[lo]), key[lo:hi].tobytes(), hot[lo:hi].tobytes()) for lo, hi in zip(heads, ends, strict=True)], BY_TEXT)


#: A request holds distinct snippets of a slice for one bucket; the row with bucket -1 holds the slice's documents and where its snippets stand.
SNIPPETS = "bucket int, slice long, snippets binary, sizes binary, anchors binary, docs binary, places binary, starts binary"


def _send_snippets(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, last = TaskContext.get().partitionId(), 0, None
        compress = zstandard.ZstdCompressor(level=1).compress
        for b in slices(batches, most=SLICE):
            where: dict[bytes, int] = {}
            snippets, keys, least, places, docs_at, starts_at, docs = [], [], [], [], [], [], []
            for h1, h2, doc, text, shared, hot in zip(*(column(b, c) for c in ("h1", "h2", "doc_id", "text", "shared", "hot")), strict=True):
                if (h1, h2) == last:  # the same text; rows are sorted by doc_id
                    continue
                last = (h1, h2)
                anchor, starts, sizes = _anchor_runs(text)
                known = np.frombuffer(shared, np.uint64)
                found = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
                kept = np.flatnonzero(known[found] == anchor) if len(anchor) else []
                if not len(kept):
                    continue
                heat = np.frombuffer(hot, np.uint8)[found[kept]].tolist()
                index = len(docs) // 3
                docs += [h1, h2, doc]
                for a, s, n in _parted(text, anchor[kept].tolist(), starts[kept].tolist(), sizes[kept].tolist(), heat):
                    snippet = text[s : s + n + LENGTH - 1]
                    place = where.setdefault(snippet, len(snippets))
                    if place == len(snippets):
                        snippets.append(snippet)
                        keys.append(a)
                        least.append(doc)
                    elif doc < least[place]:
                        least[place] = doc
                    places.append(place)
                    docs_at.append(index)
                    starts_at.append(s)
            if not snippets:
                continue
            key = np.array(keys, np.uint64)
            bucket = ((key >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            number, sizes, least_docs = (task << 40) + count, np.array([len(s) for s in snippets], np.int64), np.array(least, np.int64)
            count += 1
            rows = [
                (
                    -1,
                    number,
                    b"",
                    pack(sizes[order]),
                    b"",
                    np.array(docs, np.int64).tobytes(),
                    pack(back[np.array(places)]),
                    pack(np.array(docs_at)) + b"".join([np.array(starts_at, "<u4").tobytes()]),
                )
            ]
            for p, lo, hi in _bounds(bucket[order]):
                own = order[lo:hi]
                rows.append(
                    (
                        p,
                        number,
                        compress(b"".join([snippets[i] for i in own.tolist()])),
                        pack(sizes[own]),
                        key[own].tobytes(),
                        least_docs[own].tobytes(),
                        b"",
                        b"",
                    )
                )
            yield _batch(rows, SNIPPETS)

    return run


ANSWERS = "bucket int, slice long, least binary"


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least document of every window of a bucket's snippets, slice by slice."""
    expand_bytes = zstandard.ZstdDecompressor().decompress
    for bucket, rows in runs(batches, "bucket", ["slice", "snippets", "sizes", "anchors", "docs"]):
        where: dict[bytes, int] = {}
        snippets, keys, least, uses = [], [], [], []
        for _, data, sizes, anchor, docs in rows:
            data = expand_bytes(data)
            ends = np.cumsum(unpack(sizes))
            use = []
            for lo, hi, a, d in zip(
                [0, *ends[:-1].tolist()],
                ends.tolist(),
                np.frombuffer(anchor, np.uint64).tolist(),
                np.frombuffer(docs, np.int64).tolist(),
                strict=True,
            ):
                snippet = data[lo:hi]
                place = where.setdefault(snippet, len(snippets))
                if place == len(snippets):
                    snippets.append(snippet)
                    keys.append(a)
                    least.append(d)
                elif d < least[place]:
                    least[place] = d
                use.append(place)
            uses.append(use)
        found = least_in_runs(snippets, np.array(keys, np.uint64), np.array(least, np.int64))
        for r, use in zip(rows, uses, strict=True):
            values, lengths = (np.concatenate(x) for x in zip(*(found[i] for i in use), strict=True))
            yield _batch([(bucket, r[0], squeeze(values, lengths))], ANSWERS)


RANGES = "h1 long, h2 long, doc_id long, starts binary, ends binary"


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The byte ranges to remove from each text of a slice."""
    for _, rows in runs(batches, "slice", ["bucket", "sizes", "docs", "places", "starts", "least"]):
        rows.sort(key=lambda r: r[0])
        _, sizes, docs, places, starts, _ = rows[0]
        windows = unpack(sizes) - LENGTH + 1
        least = np.concatenate([np.repeat(*expand_arrays(r[5])) for r in rows[1:]])
        docs, places = np.frombuffer(docs, np.int64).reshape(-1, 3), unpack(places)
        at = 1 + starts[0] * len(places)
        doc_of, starts = unpack(starts[:at]), np.frombuffer(starts, "<u4", offset=at).astype(np.int64)
        n = windows[places]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        first = (np.cumsum(windows) - windows)[places]
        gone = least[np.repeat(first, n) + inside] < np.repeat(docs[doc_of, 2], n)
        where = np.unique((np.repeat(doc_of, n)[gone] << 40) + np.repeat(starts, n)[gone] + inside[gone])
        if not len(where):
            continue
        cut = np.flatnonzero(where[1:] > where[:-1] + LENGTH) + 1
        begin, end = where[np.concatenate([[0], cut])], where[np.concatenate([cut, [len(where)]]) - 1] + LENGTH
        own, mask = begin >> 40, (1 << 40) - 1
        heads = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
        out = []
        for lo, hi in zip(heads, [*heads[1:], len(own)], strict=True):
            h1, h2, doc = docs[own[lo]].tolist()
            out.append((h1, h2, doc, (begin[lo:hi] & mask).tobytes(), (end[lo:hi] & mask).tobytes()))
        yield _batch(out, RANGES)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for b in slices(batches, most=SLICE):
        out = []
        for doc, first, text, starts, ends in zip(*(column(b, c) for c in ("doc_id", "first", "text", "starts", "ends")), strict=True):
            spans = []
            if doc is not None and first is not None and len(text) >= LENGTH:
                if doc > first:
                    spans = [(0, len(text))]
                elif starts:
                    spans = list(zip(np.frombuffer(starts, np.int64).tolist(), np.frombuffer(ends, np.int64).tolist(), strict=True))
            kept, at = [], 0
            for s, e in spans:
                kept.append(text[at:s])
                at = e
            kept = b"".join([*kept, text[at:]])
            out.append((doc, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
        columns = zip(*out, strict=True)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _hashed(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(1), text).alias("h2"),
        text.alias("text"),
    )


def _candidates(rows: DataFrame, parts: int, buckets: int, hot: int) -> str:
    """Write the snippets of all slices; returns the table's path.

    A task gets one part, and later one bucket: dealt by a hash of their numbers, some tasks would hold six.
    Nothing that refers to the shuffles behind the table is left when this returns.
    """
    known = rows.where("doc_id IS NOT NULL").select("h1", "h2", "doc_id", "text")
    sent = known.mapInArrow(_send_anchors(parts), ANCHORS)
    shared = sent.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(_find_shared(parts, hot), SHARED)
    by_text = shared.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(_gather_shared, BY_TEXT)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, least, texts in _distinct_texts(batches):
            yield _batch([(*h, d, t) for h, d, t in zip(hashes, least, texts, strict=True)], TEXTS)

    texts = known.mapInArrow(distinct, TEXTS).join(by_text, F.col("h1") == F.col("key")).drop("key")
    snippets = texts.sortWithinPartitions("h1", "h2", "doc_id").mapInArrow(_send_snippets(buckets), SNIPPETS)
    return materialise(snippets, "snippets")[1]


def _removed(snippets: DataFrame, parts: int, buckets: int) -> str:
    """Write the ranges to remove from each text; returns the table's path."""
    requests = snippets.where("bucket >= 0").select("bucket", "slice", "snippets", "sizes", "anchors", "docs")
    answers = requests.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "slice").mapInArrow(_answer, ANSWERS)
    nothing = F.lit(None).cast("binary")
    states = snippets.where("bucket < 0").select("bucket", "slice", "sizes", "docs", "places", "starts", nothing.alias("least"))
    answers = answers.select("bucket", "slice", *[nothing.alias(c) for c in ("sizes", "docs", "places", "starts")], "least")
    ranges = states.unionByName(answers).repartition(parts, "slice").sortWithinPartitions("slice", "bucket").mapInArrow(_ranges, RANGES)
    return materialise(ranges, "ranges")[1]


def removals(docs: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h1, h2, text), and for each text with removals its ranges."""
    spark = docs.sparkSession
    rows = _hashed(docs)
    # By bytes, so that what a task holds does not grow with the input.  A slice and a bucket exchange one row each: small inputs have small buckets, but no more than partitions.
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(shuffles, -(-size // PART_BYTES))
    buckets = max(1, -(-size // BUCKET_BYTES), min(shuffles, size >> 20))
    path = _candidates(rows, parts, buckets, hot)
    ranges = _removed(spark.read.schema(SNIPPETS).parquet(path), parts, buckets)
    drop_table(spark, path)
    return rows, spark.read.schema(RANGES).parquet(ranges)


def dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    rows, ranges = removals(docs, hot)
    first = rows.where("doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    # Written, so that the join below has two plain sides and Spark can split a text with very many copies.
    # Slices may have held one text under several doc_ids: the ranges of its least one count.
    ranges = ranges.withColumnRenamed("doc_id", "first").dropDuplicates(["h1", "h2", "first"])
    info, _ = materialise(first.join(ranges, ["h1", "h2", "first"], "left"), "text-info")
    joined = rows.join(info, ["h1", "h2"], "left").select("doc_id", "first", "text", "starts", "ends")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))


#: By brute force over hexadecimal windows.
ORACLE = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
windows AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 49))) AS i FROM d)),
firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s),
hits AS (SELECT w.doc_id, w.i, lag(w.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS before FROM windows w JOIN firsts f ON w.s = f.s WHERE f.first < w.doc_id),
groups AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM hits),
spans AS (SELECT doc_id, g, min(i) AS a, max(i) + 50 AS b FROM groups GROUP BY doc_id, g),
gaps AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM spans),
kept AS (
  SELECT d.doc_id, any_value(length(h)) // 2 AS n_bytes, coalesce(sum(b - a), 0) AS n_removed, count(a) AS n_spans,
         coalesce(string_agg(substr(h, CAST(2 * last + 1 AS BIGINT), CAST(2 * (a - last) AS BIGINT)), '' ORDER BY a), '') || substr(any_value(h), CAST(2 * coalesce(max(b), 0) + 1 AS BIGINT)) AS rest
  FROM d LEFT JOIN gaps ON d.doc_id = gaps.doc_id GROUP BY d.doc_id)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(rest)) AS kept_sha256 FROM kept
"""
