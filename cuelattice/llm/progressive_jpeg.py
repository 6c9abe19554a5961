"""Media columns: progressive JPEG, written and read in numpy for many images at once.

Payload bytes are kept losslessly in the format's unit, the quantised
coefficient: a block of 64 bytes is a block of 64 coefficients in zigzag order.
An image has luma at full and two chroma planes at half resolution.  The scans
are DC and two bands of AC by spectral selection, each without its lowest bit,
and then one refinement of that bit for each (successive approximation).

The reader accumulates scans into coefficient arrays.  It takes any baseline-
precision progressive file of these sampling factors or of one component:
Huffman tables, end-of-band runs, refinement and restart intervals are general.
Entropy decoding walks all restart intervals of all images of a batch in step,
so numpy works on long vectors; the writer sets one interval for each MCU.
The coefficients are inverse-transformed (exactly, in scaled integers), chroma
is upsampled, and full-resolution RGB tensors come out.

Defined cases: null and empty texts have a payload of 64 zero bytes; equal
payloads give equal files, tensors and features; damaged files raise
ValueError; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, documents, materialise, slices, text_or_empty


def _zigzag() -> np.ndarray:
    """Natural index of each coefficient in zigzag order."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    cells.sort(key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


ZIGZAG = _zigzag()
#: Bytes of payload that one numpy pass handles.
CHUNK = 1 << 20
RESTART = 1


def _code_lengths(weights: dict[int, float]) -> dict[int, int]:
    """Huffman code lengths; one more symbol stands for the code of ones alone, which JPEG bars."""
    heap = [(w, s, (s,)) for s, w in weights.items()] + [(min(weights.values()) / 2, 256, (256,))]
    heapq.heapify(heap)
    lengths = defaultdict(int)
    while len(heap) > 1:
        (a, i, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            lengths[s] += 1
        heapq.heappush(heap, (a + b, i, x + y))
    del lengths[256]
    return dict(lengths)


@lru_cache
def _table(kind: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The writer's Huffman table: its DHT body (counts, symbols), and the codes and lengths by symbol."""
    if kind == "dc":
        weights = {s: 2.0 ** -abs(s - 4) for s in range(12)}
    else:
        # Letters have two or three bits besides the lowest, white space and digits six.
        sizes = {1: 0.08, 2: 0.27, 3: 0.29, 4: 0.015, 5: 0.03, 6: 0.23, 7: 0.01} | dict.fromkeys((8, 9, 10), 2.0**-12)
        weights = {16 * r + s: max(w * 2.0 ** (-5 * min(r, 2)), 2.0**-12) for r in range(16) for s, w in sizes.items()}
        weights |= {0x00: 2.0**-6, 0xF0: 2.0**-12}
        if kind == "refine":
            weights = {0x00: 1.0, 0xF0: 2.0**-6} | {16 * r + 1: 2.0**-6 for r in range(16)}
    lengths = _code_lengths(weights)
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    assert max(lengths.values()) <= 16
    counts = bytes(sum(v == n for v in lengths.values()) for n in range(1, 17))
    codes, sizes = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    code = last = 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s], sizes[s] = code, last
        code += 1
    return counts + bytes(order), codes, sizes


# --------------------------------------------------------------------------- writer


def layout(blocks: int) -> tuple[int, int]:
    """Width and height in MCUs for so many payload blocks (4 of luma and 2 of chroma an MCU)."""
    mcus = max(1, -(-blocks // 6))
    wide = -(-mcus // 4000)
    return wide, -(-mcus // wide)


def _mcu_order(wide: int, high: int) -> np.ndarray:
    """Blocks (luma in raster order, then both chromas) in the order of interleaved scans."""
    y, x = np.divmod(np.arange(wide * high), wide)
    first = 2 * y * 2 * wide + 2 * x
    luma = 4 * wide * high
    m = np.arange(wide * high)
    return np.stack([first, first + 1, first + 2 * wide, first + 2 * wide + 1, luma + m, luma + wide * high + m], 1).ravel()


def _pack(values: np.ndarray, sizes: np.ndarray, per: np.ndarray, last_of_image: np.ndarray, restart_no: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each interval, filled up with ones, stuffed, with restart markers; and where each interval ends.

    ``per`` counts an interval's values; its last one is the place for the fill bits.
    """
    fill_at = np.cumsum(per) - 1
    fill = -np.add.reduceat(sizes, fill_at + 1 - per) % 8
    sizes[fill_at] = fill
    values[fill_at] = (1 << fill) - 1
    ends = np.cumsum(sizes)
    byte_ends = ends[fill_at] >> 3
    at = ends - sizes
    word = at >> 5
    values <<= (64 - sizes - (at & 31)).astype(np.uint64)
    starts = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts = np.concatenate([[0], starts])
    out = np.zeros(int(byte_ends[-1]) // 4 + 2, np.uint64)
    out[word[starts]] |= np.bitwise_or.reduceat(values >> np.uint64(32), starts)
    out[word[starts] + 1] |= np.bitwise_or.reduceat(values & np.uint64(0xFFFFFFFF), starts)
    data = out.astype(">u4").view(np.uint8)[: byte_ends[-1]]
    room = np.add(data == 255, 1, dtype=np.int64)
    marked = np.flatnonzero(~last_of_image)
    room[byte_ends[marked] - 1] += 2
    ends = np.cumsum(room)
    stuffed = np.zeros(int(ends[-1]), np.uint8)
    stuffed[ends - room] = data
    marks = ends[byte_ends[marked] - 1]
    stuffed[marks - 2] = 255
    stuffed[marks - 1] = 0xD0 + restart_no[marked] % 8
    return stuffed, ends[byte_ends - 1]


_BITS = np.array([n.bit_length() for n in range(4096)], np.int64)
_OFFSET = 2048


@lru_cache
def _signed_codes(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """For each number (plus _OFFSET) without a run before it: its code with the bits of its value, and their size."""
    v = np.arange(-_OFFSET, _OFFSET)
    _, codes, sizes = _table(kind)
    n = _BITS[np.abs(v)]
    low = np.where(v < 0, v + (1 << n) - 1, v)
    return (codes[n] << n.astype(np.uint64)) | low.astype(np.uint64), sizes[n] + n


def _dc_first(coef: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, ...]:
    dc = (coef[order, 0] >> 1).reshape(-1, 6)
    diff = dc.copy()
    diff[:, 1:4] -= dc[:, :3]  # predictions start anew with each interval of one MCU
    codes, sizes = _signed_codes("dc")
    values, bits = np.zeros((len(dc), 7), np.uint64), np.zeros((len(dc), 7), np.int64)
    values[:, :6], bits[:, :6] = codes[diff + _OFFSET], sizes[diff + _OFFSET]
    return values.ravel(), bits.ravel(), np.full(len(dc), 7)


def _dc_refine(coef: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, ...]:
    n = len(order) // 6
    values, bits = np.zeros((n, 7), np.uint64), np.ones((n, 7), np.int64)
    values[:, :6] = (coef[order, 0] & 1).reshape(-1, 6)
    bits[:, 6] = 0
    return values.ravel(), bits.ravel(), np.full(n, 7)


def _ac_first(coef: np.ndarray, order: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, ...]:
    """One block an interval: run-length symbols, and an end of band where zeros are left."""
    band = coef[order, lo : hi + 1]
    shifted = (np.abs(band) >> 1) * np.sign(band)
    some = shifted != 0
    lanes = len(order)
    n = some.sum(1)
    codes, sizes = _signed_codes("ac")
    if n.min() == hi - lo + 1:  # no zeros: every block has the same places
        values, bits = np.zeros((lanes, hi - lo + 2), np.uint64), np.zeros((lanes, hi - lo + 2), np.int64)
        shifted += _OFFSET
        values[:, :-1], bits[:, :-1] = codes[shifted], sizes[shifted]
        return values.ravel(), bits.ravel(), np.full(lanes, hi - lo + 2)
    block, k = np.nonzero(some)
    v = shifted[some]
    gap = np.diff(k, prepend=-1) - 1
    first = (np.cumsum(n) - n)[n > 0]
    gap[first] = k[first]
    long_runs = gap >> 4
    last = np.full(lanes, -1)
    last[block] = k
    ends = last < hi - lo
    long_total = np.cumsum(long_runs)
    per = n + ends + 1
    np.add.at(per, block[long_runs > 0], long_runs[long_runs > 0])
    place = np.arange(len(k)) + long_total + (np.cumsum(ends + 1) - ends - 1)[block]
    total = int(per.sum())
    _, plain, plain_sizes = _table("ac")
    values, bits = np.full(total, plain[0xF0], np.uint64), np.full(total, plain_sizes[0xF0], np.int64)
    values[place], bits[place] = codes[v + _OFFSET], sizes[v + _OFFSET]
    runs = np.flatnonzero(gap & 15)
    size = _BITS[np.abs(v[runs])]
    symbol = 16 * (gap[runs] & 15) + size
    low = np.where(v[runs] < 0, v[runs] + (1 << size) - 1, v[runs]).astype(np.uint64)
    values[place[runs]] = (plain[symbol] << size.astype(np.uint64)) | low
    bits[place[runs]] = plain_sizes[symbol] + size
    fill_at = np.cumsum(per) - 1
    values[fill_at], bits[fill_at] = 0, 0
    values[fill_at[ends] - 1], bits[fill_at[ends] - 1] = plain[0], plain_sizes[0]
    return values, bits, per


def _ac_refine(coef: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, ...]:
    """The writer's magnitudes are 0 or over 1, so no coefficient becomes nonzero here: an end of band, then correction bits."""
    band = np.abs(coef[order, 1:])
    lanes = len(order)
    _, codes, sizes = _table("refine")
    values, bits = np.zeros((lanes, 65), np.uint64), np.zeros((lanes, 65), np.int64)
    values[:, 0], bits[:, 0] = codes[0], sizes[0]
    values[:, 1:64] = band & 1
    bits[:, 1:64] = band != 0  # a zero has no correction bit: a value of no bits
    return values.ravel(), bits.ravel(), np.full(lanes, 65)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


#: (components, first and last coefficient, high and low bit, kind).
SCRIPT = [
    ((1, 2, 3), 0, 0, 0, 1),
    ((1,), 1, 5, 0, 1),
    ((2,), 1, 63, 0, 1),
    ((3,), 1, 63, 0, 1),
    ((1,), 6, 63, 0, 1),
    *(((c,), 1, 63, 1, 0) for c in (1, 2, 3)),
    ((1, 2, 3), 0, 0, 1, 0),
]


@lru_cache
def _scan_header(step: int) -> bytes:
    components, lo, hi, high, low = SCRIPT[step]
    body = bytes([len(components), *(b for c in components for b in (c, 0x01 if high and lo else 0x00)), lo, hi, 16 * high + low])
    return _segment(0xDA, body)


@lru_cache
def _tables() -> bytes:
    quantisation = _segment(0xDB, bytes([0]) + bytes([1]) * 64)
    huffman = b"".join(_segment(0xC4, bytes([where]) + _table(kind)[0]) for where, kind in ((0x00, "dc"), (0x10, "ac"), (0x11, "refine")))
    return quantisation + huffman + _segment(0xDD, struct.pack(">H", RESTART))


#: The byte that becomes the coefficient 0, amid the small letters, so that most coefficients are small.
CENTRE = 110


def to_coefficients(payload: np.ndarray) -> np.ndarray:
    """Bytes, as signed numbers around CENTRE moved away from zero by one (0 stays), so that magnitudes are never 1."""
    v = (payload - np.uint8(CENTRE)).view(np.int8).astype(np.int32)
    return v + np.sign(v)


def from_coefficients(coef: np.ndarray) -> np.ndarray:
    return (coef - np.sign(coef)).astype(np.int8).view(np.uint8) + np.uint8(CENTRE)


def write_images(texts: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each text's padded payload."""
    sizes = [max(64, -(-len(t) // 64) * 64) for t in texts]
    layouts = [layout(n // 64) for n in sizes]
    blocks = np.array([6 * w * h for w, h in layouts])
    buffer = np.full(int(blocks.sum()) * 64, CENTRE, np.uint8)
    starts = np.cumsum(blocks) - blocks
    for t, n, s in zip(texts, sizes, starts, strict=True):
        buffer[64 * s : 64 * s + len(t)] = np.frombuffer(t, np.uint8)
        buffer[64 * s + len(t) : 64 * s + n] = 0
    coef = to_coefficients(buffer).reshape(-1, 64)
    mcus = blocks // 6
    parts: list[list[bytes]] = []
    for t, n, (w, h) in zip(texts, sizes, layouts, strict=True):
        frame = struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        parts.append([b"\xff\xd8", _segment(0xFE, b"payload %d text %d" % (n, len(t))), _tables(), _segment(0xC2, frame)])
    interleaved = np.concatenate([s + _mcu_order(w, h) for s, (w, h) in zip(starts, layouts, strict=True)])
    # Blocks of each component, image after image, and how many an image has.
    per_image = {1: 4 * mcus, 2: mcus, 3: mcus}
    offset = {1: 0 * mcus, 2: 4 * mcus, 3: 5 * mcus}
    component = {}
    for c in (1, 2, 3):
        n = per_image[c]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        component[c] = np.repeat(starts + offset[c], n) + inside
    for step, (components, lo, hi, high, _) in enumerate(SCRIPT):
        if lo == 0:
            n = mcus
            coded = (_dc_refine if high else _dc_first)(coef, interleaved)
        else:
            order, n = component[components[0]], per_image[components[0]]
            coded = _ac_refine(coef, order) if high else _ac_first(coef, order, lo, hi)
        ends = np.cumsum(n)
        last = np.zeros(int(ends[-1]), bool)
        last[ends - 1] = True
        data, lane_ends = _pack(*coded, last, np.arange(len(last)) - np.repeat(ends - n, n))
        cuts = lane_ends[ends - 1]
        for p, a, e in zip(parts, [0, *cuts[:-1]], cuts, strict=True):
            p += [_scan_header(step), data[a:e].tobytes()]
    return [b"".join([*p, b"\xff\xd9"]) for p in parts]


# --------------------------------------------------------------------------- reader


@lru_cache(maxsize=64)
def _lookup(body: bytes) -> np.ndarray:
    """For each 16 bits: code length and symbol (256 * length + symbol; 0 where no code begins so)."""
    out = np.zeros(1 << 16, np.int32)
    code, at = 0, 16
    for size in range(1, 17):
        for _ in range(body[size - 1]):
            lo = code << (16 - size)
            out[lo : lo + (1 << (16 - size))] = 256 * size + body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


#: A marker that ends the bits of a scan.
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.DOTALL)


class Image:
    """The parsed structure of one file."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        self.data, self.comment, self.scans = data, b"", []
        self.quantisation: dict[int, np.ndarray] = {}
        huffman: dict[int, bytes] = {}
        restart, at = 0, 2
        while True:
            if at + 2 > len(data) or data[at] != 255:
                raise ValueError("damaged file")
            marker = data[at + 1]
            if marker == 0xD9:
                break
            (size,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quantisation[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = 16 + sum(body[1:17])
                    huffman[body[0]] = body[1 : 1 + n]
                    body = body[1 + n :]
            elif marker == 0xDD:
                (restart,) = struct.unpack(">H", body)
            elif marker == 0xC2:
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                self._lay_out()
            elif marker == 0xDA:
                n = body[0]
                chosen = tuple(body[1 + 2 * i] for i in range(n))
                ids = [body[2 + 2 * i] for i in range(n)]
                lo, hi, bits = body[1 + 2 * n : 4 + 2 * n]
                tables = tuple(huffman.get(i >> 4 if lo == 0 else 16 + (i & 15), b"") for i in ids)
                found = _MARKER.search(data, at)
                if not found:
                    raise ValueError("damaged file")
                end = found.start()
                self.scans.append(((chosen, lo, hi, bits >> 4, bits & 15, tables), restart, at, end))
                at = end
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("not a progressive file with Huffman codes")

    def _lay_out(self) -> None:
        self.h_max, self.v_max = max(c[1] for c in self.components), max(c[2] for c in self.components)
        self.wide, self.high = -(-self.width // (8 * self.h_max)), -(-self.height // (8 * self.v_max))
        self.first, at = {}, 0
        for c, h, v, _ in self.components:
            self.first[c] = at
            at += self.wide * h * self.high * v
        self.blocks = at

    def order(self, chosen: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
        """Blocks in the order of a scan, the component of each, and the blocks of an MCU."""
        by_id = {c: (h, v) for c, h, v, _ in self.components}
        if len(chosen) == 1:
            h, v = by_id[chosen[0]]
            across = -(-(-(-self.width * h // self.h_max)) // 8)
            down = -(-(-(-self.height * v // self.v_max)) // 8)
            y, x = np.divmod(np.arange(across * down), across)
            return self.first[chosen[0]] + y * self.wide * h + x, np.zeros(across * down, np.int64), 1
        my, mx = np.divmod(np.arange(self.wide * self.high), self.wide)
        cells, owner = [], []
        for i, c in enumerate(chosen):
            h, v = by_id[c]
            for dy in range(v):
                for dx in range(h):
                    cells.append(self.first[c] + (my * v + dy) * self.wide * h + mx * h + dx)
                    owner.append(i)
        return np.stack(cells, 1).ravel(), np.tile(owner, self.wide * self.high), len(owner)


class _Bits:
    """Bit strings of all lanes, with a 64-bit window at every byte."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate([data, np.zeros(16, np.uint8)])
        w = np.zeros(len(data) + 8, np.uint64)
        for i in range(8):
            w = (w << np.uint64(8)) | self.data[i : i + len(w)]
        self.window = w

    def at(self, pos: np.ndarray) -> np.ndarray:
        pos = np.minimum(pos, 8 * (len(self.window) - 1))
        return self.window[pos >> 3] << (pos & 7).astype(np.uint64)

    def bit(self, pos: np.ndarray) -> np.ndarray:
        pos = np.minimum(pos, 8 * (len(self.data) - 1))
        return (self.data[pos >> 3] >> (7 - (pos & 7))) & 1


def _take(w: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n bits (under 32) after the first ``skip`` of each window."""
    return ((w << skip.astype(np.uint64)) >> np.uint64(32) >> (32 - n).astype(np.uint64)).astype(np.int64)


def _extend(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where((n > 0) & (v < (1 << np.maximum(n - 1, 0))), v - (1 << n) + 1, v)


def _symbol(w: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = table[(w >> np.uint64(48)).astype(np.int64)]
    if len(found) and not found.all():
        raise ValueError("damaged file: no such code")
    return found >> 8, found & 255


def _read_dc(coef, bits, pos, first, count, order, owner, key):
    _, _, _, high, low, tables = key
    if high:
        n = int(count.max())
        for t in range(n):
            on = np.flatnonzero(count > t)
            coef[order[first[on] + t], 0] |= bits.bit(pos[on] + t).astype(np.int32) << low
        return
    lookups = [_lookup(t) for t in tables]
    pred = np.zeros((len(pos), len(tables)), np.int64)
    for t in range(int(count.max())):
        on = np.flatnonzero(count > t)
        own = owner[first[on] + t]
        for c in np.unique(own):
            lanes = on[own == c]
            w = bits.at(pos[lanes])
            size, n = _symbol(w, lookups[c])
            pred[lanes, c] += _extend(_take(w, size, n), n)
            coef[order[first[lanes] + t], 0] = pred[lanes, c] << low
            pos[lanes] += size + n


def _read_ac_first(coef, bits, pos, first, count, order, key):
    _, lo, hi, _, low, tables = key
    table = _lookup(tables[0])
    at, left, k = first.copy(), count.copy(), np.full(len(pos), lo)
    alive = left > 0
    pos, at, left, k = pos[alive], at[alive], left[alive], k[alive]
    while len(pos):
        w = bits.at(pos)
        size, symbol = _symbol(w, table)
        run, n = symbol >> 4, symbol & 15
        band_end = (n == 0) & (run < 15)
        extra = np.where(band_end, run, n)
        v = _take(w, size, extra)
        pos = pos + size + extra
        k = k + run
        some = np.flatnonzero(n)
        if len(some):
            if k[some].max() > hi:
                raise ValueError("damaged file: coefficient out of band")
            coef[order[at[some]], k[some]] = _extend(v[some], n[some]) << low
        k += 1
        over = band_end | (k > hi)
        if over.any():
            step = np.where(band_end, (1 << run) + v, 1) * over
            at, left = at + step, left - step
            k[over] = lo
            alive = left > 0
            if not alive.all():
                pos, at, left, k = pos[alive], at[alive], left[alive], k[alive]


def _read_ac_refine(coef, bits, pos, first, count, order, key):
    _, lo, hi, _, low, tables = key
    table = _lookup(tables[0])
    at, left = first.copy(), count.copy()
    k, band_run = np.full(len(pos), lo), np.zeros(len(pos), np.int64)
    alive = left > 0
    pos, at, left, k, band_run = (x[alive] for x in (pos, at, left, k, band_run))
    cells = np.arange(lo, hi + 1)
    while len(pos):
        pos = pos.copy()
        sign = np.zeros(len(pos), np.int64)
        zeros = np.full(len(pos), 1 << 20)  # of the zeros to pass, then to fill or end at
        fresh = np.flatnonzero(band_run == 0)
        if len(fresh):
            w = bits.at(pos[fresh])
            size, symbol = _symbol(w, table)
            run, n = symbol >> 4, symbol & 15
            band_end = (n == 0) & (run < 15)
            extra = np.where(band_end, run, np.minimum(n, 1))
            v = _take(w, size, extra)
            pos[fresh] += size + extra
            band_run[fresh] = np.where(band_end, (1 << run) + v, 0)
            zeros[fresh] = np.where(band_end, 1 << 20, run)
            sign[fresh] = np.where(n > 0, 2 * v - 1, 0)
        block = order[at]
        band = coef[block, lo : hi + 1]
        old = (band != 0) & (cells >= k[:, None])
        passed = np.cumsum((band == 0) & (cells >= k[:, None]), 1)
        # The place: the first zero after those to pass, else behind the band.
        hit = (passed == (zeros + 1)[:, None]).argmax(1)
        found = passed[:, -1] > zeros
        stop = np.where(found, hit + lo, hi + 1)
        old &= cells < stop[:, None]
        r, c = np.nonzero(old)
        per = old.sum(1)
        offset = np.arange(len(r)) - np.repeat(np.cumsum(per) - per, per)
        b = bits.bit(pos[r] + offset).astype(np.int32) << low
        values = band[r, c]
        coef[block[r], c + lo] = values + np.sign(values) * b
        pos = pos + per
        put = np.flatnonzero(found & (sign != 0))
        coef[block[put], stop[put]] = sign[put] << low
        k = stop + 1
        over = k > hi
        band_run = np.where(over & (band_run > 0), band_run - 1, band_run)
        at, left = at + over, left - over
        k = np.where(over, lo, k)
        alive = left > 0
        pos, at, left, k, band_run = (x[alive] for x in (pos, at, left, k, band_run))


def read_coefficients(images: list[Image]) -> list[np.ndarray]:
    """Accumulate the scans of all images; each image's blocks in zigzag order."""
    starts = np.cumsum([0, *(i.blocks for i in images)])
    coef = np.zeros((int(starts[-1]), 64), np.int32)
    orders: dict = {}
    for turn in range(max((len(i.scans) for i in images), default=0)):
        groups = defaultdict(list)
        for n, image in enumerate(images):
            if turn < len(image.scans):
                groups[image.scans[turn][0]].append(n)
        for key, members in groups.items():
            raws, blocks, owners, counts, at = [], [], [], [], 0
            splits = []
            for n in members:
                image = images[n]
                _, restart, a, e = image.scans[turn]
                shape = (image.width, image.height, tuple(image.components), key[0])
                if shape not in orders:
                    orders[shape] = image.order(key[0])
                order, owner, mcu = orders[shape]
                per = restart * mcu if restart else len(order)
                lanes = -(-len(order) // per)
                counts.append(np.full(lanes, per))
                counts[-1][-1] = len(order) - per * (lanes - 1)
                blocks.append(order + starts[n])
                owners.append(owner)
                raws.append(np.frombuffer(image.data, np.uint8, e - a, a))
                splits.append(at)
                at += e - a
            raw = np.concatenate(raws)
            ff = raw == 255
            after = np.concatenate([raw[1:], [0]])
            stuffed = np.flatnonzero(ff & (after == 0))
            marks = np.flatnonzero(ff & (after >= 0xD0) & (after <= 0xD7))
            keep = np.ones(len(raw), bool)
            keep[np.minimum(stuffed + 1, len(raw) - 1)] = False
            keep[marks] = keep[marks + 1] = False
            new = np.cumsum(keep) - keep
            lane_starts = np.sort(np.concatenate([new[np.array(splits, np.int64)], new[marks]]))
            count = np.concatenate(counts)
            if len(lane_starts) != len(count):
                raise ValueError("damaged file: restart intervals are missing")
            bits = _Bits(raw[keep])
            first = np.cumsum(count) - count
            order = np.concatenate(blocks)
            if key[1] == 0:
                _read_dc(coef, bits, 8 * lane_starts, first, count, order, np.concatenate(owners), key)
            else:
                (_read_ac_refine if key[3] else _read_ac_first)(coef, bits, 8 * lane_starts, first, count, order, key)
    return [coef[a:e] for a, e in zip(starts[:-1], starts[1:], strict=True)]


@lru_cache
def _inverse() -> np.ndarray:
    """Zigzag coefficients to samples, times 2**16, in whole numbers."""
    x = np.arange(8)
    basis = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) / 2
    basis[:, 0] /= np.sqrt(2)
    full = np.einsum("yv,xu->vuyx", basis, basis).reshape(64, 64)
    return np.round(full[ZIGZAG] * (1 << 16))


def tensor(image: Image, coef: np.ndarray) -> np.ndarray:
    """Full-resolution RGB (height, width, 3) of one image."""
    planes = []
    for c, h, v, q in image.components:
        n = image.wide * h * image.high * v
        scaled = coef[image.first[c] : image.first[c] + n] * image.quantisation[q]
        samples = np.floor((scaled.astype(np.float64) @ _inverse()) / (1 << 16) + 0.5) + 128
        plane = np.clip(samples, 0, 255).astype(np.uint8).reshape(image.high * v, image.wide * h, 8, 8)
        plane = plane.transpose(0, 2, 1, 3).reshape(image.high * v * 8, image.wide * h * 8)
        plane = plane.repeat(image.v_max // v, 0).repeat(image.h_max // h, 1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2)
    y, cb, cr = (p.astype(np.int32) for p in planes)
    cb -= 128
    cr -= 128
    half = 1 << 15
    # The weights of the standard's colour conversion, times 2**16.
    red = y + ((91881 * cr + half) >> 16)
    green = y - ((22554 * cb + 46802 * cr + half) >> 16)
    blue = y + ((116130 * cb + half) >> 16)
    return np.clip(np.stack([red, green, blue], 2), 0, 255).astype(np.uint8)


def payload_of(image: Image, coef: np.ndarray) -> tuple[bytes, int]:
    """The payload that :func:`write_images` stored, and the text's bytes in it."""
    _, n, _, text = image.comment.split(b" ")
    return from_coefficients(coef).tobytes()[: int(n)], int(text)


def feature_of(rgb: np.ndarray) -> str:
    """Size and channel means in thousandths of the tensor."""
    sums = rgb.reshape(-1, 3).sum(0, dtype=np.int64)
    n = rgb.shape[0] * rgb.shape[1]
    return f"{rgb.shape[0]}x{rgb.shape[1]}:" + ",".join(str(int(s) * 1000 // n) for s in sums)


# --------------------------------------------------------------------------- columns


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id and ``media``, the stored file, of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", CHUNK):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(write_images(column(b, "text")), pa.binary())], names=["doc_id", "media"])

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary")


def decode_media(media: DataFrame, tensors: bool = True) -> DataFrame:
    """Read the files back: payload figures, the feature and (if asked for) the RGB tensor with its height and width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "media", CHUNK):
            rows = []
            files = b.column(b.schema.get_field_index("media")).to_pylist()
            images = [Image(f) for f in files]
            for file, image, coef in zip(files, images, read_coefficients(images), strict=True):
                payload, n = payload_of(image, coef)
                rgb = tensor(image, coef)
                row = [
                    n,
                    len(payload),
                    hashlib.sha256(payload).hexdigest(),
                    zlib.crc32(payload[-64:]),
                    len(file),
                    hashlib.sha256(file).hexdigest(),
                    feature_of(rgb),
                ]
                rows.append([*row, rgb.shape[0], rgb.shape[1], rgb.tobytes()] if tensors else row)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))],
                names=["doc_id", *names],
            )

    fields = [
        "n_bytes long",
        "payload_bytes long",
        "payload_sha256 string",
        "tail_crc32 long",
        "media_bytes long",
        "media_sha256 string",
        "feature string",
    ]
    if tensors:
        fields += ["height int", "width int", "tensor binary"]
    arrow = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
    names, kinds = [f.split()[0] for f in fields], [arrow[f.split()[1]] for f in fields]
    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, " + ", ".join(fields))


#: Files of many small images repeat their headers, which the table's compression takes up.
STORED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6"}


def query(spark, sf_dir: str) -> DataFrame:
    """The media column is stored as a table in the shared folder and read back from there; figures, features and RGB tensors come from what was read."""
    media, _ = materialise(encode_media(documents(spark, sf_dir)), "media", **STORED)
    return decode_media(media)
