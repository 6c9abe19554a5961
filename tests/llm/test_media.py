"""Progressive JPEG against a plain bit-by-bit coder, and round trips of texts."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelattice.llm import progressive_jpeg as j


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> (n - 1 - i)) & 1 for i in range(n)]

    def symbol(self, kind, s):
        _, codes, sizes = j._table(kind)
        assert sizes[s], (kind, s)
        self.put(int(codes[s]), int(sizes[s]))

    def data(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        raw = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))
        return raw.replace(b"\xff", b"\xff\0")


def full_tables(monkeypatch):
    """Tables with every symbol, end-of-band runs too."""
    from functools import lru_cache

    original = j._code_lengths

    @lru_cache
    def table(kind):
        symbols = range(12) if kind == "dc" else [16 * r + s for r in range(16) for s in range(0, 11) if kind == "ac" or s < 2]
        lengths = original({s: 1.0 + (s % 3) for s in symbols})
        order = sorted(lengths, key=lambda s: (lengths[s], s))
        counts = bytes(sum(v == n for v in lengths.values()) for n in range(1, 17))
        codes, sizes, code, last = np.zeros(256, np.uint64), np.zeros(256, np.int64), 0, 0
        for s in order:
            code <<= lengths[s] - last
            last = lengths[s]
            codes[s], sizes[s] = code, last
            code += 1
        return counts + bytes(order), codes, sizes

    monkeypatch.setattr(j, "_table", table)


def shift(v, low):
    return (abs(v) >> low) * (1 if v > 0 else -1)


def first_pass(out, blocks, lo, hi, low):
    """First scan of a band over all blocks, with end-of-band runs across blocks."""
    run = 0

    def flush():
        nonlocal run
        if run:
            n = run.bit_length() - 1
            out.symbol("ac", 16 * n)
            out.put(run - (1 << n), n)
            run = 0

    for b in blocks:
        zeros = 0
        for k in range(lo, hi + 1):
            v = shift(int(b[k]), low)
            if not v:
                zeros += 1
                continue
            flush()
            while zeros > 15:
                out.symbol("ac", 0xF0)
                zeros -= 16
            n = abs(v).bit_length()
            out.symbol("ac", 16 * zeros + n)
            out.put(v if v > 0 else v + (1 << n) - 1, n)
            zeros = 0
        if zeros:
            run += 1
            if run == 0x3FFF:
                flush()
    flush()


def refine_pass(out, blocks, lo, hi, low):
    """Refinement of a band, an end of band for each block where one is due."""
    for b in blocks:
        newest = max((k for k in range(lo, hi + 1) if abs(int(b[k])) >> low == 1), default=-1)
        zeros, held = 0, []
        for k in range(lo, hi + 1):
            v = abs(int(b[k])) >> low
            if v == 0:
                zeros += 1
                continue
            while zeros > 15 and k <= newest:
                out.symbol("refine", 0xF0)
                out.bits += held
                held, zeros = [], zeros - 16
            if v > 1:
                held.append(v & 1)
                continue
            out.symbol("refine", 16 * zeros + 1)
            out.put(int(b[k] > 0), 1)
            out.bits += held
            held, zeros = [], 0
        if zeros or held:
            out.symbol("refine", 0)
            out.bits += held


def plain_file(coef, wide, high):
    """Grey progressive file without restart intervals: two bands, two refinements."""
    import struct

    head = b"\xff\xd8" + j._segment(0xDB, bytes([0]) + bytes([2]) * 64)
    head += b"".join(j._segment(0xC4, bytes([w]) + j._table(k)[0]) for w, k in ((0, "dc"), (0x10, "ac"), (0x11, "refine")))
    head += j._segment(0xC2, struct.pack(">BHHB", 8, 8 * high - 3, 8 * wide - 5, 1) + bytes([1, 0x11, 0]))

    def scan(lo, hi, high_bit, low, out):
        nonlocal head
        head += j._segment(0xDA, bytes([1, 1, 1 if high_bit and lo else 0, lo, hi, 16 * high_bit + low])) + out.data()

    out, last = Bits(), 0
    for b in coef:
        d = (int(b[0]) >> 1) - last
        last = int(b[0]) >> 1
        n = abs(d).bit_length()
        out.symbol("dc", n)
        out.put(d if d >= 0 else d + (1 << n) - 1, n)
    scan(0, 0, 0, 1, out)
    for lo, hi in ((1, 5), (6, 63)):
        first_pass(out := Bits(), coef, lo, hi, 2)
        scan(lo, hi, 0, 2, out)
    for low in (1, 0):
        refine_pass(out := Bits(), coef, 1, 63, low)
        scan(1, 63, low + 1, low, out)
    out = Bits()
    for b in coef:
        out.put(int(b[0]) & 1, 1)
    scan(0, 0, 1, 0, out)
    return head + b"\xff\xd9"


def test_general_scans(monkeypatch):
    full_tables(monkeypatch)
    rng = np.random.default_rng(4)
    files, wanted = [], []
    for wide, high, share in ((3, 2, 0.3), (4, 4, 0.05), (1, 1, 1.0), (5, 2, 0.0)):
        coef = np.where(rng.random((wide * high, 64)) < share, rng.integers(-200, 201, (wide * high, 64)), 0)
        coef[:, 1:] = np.where(rng.random((wide * high, 63)) < 0.15, rng.integers(-3, 4, (wide * high, 63)), coef[:, 1:])
        files.append(plain_file(coef, wide, high))
        wanted.append(coef)
    images = [j.Image(f) for f in files]
    for image, got, want in zip(images, j.read_coefficients(images), wanted, strict=True):
        assert np.array_equal(got, want)
        rgb = j.tensor(image, got)
        assert rgb.shape == (image.height, image.width, 3)
        # A plain inverse transform of the first block.
        block = np.zeros((8, 8))
        for n, at in enumerate(j.ZIGZAG):
            block[at // 8, at % 8] = 2 * want[0, n]
        x = np.arange(8)
        basis = np.cos((2 * x[:, None] + 1) * x[None] * np.pi / 16) / 2
        basis[:, 0] /= np.sqrt(2)
        samples = np.clip(np.round(basis @ block @ basis.T + 128), 0, 255)
        part = rgb[: min(8, image.height), : min(8, image.width), 0]
        assert np.abs(part - samples[: part.shape[0], : part.shape[1]]).max() <= 1


def test_zigzag():
    assert j.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(j.ZIGZAG) == list(range(64))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=900), min_size=1, max_size=5))
def test_round_trip(texts):
    images = [j.Image(f) for f in j.write_images(texts)]
    for t, image, coef in zip(texts, images, j.read_coefficients(images), strict=True):
        payload, n = j.payload_of(image, coef)
        assert n == len(t) and payload == t.ljust(max(64, -(-len(t) // 64) * 64), b"\0")


def test_chroma_is_upsampled():
    image = j.Image(j.write_images([bytes(384 * 5)])[0])
    coef = np.zeros((image.blocks, 64), np.int32)
    coef[image.first[3], 0] = 800  # one red-difference block
    rgb = j.tensor(image, coef)
    assert rgb.shape == (80, 16, 3) and (rgb[:16, :, 0] == rgb[0, 0, 0]).all() and rgb[0, 0, 0] > rgb[20, 0, 0] == 128


def test_damaged():
    (file,) = j.write_images([b"x" * 500])
    for bad in (b"no", file[:200], file[:-2], file.replace(b"\xff\xd0", b"", 1)):
        with pytest.raises((ValueError, IndexError)):
            j.read_coefficients([j.Image(bad)])


def test_columns(odd, odd_rows, empty):
    media = j.encode_media(odd)
    rows = j.decode_media(media).collect()
    assert len(rows) == len(odd_rows)
    want = sorted((d is None, d or 0, len((t or "").encode())) for d, t, *_ in odd_rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes) for r in rows) == want
    by_text = {hashlib.sha256((t or "").encode().ljust(max(64, -(-len((t or "").encode()) // 64) * 64), b"\0")).hexdigest(): t for _, t, *_ in odd_rows}
    for r in rows:
        payload = (by_text[r.payload_sha256] or "").encode().ljust(r.payload_bytes, b"\0")
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and len(r.tensor) == r.height * r.width * 3
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in rows}) == len(by_text)
    assert j.decode_media(j.encode_media(empty)).count() == 0


def test_random_order_is_harmless():
    rng = random.Random(2)
    texts = [rng.randbytes(rng.randrange(400)) for _ in range(20)]
    assert j.write_images(texts) == [j.write_images([t])[0] for t in texts]


def test_query_keeps_tensors_of_stored_media(spark, tmp_path):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abc de.é") for _ in range(rng.randrange(900))) for _ in range(12)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in j.query(spark, str(tmp_path)).collect():
        (file,) = j.write_images([texts[r.doc_id].encode()])
        rgb = np.frombuffer(r.tensor, np.uint8).reshape(r.height, r.width, 3)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(file), hashlib.sha256(file).hexdigest(), j.feature_of(rgb))
        image = j.Image(file)
        assert (rgb == j.tensor(image, j.read_coefficients([image])[0])).all()
