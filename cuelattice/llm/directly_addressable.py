"""Token ids in directly addressable codes (DAC).

An id is split into chunks of 8 bits.  Level 0 holds the lowest chunk of every
id, level 1 the next chunk of those ids that go on, and so forth.  A bitmap for
each level says which ids go on, and a rank directory (the set bits before
each 512) finds an id's place on the next level.  So any id is read from a few
bytes, and no block is decoded.

A *file* of this format holds whole documents: a header, the documents' ids and
token counts, and the levels.  :func:`write_files` puts the file images in rows
of a Parquet table, in ascending order of doc_id, because only Spark's writers
reach every store; ``content`` is the image of one file.

Beside each image stands its head (documents and token counts), so that
:func:`lookup` reads the images of the files that it needs and no others.

Defined cases: doc_id must be an integer; null text counts as empty (its only id
is the end id); a null doc_id comes first; rows with equal doc_id are ordered by text; an empty table
gives no files; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, column, documents, materialise, slices, text_or_empty
from .presplit import BYTE_LEVEL, byte_symbols, is_latin1

MAGIC = b"DAC1"
EVERY = 512
END_ID = 2
#: A file ends with the first document that brings it to so many ids.
FILE_IDS = 1 << 18


def encode_levels(ids: np.ndarray) -> bytes:
    """Chunk levels with continuation bitmaps and rank directories."""
    out, rest = [], np.ascontiguousarray(ids, dtype=np.uint32)
    while True:
        more = rest >> np.uint32(8)
        goes_on = more > 0
        last = not goes_on.any()
        out.append(struct.pack("<IB", len(rest), last))
        out.append((rest & np.uint32(255)).astype(np.uint8).tobytes())
        if last:
            return b"".join(out)
        bits = np.packbits(goes_on, bitorder="little")
        ones = np.add.reduceat(goes_on, np.arange(0, len(rest), EVERY), dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4")
        out += [bits.tobytes(), ranks.tobytes()]
        rest = more[goes_on]


class Levels:
    """Random access to what :func:`encode_levels` wrote."""

    def __init__(self, data: bytes | memoryview, at: int = 0):
        self.levels = []
        last = False
        while not last:
            n, last = struct.unpack_from("<IB", data, at)
            at += 5
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            bits = ranks = None
            if not last:
                bits = np.frombuffer(data, np.uint8, (n + 7) // 8, at)
                at += len(bits)
                ranks = np.frombuffer(data, "<u4", -(-n // EVERY), at)
                at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Set bits before bit i."""
        block = min(i // EVERY, len(ranks) - 1)
        lo = block * EVERY
        head = np.unpackbits(bits[lo // 8 : (i + 7) // 8], bitorder="little")[: i - lo]
        return int(ranks[block]) + int(head.sum())

    def access(self, i: int) -> int:
        """One id."""
        value = 0
        for depth, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * depth)
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(bits, ranks, i)
        return value

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi (exclusive), from each level's own stretch alone."""
        out = np.zeros(hi - lo, np.uint32)
        where = np.arange(hi - lo)
        for depth, (chunks, bits, ranks) in enumerate(self.levels):
            if hi <= lo:
                break
            out[where] |= chunks[lo:hi].astype(np.uint32) << np.uint32(8 * depth)
            if bits is None:
                break
            first = lo // 8 * 8
            on = np.unpackbits(bits[first // 8 : (hi + 7) // 8], bitorder="little")[lo - first : hi - first].astype(bool)
            where = where[on]
            lo = self._rank(bits, ranks, lo)
            hi = lo + len(where)
        return out


def pack_file(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    known = np.array([d is not None for d in doc_ids], np.uint8)
    head = MAGIC + struct.pack("<I", len(doc_ids))
    return head + known.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(counts, "<u4").tobytes() + encode_levels(ids)


def head_size(n: int) -> int:
    """Bytes of a file before its levels, with n documents."""
    return 8 + 13 * n


def unpack_head(data: bytes) -> tuple[list[int | None], np.ndarray]:
    """doc_ids and token counts of a file, or of its head alone."""
    if data[:4] != MAGIC:
        raise ValueError("not a DAC file")
    (n,) = struct.unpack_from("<I", data, 4)
    known = np.frombuffer(data, np.uint8, n, 8)
    doc_ids = np.frombuffer(data, "<i8", n, 8 + n)
    return [int(d) if k else None for d, k in zip(doc_ids, known, strict=True)], np.frombuffer(data, "<u4", n, 8 + 9 * n)


def unpack_file(data: bytes) -> tuple[list[int | None], np.ndarray, Levels]:
    """doc_ids, token counts and the addressable ids of a file."""
    doc_ids, counts = unpack_head(data)
    return doc_ids, counts, Levels(data, head_size(len(doc_ids)))


class WordIds(dict):
    """Pre-split word to its ids (32-bit little-endian bytes) by the tokenizers library; forgets all when large."""

    most = 450_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model  # skips what a pre-split word does not need
        self.symbols = str.maketrans({chr(b): s for b, s in enumerate(byte_symbols())})
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        symbols = word.encode().decode("latin-1").translate(self.symbols)
        found = self[word] = array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a whole text.  Words are encoded one by one and remembered, as byte-level merges never cross them."""
        if not is_latin1(text) or any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.__getitem__, BYTE_LEVEL.findall(text)))


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


#: File images stand in the table as they are, each in a row group of its own: one is found and read without the others.
STORED = {
    "compression": "none",
    "parquet.enable.dictionary": "false",
    "parquet.block.size": "65536",
    "parquet.block.size.row.check.min": "1",
    "parquet.page.size.row.check.min": "1",
}

FILES = "part int, seq int, ids_before long, n_ids long, n_docs long, head binary, content binary"


def _writer(path: str, end_id: int, file_ids: int):
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, parts, counts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, before, doc_ids, parts, counts, held
            content = pack_file(doc_ids, counts, np.frombuffer(b"".join(parts), "<u4"))
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([seq], pa.int32()),
                    pa.array([before]),
                    pa.array([held]),
                    pa.array([len(doc_ids)]),
                    pa.array([content[: head_size(len(doc_ids))]], pa.binary()),
                    pa.array([content], pa.binary()),
                ],
                names=["part", "seq", "ids_before", "n_ids", "n_docs", "head", "content"],
            )
            seq, before, doc_ids, parts, counts, held = seq + 1, before + held, [], [], [], 0
            return row

        for b in slices(batches):
            for doc_id, text in zip(column(b, "doc_id"), column(b, "text"), strict=True):
                ids = words.encode(as_text(text)) + end
                doc_ids.append(doc_id)
                parts.append(ids)
                counts.append(len(ids) // 4)
                held += len(ids) // 4
                if held >= file_ids:
                    yield flush()
        if doc_ids:
            yield flush()

    return run


def write_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> tuple[DataFrame, str]:
    """Encode the documents in ascending doc_id order and write them as DAC files; returns the table of files and its path."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    # The beginning of the text parts rows of one doc_id, or without any, in the order that they have.
    rows = rows.repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    return materialise(rows.mapInArrow(_writer(tokenizer, end_id, file_ids), FILES), "dac-files", **STORED)


def read_documents(files: DataFrame) -> DataFrame:
    """Read DAC files back: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    The driver gets one number per written partition.
    """
    totals = {r.part: r.n for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    starts, total = {}, 0
    for part in sorted(totals):
        starts[part] = total
        total += totals[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "content"):
            for part, before, content in zip(column(b, "part"), column(b, "ids_before"), column(b, "content"), strict=True):
                doc_ids, counts, levels = unpack_file(content)
                ends = np.cumsum(counts.astype(np.int64))
                firsts = ends - counts
                crcs = [zlib.crc32(levels.slice(int(lo), int(hi)).astype("<u4", copy=False).tobytes()) for lo, hi in zip(firsts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(firsts + (starts[part] + before)),
                        pa.array(counts.astype(np.int64)),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.select("part", "ids_before", "content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def index_of(files: DataFrame) -> DataFrame:
    """doc_id, part, seq, first and n_tokens: where in which file each document's ids begin.  Only the files' heads are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "head"):
            for part, seq, head in zip(column(b, "part"), column(b, "seq"), column(b, "head"), strict=True):
                doc_ids, counts = unpack_head(head)
                counts, n = counts.astype(np.int64), len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(np.cumsum(counts) - counts), pa.array(counts)],
                    names=["doc_id", "part", "seq", "first", "n_tokens"],
                )

    return files.select("part", "seq", "head").mapInArrow(run, "doc_id long, part int, seq int, first long, n_tokens long")


#: So many files are named to the scan, which then skips the row groups of all others.
NAMED = 1000


def lookup(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ids at places of documents (doc_id, nth from 0 on): doc_id, nth, id.  Places that a document does not have give nothing.

    Each id is read by itself, from one byte a level and the rank directories.
    Of documents that share a doc_id, or have none, each gives its id.
    """
    index = index_of(files).withColumnRenamed("doc_id", "of")
    at = wanted.select("doc_id", "nth").join(index, F.col("doc_id").eqNullSafe(F.col("of"))).where("nth >= 0 AND nth < n_tokens")
    asked = at.groupBy("part", "seq").agg(F.collect_list(F.struct("doc_id", "nth", (F.col("first") + F.col("nth")).alias("at"))).alias("asked"))
    asked, _ = materialise(asked, "dac-asked")
    hits = asked.select("part", "seq").limit(NAMED + 1).collect()
    images = files.select("part", "seq", "content")
    if len(hits) <= NAMED:
        images = images.where(F.col("part").isin([h.part for h in hits]) & F.col("seq").isin([h.seq for h in hits]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "content"):
            for content, places in zip(column(b, "content"), column(b, "asked"), strict=True):
                levels = unpack_file(content)[2]
                found = [levels.access(p["at"]) for p in places]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p["doc_id"] for p in places], pa.int64()), pa.array([p["nth"] for p in places], pa.int64()), pa.array(found, pa.int64())],
                    names=["doc_id", "nth", "id"],
                )

    return images.join(asked, ["part", "seq"]).select("content", "asked").mapInArrow(run, "doc_id long, nth long, id long")


def lookup_query(spark, sf_dir: str) -> DataFrame:
    """The first, middle and end id of every document, each read by itself."""
    import public_tokenizers

    files, _ = write_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    n = index_of(files).select("doc_id", "n_tokens")
    return lookup(files, n.select("doc_id", F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), F.floor(F.col("n_tokens") / 2), F.col("n_tokens") - 1))).alias("nth")))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files, _ = write_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(files)
