"""Helpers that the operators share: tables, tokens, hashes, batches."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import shared_folder

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table ``documents``."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text"):
    """The text column with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def remainder(doc_id, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or else one in the warehouse; on a cluster, a folder of one machine raises."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    return found.rstrip("/") if found else shared_folder(spark)


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table written by :func:`materialise`."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _cleanup(spark: SparkSession, path: str) -> None:
    try:
        drop_table(spark, path)
    except Exception:  # noqa: BLE001 - the session may already be gone at exit
        return


#: While this is set, Spark removes the shuffle files of a query when it ends.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind."""
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SHUFFLES)
        else:
            spark.conf.set(CLEAN_SHUFFLES, before)


def materialise(df: DataFrame, name: str, **options) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it again, which cuts its lineage; its shuffle files go.

    Returns the table and its path.  The table goes when the driver ends, or
    earlier through :func:`drop_table` once nothing lazy reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_cleanup, spark, path)
    with shuffles_go(spark):
        df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Tables of one computation: all but those that its result still reads go when it is closed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        out, path = materialise(df, name)
        self.paths.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        for out, path in self.paths:
            if any(out is t for t in tables):
                drop_table(self.spark, path)
        self.paths = [(out, path) for out, path in self.paths if not any(out is t for t in tables)]

    def close(self, *kept: DataFrame) -> None:
        self.drop(*[out for out, _ in self.paths if not any(out is k for k in kept)])


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column of ``taken`` has it, whatever the case of letters."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def dealt_by(df: DataFrame, parts: int, key: str, *order: str) -> DataFrame:
    """Rows with the same key in one task, in order."""
    return df.repartition(parts, key).sortWithinPartitions(key, *order)


def column(batch: pa.RecordBatch, name: str) -> list:
    """A column as Python values; text comes as UTF-8 bytes with null as empty."""
    c = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
        return [x or b"" for x in c.cast(pa.binary() if pa.types.is_string(c.type) else pa.large_binary()).to_pylist()]
    return c.to_pylist()


def as_text(data: bytes) -> str:
    """A text of :func:`column`.  Bytes that are no UTF-8 become the replacement character."""
    return data.decode("utf-8", "replace")


def slices(batches: Iterable[pa.RecordBatch], name: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of ``name`` at most (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        c = b.column(b.schema.get_field_index(name))
        n = np.asarray(pc.fill_null(pc.binary_length(c), 0), dtype=np.int64)
        block = np.cumsum(n) // most
        cuts = np.flatnonzero(np.diff(block)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(n)], strict=True):
            yield b.slice(int(lo), int(hi - lo))


class TokenHashes(dict):
    """Token (bytes) to a signed 64-bit hash; forgets all when it grows past ``most`` tokens."""

    most = 150_000

    def __missing__(self, token: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[token] = xxhash.xxh3_64_intdigest(token) - (1 << 63)
        return h


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# ------------------------------------------------------------------ arrays as bytes


def pack(a: np.ndarray) -> bytes:
    """Non-negative numbers in as few bytes each as the largest needs."""
    most = int(a.max()) if len(a) else 0
    size = next(n for n in (1, 2, 4, 8) if most < 1 << (8 * n))
    return bytes([size]) + a.astype(f"<u{size}").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


_ZSTD: list = []


def _planes(a: np.ndarray) -> Iterator[bytes]:
    """The bytes of the numbers, all lowest ones first, each plane compressed where that pays."""
    width = a.dtype.itemsize
    for plane in np.ascontiguousarray(a.view(np.uint8).reshape(-1, width).T):
        if not plane.any():
            yield b"\0"
            continue
        data = plane.tobytes()
        if len(data) > 256:
            if not _ZSTD:
                _ZSTD.extend([zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()])
            small = _ZSTD[0].compress(data)
            if len(small) < len(data):
                yield b"\2" + len(small).to_bytes(4, "little") + small
                continue
        yield b"\1" + data


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, byte plane by byte plane."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        out += [a.dtype.str[1:].encode(), len(a).to_bytes(4, "little"), *_planes(a)]
    return b"".join(out)


def expand(data: bytes) -> list[np.ndarray]:
    """The arrays of :func:`squeeze`."""
    out, at = [], 0
    while at < len(data):
        kind, n = np.dtype("<" + data[at : at + 2].decode()), int.from_bytes(data[at + 2 : at + 6], "little")
        at += 6
        planes = np.zeros((kind.itemsize, n), np.uint8)
        for plane in planes:
            how = data[at]
            at += 1
            if how == 1:
                plane[:] = np.frombuffer(data, np.uint8, n, at)
                at += n
            elif how == 2:
                size = int.from_bytes(data[at : at + 4], "little")
                if not _ZSTD:
                    _ZSTD.extend([zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()])
                plane[:] = np.frombuffer(_ZSTD[1].decompress(data[at + 4 : at + 4 + size], max_output_size=n), np.uint8)
                at += 4 + size
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
    return out


def runs(batches: Iterator[pa.RecordBatch], by: str, names: list[str]) -> Iterator[tuple]:
    """Rows that follow each other with the same value of ``by``: the value and the rows' values of ``names``."""
    at, held = None, []
    for b in batches:
        for value, *row in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in [by, *names]), strict=True):
            if value != at and held:
                yield at, held
                held = []
            at = value
            held.append(tuple(row))
    if held:
        yield at, held
