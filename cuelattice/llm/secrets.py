"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

A byte-pair vocabulary spends few tokens on text like that it was made from and
many on random characters.  So a run of 20 or more key-like characters with
fewer than ``RATIO`` characters a token is taken as a secret, unless it is a
known kind of digest (hexadecimal of a digest's length, a UUID, a subresource
hash) or an identifier (words and short numbers joined by separators, whose
case-split words have ``RATIO`` characters a token themselves).  Where a run as
a whole passes, its parts between separators are tested too, and windows of
long parts, so that readable text around a key does not hide it.

Defined cases: null text counts as empty and has no spans; spans are in code
points, end exclusive; characters that a span of the
fixed patterns covers are not tested again, the rest of their run is; very long runs are tokenised in pieces of
``PIECE`` characters, all of which count; further columns are kept by
:func:`redact` and ignored by :func:`scan`.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, column, documents, slices, text_or_empty

#: The fixed patterns, in the order of the kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
KEYWORDS = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "random"]
LEAST_VALUE = 6

#: Runs that may be keys.  Every access or hex span lies within one.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST_RUN = 20
RATIO = 2.0
PIECE = 512
DIGEST = re.compile(
    r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|sha(?:256|384|512)-[A-Za-z0-9+/=]+"
)
IDENTIFIER = re.compile(r"[+/_=-]*(?:(?:[A-Za-z]+[0-9]{0,4}|[0-9]+)(?:[+/_=-]+|\Z))+")

#: Digests within a run, and the parts of a run; a part of up to SHORT characters may stand within a key.  Long parts are also tested in windows of LEAST_RUN.
INNER_DIGEST = re.compile(rf"(?<![A-Za-z0-9])(?:{DIGEST.pattern.partition('|sha(')[0]})(?![A-Za-z0-9])")
PART = re.compile(r"[A-Za-z0-9]+")
SHORT = 4
STEP = 4
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

Span = tuple[int, int, int]


class Efficiency:
    """Characters a token under a tiktoken vocabulary."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("efficiency", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ratio(self, run: str) -> float:
        return len(run) / sum(len(self.encoding.encode_ordinary(run[i : i + PIECE])) for i in range(0, len(run), PIECE))


    def word_like(self, run: str) -> bool:
        """Whether the case-split words have RATIO characters a token, separators left out."""
        words = [w[i : i + PIECE] for w in WORD.findall(run) for i in range(0, len(w), PIECE)]
        return sum(map(len, words)) >= RATIO * sum(len(self.encoding.encode_ordinary(w)) for w in words)

    def identifier(self, run: str) -> bool:
        return IDENTIFIER.fullmatch(run) is not None and self.word_like(run)


_LOADED: dict[str, Efficiency] = {}


def efficiency(path: str) -> Efficiency:
    if path not in _LOADED:
        _LOADED[path] = Efficiency(path)
    return _LOADED[path]


def _uncovered(at: int, end: int, spans: list[Span]) -> Iterator[tuple[int, int]]:
    """The stretches of a run that no span covers."""
    for s, _, e in spans:
        if s < end and at < e:
            if at < s:
                yield at, s
            at = max(at, e)
    if at < end:
        yield at, end


def random_parts(run: str, measure: Efficiency) -> list[tuple[int, int]]:
    """Where a run is random: as a whole, or in parts between separators, or in windows of long parts."""
    if len(run) < LEAST_RUN or DIGEST.fullmatch(run):
        return []
    if not measure.identifier(run) and measure.ratio(run) < RATIO:
        return [(0, len(run))]
    out: list[tuple[int, int]] = []
    known = [(m.start(), 3, m.end()) for m in INNER_DIGEST.finditer(run)]
    for lo, hi in _uncovered(0, len(run), known):
        # Parts that are not word-like and stand side by side, with short ones between them, are one key with separators in it.
        group: list[tuple[int, int]] = []
        for m in [*PART.finditer(run, lo, hi), None]:
            if m is not None and not (m.group().isdigit() or measure.word_like(m.group())):
                group.append(m.span())
            elif m is None or not group or len(m.group()) > SHORT:
                if group:
                    a, b = group[0][0], group[-1][1]
                    if b - a >= LEAST_RUN and not DIGEST.fullmatch(run, a, b) and measure.ratio(run[a:b]) < RATIO:
                        out.append((a, b))
                group = []
        for m in PART.finditer(run, lo, hi):
            at, end = m.span()
            if end - at < 2 * LEAST_RUN - STEP or any(a <= at and end <= b for a, b in out):
                continue
            for a in [*range(at, end - LEAST_RUN, STEP), end - LEAST_RUN]:
                window = run[a : a + LEAST_RUN]
                if measure.ratio(window) < RATIO and not measure.word_like(window):
                    out.append((a, a + LEAST_RUN))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def find(text: str, measure: Efficiency) -> list[Span]:
    """(start, kind, end) of all spans, by start and then kind."""
    found: list[Span] = []
    lower = text.encode("utf-8", "surrogatepass").lower()
    if any(k in lower for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= LEAST_VALUE]
    runs = []
    for m in RUN.finditer(text):
        at, end = m.span()
        found += [(a.start(), 1, a.end()) for a in ACCESS.finditer(text, at, end)]
        found += [(a.start(), 2, a.end()) for a in HEX.finditer(text, at, end)]
        runs.append((at, end))
    base = sorted(found)
    for at, end in runs:
        for lo, hi in _uncovered(at, end, base):
            found += [(lo + a, 3, lo + b) for a, b in random_parts(text[lo:hi], measure)]
    return sorted(found)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = efficiency(vocabulary)
        for b in slices(batches):
            counts, base, spans = [[], [], [], []], [], []
            for text in column(b, "text"):
                found = find(as_text(text), measure)
                kinds = [k for _, k, _ in found]
                for k in range(4):
                    counts[k].append(kinds.count(k))
                base.append(hashlib.sha256(listed([s for s in found if s[1] < 3]).encode()).hexdigest())
                spans.append(listed(found))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {counts}, base_sha256 string, spans string")


def redact(docs: DataFrame, vocabulary: str, mask: str = "[SECRET]") -> DataFrame:
    """The rows with every found span of ``text`` replaced (overlapping spans by one mask); n_chars follows the text."""
    columns = docs.columns

    def hide(text: str | None, measure: Efficiency) -> str | None:
        spans = find(text, measure) if text else []
        if not spans:
            return text
        out, at = [], 0
        for s, _, e in spans:
            if s >= at or not out:
                out += [text[at:s], mask]
            at = max(at, e)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = efficiency(vocabulary)
        for b in slices(batches):
            i = b.schema.get_field_index("text")
            hidden = pa.array([hide(x, measure) for x in b.column(i).to_pylist()], b.schema.field(i).type)
            yield pa.RecordBatch.from_arrays([hidden if j == i else c for j, c in enumerate(b.columns)], schema=b.schema)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return scan(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))
