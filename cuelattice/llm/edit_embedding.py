"""Document fingerprints by a randomised edit embedding.

Every text is walked with the same random bits: at step j the walk writes the
character it stands on and then moves on or stays, as the bit for (j, this
character) says.  Texts a few edits apart fall back into step, so the number of
edits shows as a Hamming distance between what the walks wrote (3 steps for
each character).  A fingerprint keeps sampled steps, the same for all texts:
all of the first 64, and 64 of each further doubling of the length.  A sampled
step is kept as 4 hashed bits, one hexadecimal digit.

Near texts are found by bit-sampled banding and verification: bands of sampled
digits propose candidates, which are verified by the likeness of their whole
fingerprints.  The query gives the class and the number of links of every text
beside its fingerprints.

Defined cases: null text counts as empty and has the fingerprint ""; two empty
texts have likeness 1; equal texts have equal fingerprints; documents follow
each other by descending doc_id (an integer), nulls last, rows with the same doc_id by text;
a table of one row is its own next document; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_text, column, documents, mix64, slices, text_or_empty
from .components import components

SAMPLES = 64
STEPS = 3
PERIOD = 1024
SEED = 20240229
#: Bytes of text that one numpy pass walks.
CHUNK = 6 << 20


@lru_cache
def _moves() -> np.ndarray:
    """Whether the walk moves on, by step (modulo PERIOD) and character class; class 0 is the end of a text."""
    moves = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2, (PERIOD, 256), dtype=np.int32)
    moves[:, 0] = 0
    return moves


@lru_cache
def sampled_steps(length: int) -> np.ndarray:
    """Sampled steps below ``length``, ascending; those of a shorter length come first."""
    steps, at = list(range(min(SAMPLES, length))), SAMPLES
    while at < length:
        chosen = np.random.Generator(np.random.PCG64([SEED, at])).choice(at, SAMPLES, replace=False) + at
        steps += sorted(int(s) for s in chosen if s < length)
        at *= 2
    return np.array(steps, np.int64)


@lru_cache(maxsize=4096)
def _strata(length: int) -> np.ndarray:
    """How many steps each sampled step stands for."""
    steps = sampled_steps(length)
    weight = np.ones(len(steps))
    at = SAMPLES
    while at < length:
        inside = (steps >= at) & (steps < 2 * at)
        if inside.any():
            weight[inside] = (min(2 * at, length) - at) / inside.sum()
        at *= 2
    return weight


_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprints of many texts, walked in step."""
    if not texts:
        return []
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    flat = (points % np.uint32(255) + np.uint32(1)).astype(np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    flat[ends] = 0
    order = np.argsort(-sizes, kind="stable")
    sizes, pos = sizes[order], (ends - sizes)[order].astype(np.int32)
    longest = STEPS * int(sizes[0])
    steps = sampled_steps(longest)
    kept = np.zeros((len(texts), len(steps)), np.uint8)
    moves, alive, at = _moves(), int((sizes > 0).sum()), 0
    wanted = dict(zip(steps.tolist(), range(len(steps)), strict=True))
    total = STEPS * sizes
    while at < longest and alive:
        lanes = pos[:alive]
        for j in range(at, min(at + 64, longest)):
            here = flat[lanes]
            s = wanted.get(j)
            if s is not None:
                kept[:alive, s] = here
            lanes += moves[j % PERIOD][here]
        at += 64
        while alive and (flat[pos[alive - 1]] == 0 or total[alive - 1] <= at):
            alive -= 1
    counts = np.searchsorted(steps, total)
    salt = mix64(np.arange(len(steps), dtype=np.uint64) + np.uint64(SEED))
    digits = _HEX[((mix64(kept.astype(np.uint64) + salt[None, :]) >> np.uint64(40)) & np.uint64(15)).astype(np.int64)]
    out = [""] * len(texts)
    for row, (i, n) in enumerate(zip(order, counts, strict=True)):
        out[i] = digits[row, :n].tobytes().decode()
    return out


def likeness(a: str, b: str, n_a: int, n_b: int) -> float:
    """1 less the estimated share of steps that differ, freed of chance matches; n_a and n_b are the texts' characters.

    Walks stand at the ends of their texts after about 2 steps for each
    character, so only so many steps of the longer text count.
    """
    if a == b and n_a == n_b:
        return 1.0
    weight = _strata(2 * max(n_a, n_b))
    short = min(len(a), len(b), len(weight))
    same = np.frombuffer(a.encode(), np.uint8)[:short] == np.frombuffer(b.encode(), np.uint8)[:short]
    match = float(weight[:short][same].sum() / weight.sum())
    return float(min(1.0, max(0.0, (match - 1 / 16) * 16 / 15)))


def edited_text(text: str, following: str) -> str:
    """The last third replaced by as much of the beginning of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def in_order(docs: DataFrame) -> DataFrame:
    """(part, ghost, doc_id, text) such that, sorted, each row of a part is followed by its next document.

    Documents are dealt to ranges of doc_id by approximate quantiles; the first
    rows of each range are also given, as ghosts, to the range before it.  The
    driver sees the bounds of the ranges only.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id")
    bounds = sorted(
        {int(q) for q in ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts)}
    ) if ids.schema["doc_id"].dataType.simpleString() != "void" else []
    part = _range_number(F.col("doc_id"), bounds)
    firsts = {r.part: r.first for r in ids.groupBy(part.alias("part")).agg(F.max("doc_id").alias("first")).collect()}
    used = sorted(firsts)
    rows = rows.withColumn("part", part)
    if not used:
        return rows.withColumn("ghost", F.lit(0))
    # A ghost goes to the range before its own; the very first row goes to the last range.
    pairs = [(used[i - 1], firsts[p]) for i, p in enumerate(used)]
    known = spark.createDataFrame([(p, f) for p, f in pairs if f is not None] or [(-1, None)], "to_part int, first long")
    ghosts = rows.join(F.broadcast(known), F.col("doc_id") == F.col("first")).select(
        "doc_id",
        "text",
        F.col("to_part").alias("part"),
        F.lit(1).alias("ghost"),
    )
    if None in firsts.values():
        to = next(p for p, f in pairs if f is None)
        nulls = rows.where("doc_id IS NULL").groupBy("doc_id").agg(F.min("text").alias("text"))
        ghosts = ghosts.unionByName(nulls.select("doc_id", "text", F.lit(to).alias("part"), F.lit(1).alias("ghost")))
    return rows.withColumn("ghost", F.lit(0)).unionByName(ghosts)


def _range_number(doc_id, bounds: list[int]):
    """0 for the highest ids, counting up; nulls come after all others.  Found by bisection."""

    def below(lo: int, hi: int):
        """How many of bounds[lo:hi] are greater than the id, as an expression of depth log n."""
        if lo == hi:
            return F.lit(len(bounds) - lo)
        mid = (lo + hi) // 2
        return F.when(doc_id >= F.lit(bounds[mid]), below(mid + 1, hi)).otherwise(below(lo, mid))

    return F.when(doc_id.isNull(), F.lit(len(bounds) + 1)).otherwise(below(0, len(bounds))).cast("int")


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Each text, its edited text and its next document: fingerprints and likeness; and a hash of the text."""
    ordered = in_order(docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartition(parts, "part").sortWithinPartitions("part", "ghost", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # (part, doc_id, text) that waits for its next document
        for b in slices(batches, "text", CHUNK):
            pairs = []
            for part, ghost, doc_id, raw in zip(column(b, "part"), column(b, "ghost"), column(b, "doc_id"), column(b, "text"), strict=True):
                text = as_text(raw)
                if held is not None and held[0] == part:
                    pairs.append((held[1], held[2], text))
                held = None if ghost else (part, doc_id, text)
            if pairs:
                yield result(pairs)

    def result(pairs: list[tuple]) -> pa.RecordBatch:
        edited = [edited_text(t, f) for _, t, f in pairs]
        # A row's text is the text before's next document: each is walked once, and so are equal ones.
        every = {t: i for i, t in enumerate(dict.fromkeys([x for _, t, f in pairs for x in (t, f)] + edited))}
        prints = fingerprints(list(every))
        mine, theirs, after = ([prints[every[t]] for t in ts] for ts in ([t for _, t, _ in pairs], edited, [f for _, _, f in pairs]))
        near_edited = [likeness(a, b, len(t), len(e)) for a, b, (_, t, _), e in zip(mine, theirs, pairs, edited, strict=True)]
        near_next = [likeness(a, b, len(t), len(f)) for a, b, (_, t, f) in zip(mine, after, pairs, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([d for d, _, _ in pairs], pa.int64()),
                pa.array([len(t) for _, t, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array(mine, pa.string()),
                pa.array(theirs, pa.string()),
                pa.array(near_edited, pa.float64()),
                pa.array(near_next, pa.float64()),
                pa.array([_text_hash(t) for _, t, _ in pairs], pa.int64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "text_hash"],
        )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text_hash long"
    return ordered.mapInArrow(run, schema)


# ------------------------------------------------------------------ near texts

NEAR = 0.8
BANDS, DIGITS = 14, 10
#: Characters of fingerprints (and 100 for each text) of a block.
BLOCK = 1_000_000


#: Bands are drawn for lengths that grow by this root of 2; a text takes part at its own and LOWER shorter ones, which near texts of other lengths share.
ROOT, LOWER = 4, 2


@lru_cache
def _band_places(size: int) -> np.ndarray:
    """Places of the digits of each band, among the samples of the first 2**(size / ROOT) steps, drawn by how many steps a sample stands for."""
    length = int(2 ** (size / ROOT))
    weight = _strata(length)
    rng = np.random.Generator(np.random.PCG64([SEED, size]))
    return np.stack([rng.choice(len(weight), min(DIGITS, len(weight)), replace=False, p=weight / weight.sum()) for _ in range(BANDS)])


def band_values(fingerprint: str, n_chars: int) -> list[int]:
    """Bit-sampled bands of a fingerprint, over the text's steps and over those of somewhat shorter texts."""
    if not n_chars:
        return []
    digits = np.frombuffer(fingerprint.encode(), np.uint8)
    top = int(np.floor(ROOT * np.log2(2 * n_chars)))
    out = []
    for size in range(max(top - LOWER, 0), top + 1):
        for band, places in enumerate(_band_places(size)):
            if places.max(initial=-1) < len(digits):
                out.append(xxhash.xxh3_64_intdigest(digits[places].tobytes(), seed=size * BANDS + band) - (1 << 63))
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", CHUNK):
        texts = [as_text(t) for t in column(b, "text")]
        every = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        prints = fingerprints(list(every))
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0),
                pa.array([_text_hash(t) for t in texts]),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([prints[every[t]] for t in texts], pa.string()),
            ],
            names=["doc_id", "text_hash", "n_chars", "fingerprint"],
        )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each band of each text."""
    for b in slices(batches, "fingerprint", 1 << 20):
        bands = [band_values(p.decode(), n) for p, n in zip(column(b, "fingerprint"), column(b, "n_chars"), strict=True)]
        names = np.repeat(np.array(column(b, "text_hash"), np.int64), [len(x) for x in bands])
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([x for row in bands for x in row], pa.int64())], names=["text_hash", "band"])


def _verified(texts: list[tuple], keep) -> tuple[np.ndarray, np.ndarray]:
    """Of texts (hash, copies, fingerprint, n_chars, block): each one's links, and the place of a text of its tree.

    ``keep`` says for a text and those before it which of them may be compared.
    A text is compared with all shorter ones at once, by the weights of its own
    length, as :func:`likeness` does.
    """
    width = max(len(t[2]) for t in texts)
    digits = np.full((len(texts), width), 255, np.uint8)
    for row, t in zip(digits, texts, strict=True):
        row[: len(t[2])] = np.frombuffer(t[2].encode(), np.uint8)
    copies, block = np.array([t[1] for t in texts], np.int64), np.array([t[4] for t in texts])
    holders: dict[int, list[int]] = {}
    links, tree = np.zeros(len(texts), np.int64), np.arange(len(texts))
    for i, (_, _, mine, n, _) in enumerate(texts):
        bands = band_values(mine, n)
        before = [np.array(holders[x], np.int64) for x in bands if x in holders]
        for x in bands:
            holders.setdefault(x, []).append(i)
        if not before:
            continue
        found = np.unique(np.concatenate(before))
        found = found[keep(block[i], block[found])]
        if not len(found):
            continue
        weight = _strata(2 * n)
        size = min(len(mine), len(weight))
        match = (digits[found, :size] == digits[i, :size]) @ weight[:size] / weight.sum()
        found = found[(match - 1 / 16) * 16 / 15 >= NEAR]
        if len(found):
            links[i] += copies[found].sum()
            links[found] += copies[i]
            trees = np.unique(np.append(tree[found], tree[i]))
            tree[np.isin(tree, trees)] = trees[0]
    return links, tree


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks: how many rows each text is linked to, and a text of its tree of links."""
    for (_, first, second), rows in _pairs_of_blocks(batches):
        texts = sorted({r[0]: r for r in rows}.values(), key=lambda r: (r[3], r[0]))
        # A pair within one block belongs to the task of that block alone.
        links, tree = _verified(texts, lambda a, b, pair=(first, second): (np.minimum(a, b) == pair[0]) & (np.maximum(a, b) == pair[1]))
        some = np.flatnonzero(links)
        names = np.array([r[0] for r in texts], np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[some]), pa.array(links[some]), pa.array(names[tree[some]])],
            names=["text_hash", "links", "tie"],
        )


def _pairs_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    at, held = None, []
    for b in batches:
        names = ["label", "first", "second", "text_hash", "copies", "fingerprint", "n_chars", "block"]
        for label, first, second, *row in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in names), strict=True):
            if at != (label, first, second):
                if held:
                    yield at, held
                at, held = (label, first, second), []
            held.append(tuple(row))
    if held:
        yield at, held


def link(signed: DataFrame, scratch: Scratch) -> DataFrame:
    """text_hash, class_id and n_links of the texts of (doc_id, text_hash, n_chars, fingerprint); see :func:`near_links`.

    Distinct texts (by 64-bit hash) are banded; each is tied to the least text
    of its bands, the components of the ties are dealt to blocks, and each pair
    of blocks is verified in one task.
    """
    copies = signed.groupBy("text_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id"))
    texts = scratch.table(signed.select("text_hash", "n_chars", "fingerprint").dropDuplicates(["text_hash"]).join(copies, "text_hash"), "near-texts")
    banded = texts.select("text_hash", "n_chars", "fingerprint").mapInArrow(_bands, "text_hash long, band long")
    least = banded.groupBy("band").agg(
        F.min("text_hash").alias("least"),
        F.max("text_hash").alias("most"),
    ).where("least <> most").select("band", "least")
    ties = banded.join(least, "band").where("text_hash <> least").select(F.col("text_hash").alias("u"), F.col("least").alias("v")).distinct()
    ties = scratch.table(ties, "near-ties")
    members = texts.select("text_hash", "copies", "n_chars", "fingerprint").join(components(ties).withColumnRenamed("node", "text_hash"), "text_hash")
    members = scratch.table(members, "near-members")
    blocks = members.groupBy("label").agg(F.ceil(F.sum(F.length("fingerprint") + 100) / BLOCK).cast("int").alias("blocks"))
    members = members.join(blocks, "label").withColumn("block", F.pmod(F.xxhash64("text_hash"), F.col("blocks")).cast("int"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")}).drop("other", "blocks")
    dealt = dealt.repartition("label", "first", "second").sortWithinPartitions("label", "first", "second", "text_hash")
    found = scratch.table(dealt.mapInArrow(_verify, "text_hash long, links long, tie long"), "near-found")
    classes = components(found.select(F.col("text_hash").alias("u"), F.col("tie").alias("v"))).withColumnRenamed("node", "text_hash")
    counts = found.groupBy("text_hash").agg(F.sum("links").alias("links"))
    texts = texts.select("text_hash", "copies", "doc_id").join(classes, "text_hash", "left").join(counts, "text_hash", "left")
    texts = texts.select(
        "text_hash",
        "doc_id",
        F.coalesce("label", "text_hash").alias("label"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    named = texts.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    linked = scratch.table(texts.join(named, "label").select("text_hash", "class_id", "n_links"), "near-classes")
    scratch.close(linked, signed)
    return linked


def near_links(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and n_links: rows whose texts' fingerprints have a likeness of NEAR or more, copies included.

    A class is named by its least doc_id.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    scratch = Scratch(docs.sparkSession)
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    signed = scratch.table(rows.mapInArrow(_sign, f"doc_id {kind}, text_hash long, n_chars long, fingerprint string"), "fingerprints")
    return signed.select("doc_id", "text_hash").join(link(signed, scratch), "text_hash").select("doc_id", "class_id", "n_links")


def query(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and the class and links of every text."""
    scratch = Scratch(spark)
    pairs = scratch.table(fingerprint_pairs(documents(spark, sf_dir)), "fingerprint-pairs")
    return pairs.join(link(pairs, scratch), "text_hash").drop("text_hash")
