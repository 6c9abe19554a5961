"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag has a label.  A sentence has
the score sigmoid(bias + sum of the weights of its words); a word's weight is
that of the whole word and of its beginnings of 4 to 8 letters, so that a stem
counts in all its forms, seldom ones too; a document's score
is the noisy-or of its sentences with a leak, 1 - (1 - leak) * prod(1 - score),
so one bad sentence suffices, and the leak takes up labels that no sentence
explains.  Weights, bias and leak are trained on document labels by gradient
ascent of the bag likelihood; the sentence scores then locate what offends.

Training uses at most ``SAMPLE`` labelled documents, those with the least
hashed ids; whole texts count.  Words and beginnings enter if the label rate of
their ``LEAST_DOCS`` documents or more differs by ``LEAST_Z`` standard errors.

Defined cases: null and empty texts score the leak; a document that several
label rows mark counts as toxic if any does; unlabelled and null-labelled rows
train nothing; without labels every score is 0; repeated rows score alike;
further columns are kept by :func:`reject` and ignored by :func:`score`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_text, column, documents, remainder, slices, text_or_empty

SAMPLE = 12_000
LEAST_DOCS = 8
LEAST_Z = 3.0
STEPS = 400
THRESHOLD = 0.3
#: Letters of the beginnings of words.
SHORTEST, LONGEST = 4, 8
#: Words, and what ends a sentence.
PARTS = re.compile(r"[^\W\d_]+")
ENDING = re.compile(r"[.!?\n]")


def features(word: str) -> list[str]:
    """The whole word, marked by its end, and its beginnings."""
    return [word + "$", *(word[:n] for n in range(SHORTEST, min(LONGEST, len(word)) + 1))]


class _Words(dict):
    """What words come to, by ``make``; forgets all when it grows past ``most`` words."""

    most = 150_000

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        if len(self) >= self.most:
            self.clear()
        found = self[word] = self.make(word)
        return found


@dataclass
class Model:
    """weights: of features, those that are not 0."""

    leak: float = 0.0
    bias: float = -20.0
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self._words = _Words(self._weight)

    def _weight(self, word: str) -> float | None:
        hits = [self.weights[f] for f in features(word) if f in self.weights]
        return sum(hits) if hits else None

    def __getstate__(self) -> dict:
        return {"leak": self.leak, "bias": self.bias, "weights": self.weights}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def _sentences(self, text: str) -> Iterator[tuple[int, int, list[float], bool]]:
        """(start, end, weights of the known words, whether there are words) of each sentence."""
        at, look_up = 0, self._words.__getitem__
        for sentence in ENDING.split(text):
            words = PARTS.findall(sentence.lower())
            yield at, at + len(sentence), [w for w in map(look_up, words) if w is not None], bool(words)
            at += len(sentence) + 1

    def sentence_scores(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, score) of the sentences that hold a word of the model."""
        return [(a, e, float(_sigmoid(self.bias + sum(hits)))) for a, e, hits, _ in self._sentences(text) if hits]

    def score(self, text: str) -> float:
        clear, plain = 1.0 - self.leak, 0
        for _, _, hits, some in self._sentences(text):
            if hits:
                clear *= 1.0 - float(_sigmoid(self.bias + sum(hits)))
            else:
                plain += some
        return min(1.0, max(0.0, 1.0 - clear * (1.0 - float(_sigmoid(self.bias))) ** plain))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` labelled documents outside the held-out quarter: toxic, text."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 4) != 2))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(marks, "doc_id")
    # Repeated rows of one document train once.
    return rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents have each feature, and how many toxic ones, by slices of the rows."""
    cache = _Words(features)
    for b in slices(batches):
        n, k = Counter(), Counter()
        for toxic, t in zip(column(b, "toxic"), column(b, "text"), strict=True):
            found = set(chain.from_iterable(map(cache.__getitem__, set(PARTS.findall(as_text(t).lower())))))
            n.update(found)
            if toxic > 0:
                k.update(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([k[f] for f in n], pa.int64())],
            names=["feature", "n", "k"],
        )


def _bags(chosen: dict[str, int]):
    """Each document's sentences with chosen features (their numbers, -1 between sentences) and its count of other sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Words(lambda w: [chosen[f] for f in features(w) if f in chosen])
        for b in slices(batches):
            rows = []
            for toxic, t in zip(column(b, "toxic"), column(b, "text"), strict=True):
                bag, plain = [], 0
                for sentence in ENDING.split(as_text(t).lower()):
                    words = PARTS.findall(sentence)
                    hits = list(chain.from_iterable(map(numbers.__getitem__, words)))
                    if hits:
                        bag += [*hits, -1]
                    else:
                        plain += bool(words)
                rows.append((int(toxic > 0), plain, np.array(bag, np.int32).tobytes()))
            toxic, plain, bags = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(toxic, pa.int32()), pa.array(plain, pa.int64()), pa.array(bags, pa.binary())],
                names=["toxic", "plain", "bag"],
            )

    return run


def fit(bags: list[bytes], plain: np.ndarray, labels: np.ndarray, words: int, steps: int = STEPS) -> tuple[np.ndarray, float, float]:
    """Weights of the words by number, bias and leak."""
    y = labels.astype(float)
    rate = float(y.mean())
    f, s, sentence_doc = [], [], []
    for i, bag in enumerate(bags):
        a = np.frombuffer(bag, np.int32)
        if len(a):
            ends = a < 0
            s.append((np.cumsum(ends) - ends)[~ends] + len(sentence_doc))
            f.append(a[~ends])
            sentence_doc += [i] * int(ends.sum())
    f = np.concatenate([np.zeros(0, np.int32), *f])
    s = np.concatenate([np.zeros(0, np.int64), *s])
    sentence_doc = np.array(sentence_doc, np.int64)
    theta = np.concatenate([np.zeros(words), [-6.0, np.log(max(rate, 1e-3) / 2)]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        weights, bias, leak = theta[:-2], theta[-2], _sigmoid(theta[-1])
        p = _sigmoid(bias + np.bincount(s, weights[f], minlength=len(sentence_doc)))
        p0 = _sigmoid(bias)
        log_clear = np.log1p(-leak) + np.bincount(sentence_doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y)) + plain * np.log1p(-p0)
        score = np.clip(-np.expm1(log_clear), 1e-9, 1.0)
        # d log likelihood / d (-log clear)
        g = y * (1 - score) / score - (1 - y)
        by_sentence = g[sentence_doc] * p
        grad = np.concatenate(
            [np.bincount(f, by_sentence[s], minlength=words) - 0.5 * weights, [by_sentence.sum() + (g * plain * p0).sum(), (g * leak).sum()]]
        )
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:-2], float(theta[-2]), float(_sigmoid(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Features are chosen by executors; the driver gets the chosen ones and the sentences that hold them."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(training_rows(docs, labels, sample).select("toxic", "text"), "toxic-sample")
    n, k = rows.agg(F.count(F.lit(1)), F.sum((F.col("toxic") > 0).cast("long"))).first()
    if not n or k in (0, n):
        scratch.close()
        return Model(k / n if n else 0.0, -20.0, {})
    rate = k / n
    counted = rows.mapInArrow(_features, "feature string, n long, k long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    z = (F.col("k") - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate)))
    chosen = sorted(r.feature for r in counted.where((F.col("n") >= LEAST_DOCS) & (F.abs(z) >= LEAST_Z)).select("feature").collect())
    bags = rows.mapInArrow(_bags({f: i for i, f in enumerate(chosen)}), "toxic int, plain long, bag binary").toArrow().to_pydict()
    scratch.close()
    # The same sums whatever the order of arrival.
    order = sorted(range(n), key=lambda i: (bags["bag"][i], bags["plain"][i], bags["toxic"][i]))
    plain, toxic = (np.array(bags[c])[order] for c in ("plain", "toxic"))
    weights, bias, leak = fit([bags["bag"][i] for i in order], plain, toxic, len(chosen))
    return Model(leak, bias, {f: float(w) for f, w in zip(chosen, weights, strict=True) if w})


def _scored(docs: DataFrame, model: Model, schema, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield make(model, b)

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and offending (start:end of the sentences that score the threshold or more)."""

    def make(local: Model, b: pa.RecordBatch) -> pa.RecordBatch:
        scores, spans = [], []
        for t in column(b, "text"):
            text = as_text(t)
            p = local.score(text)
            scores.append(p)
            spans.append(",".join(f"{a}:{e}" for a, e, q in local.sentence_scores(text) if q >= THRESHOLD) if p >= THRESHOLD else "")
        s = np.array(scores)
        return pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array(spans, pa.string())],
            names=["doc_id", "held_out", "score", "predicted", "offending"],
        )

    rows = docs.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), text_or_empty().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _scored(rows, model, f"doc_id {kind}, held_out boolean, score double, predicted int, offending string", make)


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are not predicted toxic, with the columns of ``docs``."""

    def make(local: Model, b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array([local.score(as_text(t)) < THRESHOLD for t in column(b, "text")], pa.bool_()))

    return _scored(docs, model, docs.schema, make)


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
