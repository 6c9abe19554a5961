"""A corpus pipeline over ``documents``, made of the operators in cuelattice.llm.

Toxic documents go, one document of each group of near duplicates stays,
secrets are masked, sources are mixed to their target weights, and the rows of
the mix become token ids.  Each stage takes and returns a table; all but the
last keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cuelattice.llm import bpe_automaton, jaccard_join, mixing, secrets, toxicity
from cuelattice.llm.common import drop_table, materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents whose multiple-instance score reaches the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least doc_id of each class of the Jaccard join."""
    return jaccard_join.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets; every document stays."""
    return secrets.redact(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, keep or leave documents so that each source meets its target."""
    return mixing.apply_mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, and the digest of what the ids decode to."""
    return bpe_automaton.tokenize(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

#: Training and tokenizing are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:  # each stage is done once, whatever the next one reads twice
        docs, path = materialise(stage(spark, docs, sf_dir), name)
        if before is not None:  # nothing reads the stage before any more
            drop_table(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
