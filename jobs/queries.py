"""The jobs as queries: each runs twice into one new folder, and its output is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.plans import projection
from cuelattice.plans.lineage import shared_folder

from . import content_feed, context_packs


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_content_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as the feed has them after two runs; the second one finds nothing new.  Tags come as one text."""
    at = _folder(spark, "job1")
    for _ in range(2):
        content_feed.run(spark, f"{sf_dir}/documents.parquet", f"{at}/feed", f"{at}/checkpoint")
    return content_feed.read_feed(spark, f"{at}/feed").withColumn("tags", F.array_join("tags", ","))


def job2_context_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packs after two runs."""
    at = _folder(spark, "job2")
    for _ in range(2):
        context_packs.run(spark, sf_dir, f"{at}/packs")
    return context_packs.read_packs(spark, f"{at}/packs")


QUERIES = {"job1_content_feed": job1_content_feed, "job2_context_packs": job2_context_packs}

_TEXT = "coalesce(text, '')"
_SHA = f"sha1(encode('blob ' || octet_length(encode({_TEXT}))) || '\\x00'::BLOB || encode({_TEXT}))"
_JSON = """'{"git_sha":"' || git_sha || '"' || coalesce(',"lang":"' || lang || '"', '') || coalesce(',"source":"' || source || '"', '') || '}'"""

ORACLES = {
    "job1_content_feed": f"""
WITH docs AS (SELECT *, {_TEXT} AS body, split_part({_TEXT}, chr(10), 1) AS line, {_SHA} AS git_sha FROM documents)
SELECT doc_id, 'content:doc:' || coalesce(doc_id::VARCHAR, '') AS content_id, 'added' AS change, sha1({_JSON}) AS fingerprint, git_sha, source,
  CASE WHEN length(line) > 80 THEN line[1:80] || '…' ELSE line END AS label, CASE WHEN length(body) > 500 THEN body[1:500] || '…' ELSE body END AS snippet,
  concat_ws(',', 'language=' || lang, 'module_path=' || source) AS tags,
  len(regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_words, 0::BIGINT AS batch, lang
FROM docs""",
    "job2_context_packs": f"""
WITH {projection.ORACLE.strip()},
queries AS (SELECT vec_id::VARCHAR AS qid, embedding::DOUBLE[] AS embedding, label FROM embeddings WHERE vec_id % 100 = 0),
scores AS (
  SELECT qid, c.id, round(list_inner_product(c.embedding, q.embedding) / (sqrt(list_inner_product(c.embedding, c.embedding)) * sqrt(list_inner_product(q.embedding, q.embedding))), 6) AS score
  FROM nodes c, queries q WHERE c.node_type = 'cue' AND c.status = 'active' AND c.embedding IS NOT NULL),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS ord FROM scores) WHERE ord <= 5),
found AS (
  SELECT h.qid, h.ord, h.score, e.edge_seq, coalesce(r.redirect_id, e.target_id) AS content_id
  FROM hits h JOIN edges e ON e.source_id = h.id AND e.edge_type = 'cue_of' LEFT JOIN redirects r ON r.id = e.target_id),
firsts AS (
  SELECT f.*, c.body, c.signature, c.symbol_name, c.kind, row_number() OVER (PARTITION BY qid, content_id ORDER BY ord, edge_seq) AS nth
  FROM found f JOIN nodes c ON c.id = f.content_id AND c.node_type = 'content' AND c.status = 'active'),
placed AS (
  SELECT *, row_number() OVER w AS place, sum(n_words) OVER (w ROWS UNBOUNDED PRECEDING) AS running_words
  FROM (SELECT *, len(regexp_extract_all(coalesce(body, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_words FROM firsts WHERE nth = 1)
  WINDOW w AS (PARTITION BY qid ORDER BY ord, edge_seq))
SELECT qid, place::INTEGER AS place, content_id, coalesce(nullif(signature, ''), nullif(symbol_name, ''), kind) AS content_label,
  coalesce((SELECT array_to_string(list_sort(list(t.category || '=' || t.value)), ',') FROM tags_of t WHERE t.id = content_id), '') AS tags,
  score, n_words, running_words::BIGINT AS running_words, label
FROM placed JOIN queries USING (qid) WHERE place = 1 OR running_words <= 2000""",
}
