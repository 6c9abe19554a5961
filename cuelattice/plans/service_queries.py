"""Queries through the service facade, and the reconstruction walk unrolled in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scip, vector, walk
from ..service import Service
from . import lineage, projection
from .projection import table
from .queries import _COSINE, _HITS, _vector, plain, query

_TAGS = "coalesce((SELECT array_to_string(list_sort(list(t.category || '=' || t.value)), ',') FROM tags_of t WHERE t.id = c.id), '')"
_SUMMARY = f"""c.id, 'content' AS node_kind, coalesce(nullif(c.signature, ''), nullif(c.symbol_name, ''), c.kind) AS label,
  CASE WHEN length(c.body) > 500 THEN c.body[1:500] || '…' ELSE c.body END AS snippet, {_TAGS} AS tags"""


def _service(spark, sf_dir) -> Service:
    return Service(projection.graph(spark, sf_dir), embed=lambda _: [_vector(spark, sf_dir, 7)], planner=walk.rule_planner())


def _flat(rows):
    return rows.withColumn("tags", F.array_join("tags", ","))


@query("," + _HITS.format(k=8) + " SELECT id, 'cue' AS node_kind, text AS label, CAST(NULL AS VARCHAR) AS snippet, '' AS tags, score FROM hits")
def tool_search(spark, sf_dir):
    return _flat(_service(spark, sf_dir).search("anything", 8))


@query(f""", start AS (SELECT 'cue:vec:' || i AS id, i AS ord FROM range(0, 60) t(i)),
resolved AS (
  SELECT s.ord, e.edge_seq, coalesce(r.redirect_id, e.target_id) AS content_id FROM start s
    JOIN edges e ON e.source_id = s.id AND e.edge_type = 'cue_of' LEFT JOIN redirects r ON r.id = e.target_id)
SELECT {_SUMMARY} FROM nodes c WHERE c.node_type = 'content' AND c.status = 'active' AND c.id IN (SELECT content_id
  FROM resolved) AND c.id IN (SELECT id FROM tags_of WHERE category = 'language' AND value = 'en')""")
def tool_traverse_forward(spark, sf_dir):
    """Contents of 60 given cues that are tagged as English, with their summaries."""
    return _flat(_service(spark, sf_dir).traverse_forward([f"cue:vec:{i}" for i in range(60)], [("language", "en")]))


@query(""" SELECT DISTINCT n.id, 'cue' AS node_kind, n.text AS label, CAST(NULL AS VARCHAR) AS snippet, '' AS tags
FROM range(0, 40) t(i) JOIN edges e ON e.target_id = 'content:doc:' || i AND e.edge_type = 'cue_of'
  JOIN nodes n ON n.id = e.source_id AND n.node_type = 'cue'""")
def tool_traverse_reverse(spark, sf_dir):
    return _flat(_service(spark, sf_dir).traverse_reverse([f"content:doc:{i}" for i in range(40)]))


@query(""" SELECT c.id, c.status, c.source_file, c.git_sha, c.kind, c.memory_layer, c.symbol_name, c.signature, CAST(NULL AS VARCHAR) AS docstring, c.body
FROM (SELECT i FROM range(0, 30) t(i) UNION ALL SELECT 3) w
  JOIN nodes c ON c.id = 'content:doc:' || w.i AND c.node_type = 'content' AND c.status = 'active'""")
def tool_fetch(spark, sf_dir):
    """Full contents by id; one is asked for twice."""
    return _service(spark, sf_dir).fetch([*(f"content:doc:{i}" for i in range(30)), "content:doc:3", "content:doc:none"])


# ------------------------------------------------------------------ cross-reference symbols

_SYMBOLS = """WITH info AS (
  SELECT CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'src/f' || (s_suppkey % 5) || '.py' END AS relative_path, s_suppkey AS sym_idx, 'sym ' || (s_suppkey % 40) || '#' AS symbol,
         CASE WHEN s_suppkey % 4 <> 1 THEN 'sym ' || (s_suppkey % 7) || '#' END AS target FROM supplier),
wanted AS (SELECT DISTINCT 'sym ' || (s_suppkey % 40) || '#' AS symbol, 'src/f' || (s_suppkey % 40 % 5) || '.py' AS relative_path FROM supplier),
ranked AS (SELECT i.*, rank() OVER (PARTITION BY i.symbol ORDER BY i.relative_path IS NULL, sym_idx) AS place FROM wanted w JOIN info i ON i.symbol = w.symbol AND (i.relative_path = w.relative_path OR i.relative_path IS NULL)) """


@plain(_SYMBOLS + "SELECT symbol, relative_path IS NULL AS external, sym_idx, target FROM ranked WHERE place = 1 AND target IS NOT NULL")
def scip_symbol_info(spark, sf_dir):
    """Relationships of symbols, looked up in a file first; a local symbol without any does not fall through to the external one."""
    key = F.col("s_suppkey")
    symbol = F.concat(F.lit("sym "), (key % 40).cast("string"), F.lit("#"))
    no = F.lit(False)
    info = table(spark, sf_dir, "supplier").select(
        F.when(
            key % 3 != 0,
            F.concat(F.lit("src/f"), (key % 5).cast("string"), F.lit(".py")),
        ).alias("relative_path"), key.alias("sym_idx"), symbol.alias("symbol"),
        F.when(
            key % 4 != 1,
            F.concat(F.lit("sym "), (key % 7).cast("string"), F.lit("#")),
        ).alias("target"), no.alias("is_reference"), no.alias("is_implementation"), no.alias("is_type_definition"), no.alias("is_definition"),
    )
    wanted = table(spark, sf_dir, "supplier").select(
        symbol.alias("symbol"),
        F.concat(F.lit("src/f"), (key % 40 % 5).cast("string"), F.lit(".py")).alias("relative_path"),
    ).distinct()
    return scip.symbol_infos(info, wanted).select("symbol", F.col("relative_path").isNull().alias("external"), "sym_idx", "target")


def _field(number: int, value: F.Column) -> F.Column:
    """A field of the wire format that holds fewer than 128 bytes."""
    return F.concat(F.lit(bytes([number << 3 | 2])), F.chr(F.octet_length(value)).cast("binary"), value)


def _number(number: int, value: F.Column) -> F.Column:
    """A field that holds a number under 128."""
    return F.concat(F.lit(bytes([number << 3])), F.chr(value).cast("binary"))


@plain("""SELECT 'src/f' || s_suppkey || '.py' AS relative_path, CAST(s_suppkey AS INTEGER) AS doc_idx, CAST(i AS INTEGER) AS occ_idx, 'sym ' || ((s_suppkey + i) % 9) || '#' AS symbol, i = 0 AS is_definition,
  CAST(s_suppkey % 100 + 1 AS INTEGER) AS start_line, CAST(i + 1 AS INTEGER) AS start_character, CAST(s_suppkey % 100 + 1 + CASE WHEN i = 1 THEN 1 ELSE 0 END AS INTEGER) AS end_line, CAST(i + 6 AS INTEGER) AS end_character
FROM supplier, range(0, 3) t(i)""")
def scip_decode(spark, sf_dir):
    """Document messages made of suppliers, three occurrences each in the three forms of a range, decoded from their bytes."""
    from ..sources import scip as source

    key = F.col("s_suppkey")
    text = lambda c: c.cast("string").cast("binary")
    line = (key % 100 + 1).cast("int")
    one = lambda n: F.chr(n).cast("binary")
    ranges = [
        _field(8, F.concat(_number(1, line), _number(2, F.lit(1)), _number(3, F.lit(6)))),
        _field(9, F.concat(_number(1, line), _number(2, F.lit(2)), _number(3, line + 1), _number(4, F.lit(7)))),
        _field(1, F.concat(one(line), one(F.lit(3)), one(F.lit(8)))),
    ]
    occurrences = [
        _field(
            2,
            F.concat(
                _field(2, text(F.concat(F.lit("sym "), ((key + i) % 9).cast("string"), F.lit("#")))),
                _number(3, F.lit(int(i == 0))) if i == 0 else F.lit(b""),
                r,
            ),
        ) for i, r in enumerate(ranges)
    ]
    path = text(F.concat(F.lit("src/f"), key.cast("string"), F.lit(".py")))
    raw = table(spark, sf_dir, "supplier").select(key.cast("int").alias("doc_idx"), F.concat(_field(1, path), *occurrences).alias("data"))
    return scip.decoded(source.decode_documents(raw)[0])


# ------------------------------------------------------------------ walk

_STEPS = 3


def _walk_sql(steps: int) -> str:
    """The walk's states, one after the other.

    A state is (qid, id, stack, queue, visited, done).  ``candidates`` has for
    each node its candidates with their place, and the place among contents.
    """
    parts = [f"""
vectors AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
scores AS (
  SELECT CAST(q.vec_id AS VARCHAR) AS qid, 'cue:vec:' || c.vec_id AS id, round({_COSINE.format(a="c.v", b="q.v")}, 6) AS score
    FROM vectors c, vectors q WHERE q.vec_id % 100 = 0),
seeds AS (SELECT qid, list(id ORDER BY score DESC, id) AS seeds
  FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS place FROM scores) WHERE place <= 3 GROUP BY qid),
hop AS (
  SELECT e.source_id AS id, n.node_type, e.edge_type, e.edge_seq, coalesce(r.redirect_id, e.target_id) AS candidate_id
  FROM edges e JOIN nodes n ON n.id = e.source_id JOIN nodes t ON t.id = e.target_id LEFT JOIN redirects r ON r.id = e.target_id
  WHERE (n.node_type = 'cue' AND e.edge_type = 'cue_of') OR (n.node_type = 'content' AND e.edge_type = 'part_of_topic')),
candidates AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY branch, edge_seq, candidate_id) AS place, row_number() OVER (PARTITION BY id, is_content ORDER BY branch, edge_seq, candidate_id) AS nth
    FROM (
    SELECT h.id, h.candidate_id, CASE WHEN h.node_type = 'cue' THEN 0 ELSE 1 END AS branch, min(h.edge_seq) AS edge_seq, true AS is_content
    FROM hop h JOIN nodes c ON c.id = h.candidate_id AND c.node_type = 'content' AND c.status = 'active' GROUP BY ALL
    UNION ALL SELECT e.target_id, e.source_id, 0, e.edge_seq, false FROM edges e
      JOIN nodes n ON n.id = e.source_id AND n.node_type = 'cue' AND n.status = 'active'
      JOIN nodes t ON t.id = e.target_id AND t.node_type = 'content' WHERE e.edge_type = 'cue_of')),
firsts AS (SELECT id, candidate_id AS first FROM candidates WHERE place = 1),
s0 AS (SELECT qid, seeds[1] AS id, []::VARCHAR[] AS stack, seeds[2:] AS queue, [seeds[1]] AS visited, false AS done FROM seeds)"""]
    for k in range(steps):
        parts.append(f"""
c{k} AS (SELECT s.qid, c.candidate_id AS content_id, 1.0 / c.nth AS relevance, {k * 1_000_000} + c.nth - 1 AS discovery FROM s{k} s
  JOIN candidates c ON c.id = s.id AND c.is_content WHERE NOT s.done),
m{k} AS (SELECT s.*, f.first, f.first IS NULL AS ends, f.first IS NOT NULL AND NOT list_contains(s.visited, f.first) AS down FROM s{k} s
  LEFT JOIN firsts f ON f.id = s.id WHERE NOT s.done),
s{k + 1} AS (
  SELECT qid, CASE WHEN ends THEN id WHEN down THEN first WHEN len(stack) > 0 THEN stack[-1] WHEN len(queue) > 0 THEN queue[1] ELSE id END AS id,
    CASE WHEN ends THEN stack WHEN down THEN list_append(stack, id) WHEN len(stack) > 0 THEN stack[:len(stack) - 1] ELSE stack END AS stack,
    CASE WHEN ends OR down OR len(stack) > 0 OR len(queue) = 0 THEN queue ELSE queue[2:] END AS queue,
    CASE WHEN ends THEN visited WHEN down THEN list_append(visited, first) WHEN len(stack) > 0 OR len(queue) = 0 THEN visited ELSE list_append(visited, queue[1]) END AS visited,
    ends OR NOT (down OR len(stack) > 0 OR len(queue) > 0) AS done FROM m{k}
  UNION ALL SELECT * FROM s{k} WHERE done)""")
    if not steps:
        return "," + ",".join(parts)
    found = " UNION ALL ".join(f"SELECT * FROM c{k}" for k in range(steps))
    parts.append(f"\nbest AS (SELECT qid, content_id, max(relevance) AS relevance, min(discovery) AS discovery FROM ({found}) GROUP BY ALL)")
    return "," + ",".join(parts) + """ SELECT qid, content_id, CAST(relevance AS DOUBLE) AS relevance, CAST(row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, discovery) AS INTEGER) AS place
   FROM best"""


def _walks(spark, sf_dir, budget: int):
    graph = projection.graph(spark, sf_dir)
    queries = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").cast("string").alias("qid"), "embedding")
    hits = vector.knn_batch(graph.nodes, queries, 3, "cue")
    seeds = hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_id"))), lambda h: h["node_id"]).alias("seeds"))
    return walk.reconstruct(graph, seeds, walk.rule_planner(), budget=budget)


@query(_walk_sql(_STEPS))
def reconstruct_three_hops(spark, sf_dir):
    """Walks of three hops from each query vector (those whose id 100 divides), by the rule planner."""
    return _walks(spark, sf_dir, _STEPS)


@query(_walk_sql(6))
def reconstruct_six_hops(spark, sf_dir):
    """Walks of six hops: down, back along the stack, and on to the next seed."""
    return _walks(spark, sf_dir, 6)


@query(_walk_sql(6))
def reconstruct_packed_six_hops(spark, sf_dir):
    """The same walks over the packed graph."""
    queries = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").cast("string").alias("qid"), "embedding")
    hits = vector.knn_batch(projection.graph(spark, sf_dir).nodes, queries, 3, "cue")
    seeds = hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_id"))), lambda h: h["node_id"]).alias("seeds"))
    return walk.reconstruct_packed(projection.packed(spark, sf_dir), seeds, walk.rule_planner(), budget=6)


def _scripted_sql() -> str:
    start = _walk_sql(0).split("s0 AS (")[0].rstrip().rstrip(",")
    return start + """,
one AS (SELECT s.qid, f.first AS content FROM seeds s JOIN firsts f ON f.id = s.seeds[1]),
two AS (SELECT o.qid, f.first AS picked, n.node_type FROM one o JOIN firsts f ON f.id = o.content JOIN nodes n ON n.id = f.first),
found AS (
  SELECT qid, content AS content_id, 0.25 AS relevance, 0 AS hop FROM one
  UNION ALL SELECT t.qid, CASE WHEN t.node_type = 'cue' THEN f.first ELSE t.picked END, 0.75, 1 FROM two t LEFT JOIN firsts f ON f.id = t.picked),
best AS (SELECT qid, content_id, max(relevance) AS relevance, min(hop) AS hop FROM found WHERE content_id IS NOT NULL GROUP BY ALL)
SELECT qid, content_id, CAST(relevance AS DOUBLE) AS relevance, CAST(row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, hop) AS INTEGER) AS place
FROM best"""


@query(_scripted_sql())
def reconstruct_scripted(spark, sf_dir):
    """Walks by a script: collect the first content and an id that does not exist, go down, collect the first candidate there (a cue stands for its
    first content), then fail; what was found stays."""
    graph = projection.graph(spark, sf_dir)
    queries = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").cast("string").alias("qid"), "embedding")
    top = vector.knn_batch(graph.nodes, queries, 1, "cue").select("qid", F.col("node_id").alias("id"))
    first = lambda current: walk.candidates(graph, current).groupBy("qid").agg(F.min_by("candidate_id", "ord").alias("id"))
    # Every hop reads the script, so what it is made of is found once.
    top = lineage.cut(top)
    one = lineage.cut(first(top))
    two = lineage.cut(first(one))
    pick = lambda c, relevance: F.struct(c.alias("id"), F.lit(relevance).alias("relevance"))
    no = F.lit(False)
    decisions = [
        one.select("qid", F.lit(0).alias("hop"), F.array(pick(F.col("id"), 0.25), pick(F.lit("nowhere"), 1.0)).alias("collect"), F.col("id").alias("descend_into"), no.alias("stop"), no.alias("error")),
        two.select("qid", F.lit(1).alias("hop"), F.array(pick(F.col("id"), 0.75)).alias("collect"), F.col("id").alias("descend_into"), no.alias("stop"), no.alias("error")),
        two.select("qid", F.lit(2).alias("hop"), F.array(pick(F.col("id"), 1.0)).alias("collect"), F.col("id").alias("descend_into"), no.alias("stop"), F.lit(True).alias("error")),
    ]
    script = decisions[0].unionByName(decisions[1]).unionByName(decisions[2])
    return walk.reconstruct(graph, top.select("qid", F.array("id").alias("seeds")), walk.scripted_planner(script), budget=4)
