"""Named queries over the driver's tables, with equivalent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import graph as g
from ..operators import mutate, packed, read, vector, vector_index
from ..operators.graph import Graph
from . import lineage, projection
from .projection import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name; ``sql`` follows the projection's common table expressions."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {projection.ORACLE.strip()}{sql}"
        return f

    return add


def plain(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).head()["embedding"]]


def _some_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cue as a start, by descending number."""
    n = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select((-n).alias("ord"), F.concat(F.lit("cue:vec:"), n.cast("string")).alias("id"))


_COSINE = "list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))"
_NODE_COSINE = _COSINE.format(a="c.embedding", b="q.embedding")
_HITS = f"""
hits AS (
  SELECT c.id, c.text, round({_NODE_COSINE}, 6) AS score
  FROM nodes c, (SELECT embedding FROM nodes WHERE id = 'cue:vec:7') q
  WHERE c.node_type = 'cue' AND c.status = 'active' AND c.embedding IS NOT NULL ORDER BY score DESC, c.id LIMIT {{k}})"""
_CUES = "cues AS (SELECT -vec_id AS ord, 'cue:vec:' || vec_id AS id FROM embeddings)"
_FORWARD = """
resolved AS (
  SELECT s.ord, e.edge_seq, coalesce(r.redirect_id, e.target_id) AS content_id
  FROM {start} s JOIN edges e ON e.source_id = s.id AND e.edge_type = 'cue_of' JOIN nodes t ON t.id = e.target_id
    LEFT JOIN redirects r ON r.id = e.target_id),
eligible AS (
  SELECT v.* FROM resolved v JOIN nodes c ON c.id = v.content_id AND c.node_type = 'content' AND c.status = 'active'),
firsts AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY ord, edge_seq) AS place FROM eligible)"""


@query(
    "," + _HITS.format(k=5) + ", start AS (SELECT row_number() OVER (ORDER BY score DESC, id) AS ord, id FROM hits)," + _FORWARD.format(start="start") + " SELECT CAST(ord AS BIGINT) AS ord, edge_seq, content_id FROM firsts WHERE place = 1"
)
def flagship_search_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector search for 5 cues, their contents after redirects, active ones, each once in walk order."""
    graph = projection.graph(spark, sf_dir)
    hits = vector.knn(graph.nodes, _vector(spark, sf_dir, 7), 5, "cue").collect()  # 5 rows
    start = g.ordered_ids(spark, [h.node_id for h in hits]).withColumn("ord", F.col("ord") + 1)
    return read.traverse_forward(graph, start)


@query("," + _HITS.format(k=10) + " SELECT id AS node_id, score FROM hits")
def knn_filtered(spark, sf_dir):
    graph = projection.graph(spark, sf_dir)
    return vector.knn(graph.nodes, _vector(spark, sf_dir, 7), 10, "cue")


@plain(f"""SELECT 'cue:vec:' || c.vec_id AS node_id, round({_COSINE.format(a="c.embedding::DOUBLE[]", b="q.embedding::DOUBLE[]")}, 6) AS score
FROM embeddings c, (SELECT embedding FROM embeddings WHERE vec_id = 3) q ORDER BY score DESC, node_id LIMIT 10""")
def knn_cosine(spark, sf_dir):
    return vector.knn(projection.nodes(spark, sf_dir), _vector(spark, sf_dir, 3), 10)


@plain(f"""SELECT qid, node_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT CAST(q.vec_id AS VARCHAR) AS qid, 'cue:vec:' || c.vec_id AS node_id, round({_COSINE.format(a="c.embedding::DOUBLE[]", b="q.embedding::DOUBLE[]")}, 6) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COSINE.format(a="c.embedding::DOUBLE[]", b="q.embedding::DOUBLE[]")}, 6) DESC, 'cue:vec:' || c.vec_id) AS rank
  FROM embeddings c, embeddings q WHERE q.vec_id % 5 = 0) WHERE rank <= 5""")
def knn_batch(spark, sf_dir):
    queries = table(spark, sf_dir, "embeddings").where("vec_id % 5 = 0").select(F.col("vec_id").cast("string").alias("qid"), "embedding")
    return vector.knn_batch(projection.nodes(spark, sf_dir), queries, 5, "cue")


@plain(f"""SELECT qid, node_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node_id) AS rank FROM (
  SELECT CAST(q.vec_id AS VARCHAR) AS qid, 'cue:vec:' || c.vec_id AS node_id, round({_COSINE.format(a="c.embedding::DOUBLE[]", b="q.embedding::DOUBLE[]")}, 6) AS score
  FROM embeddings c, embeddings q)) WHERE rank <= 10""")
def knn_indexed(spark, sf_dir):
    """The ten nearest cues of every cue, through an index that is built, saved and loaded; exact."""
    index = vector_index.build(projection.nodes(spark, sf_dir), lineage.kept_path(spark, "vectors"))
    queries = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("qid"), "embedding")
    return vector_index.knn_indexed(vector_index.load(spark, index.path), queries, 10, "cue")


@query("," + _HITS.format(k=5) + " SELECT id, 'cue' AS node_kind, text AS label, score FROM hits")
def semantic_search(spark, sf_dir):
    graph = projection.graph(spark, sf_dir)
    return read.search(graph, _vector(spark, sf_dir, 7), 5).select("id", F.lit("cue").alias("node_kind"), F.col("text").alias("label"), "score")


@query(
    "," + _CUES + " SELECT s.id, e.edge_type, e.edge_seq, n.id AS neighbor FROM cues s JOIN edges e ON e.source_id = s.id JOIN nodes n ON n.id = e.target_id"
)
def neighbors_out(spark, sf_dir):
    found = g.neighbors(projection.graph(spark, sf_dir), _some_cues(spark, sf_dir))
    return found.select("id", "edge_type", "edge_seq", F.col("n_id").alias("neighbor"))


@query(
    """ SELECT t.id, e.edge_type, e.edge_seq, n.id AS neighbor FROM nodes t JOIN edges e ON e.target_id = t.id JOIN nodes n ON n.id = e.source_id
   WHERE t.memory_layer = 'topic'"""
)
def neighbors_in(spark, sf_dir):
    graph = projection.graph(spark, sf_dir)
    topics = graph.nodes.where("memory_layer = 'topic'").select(F.lit(0).alias("ord"), "id")
    return g.neighbors(graph, topics, direction="incoming").select("id", "edge_type", "edge_seq", F.col("n_id").alias("neighbor"))


@query(
    """ SELECT s.id, e.edge_seq, n.id AS neighbor FROM nodes s JOIN edges e ON e.source_id = s.id AND e.edge_type = 'tagged_with'
   JOIN nodes n ON n.id = e.target_id WHERE s.source_file = 'src3'"""
)
def neighbors_typed(spark, sf_dir):
    graph = projection.graph(spark, sf_dir)
    ids = g.nodes_for_file(graph, "src3").select(F.lit(0).alias("ord"), "id")
    return g.neighbors(graph, ids, "tagged_with").select("id", "edge_seq", F.col("n_id").alias("neighbor"))


@query(""" SELECT s.id, 'outgoing' AS direction, e.edge_type, e.edge_seq, e.target_id AS neighbor FROM nodes s JOIN edges e ON e.source_id = s.id
UNION ALL SELECT s.id, 'incoming', e.edge_type, e.edge_seq, e.source_id FROM nodes s JOIN edges e ON e.target_id = s.id""")
def neighbors_packed(spark, sf_dir):
    """All neighbours of all nodes, both ways, from the packed adjacency."""
    ids = projection.graph(spark, sf_dir).nodes.select("id")
    rows = [packed.neighbors(projection.packed(spark, sf_dir), ids, direction=d).withColumn("direction", F.lit(d)) for d in ("outgoing", "incoming")]
    return rows[0].unionByName(rows[1]).select("id", "direction", "edge_type", "edge_seq", F.col("neighbor_id").alias("neighbor"))


@query("," + _CUES + "," + _FORWARD.format(start="cues") + """ SELECT ord, edge_seq, content_id FROM firsts WHERE place = 1 AND content_id IN (
  SELECT id FROM tags_of WHERE (category = 'language' AND value = 'en') OR (category = 'pattern_type' AND value = 'quality:1')
    GROUP BY id HAVING count(*) = 2)""")
def traverse_packed_tags(spark, sf_dir):
    """Contents of every cue that have two tags, from the packed candidates."""
    wanted = [("language", "en"), ("pattern_type", "quality:1")]
    return packed.traverse_forward(projection.packed(spark, sf_dir), _some_cues(spark, sf_dir), wanted)


@query("," + _CUES + "," + _FORWARD.format(start="cues") + " SELECT ord, edge_seq, content_id FROM firsts WHERE place = 1")
def traverse_forward(spark, sf_dir):
    return read.traverse_forward(projection.graph(spark, sf_dir), _some_cues(spark, sf_dir))


@query("," + _CUES + "," + _FORWARD.format(start="cues") + """ SELECT ord, edge_seq, content_id FROM firsts WHERE place = 1 AND content_id IN (
  SELECT id FROM tags_of WHERE (category = 'language' AND value = 'en') OR (category = 'pattern_type' AND value = 'quality:1')
    GROUP BY id HAVING count(*) = 2)""")
def traverse_forward_tags(spark, sf_dir):
    wanted = [("language", "en"), ("pattern_type", "quality:1")]
    return read.traverse_forward(projection.graph(spark, sf_dir), _some_cues(spark, sf_dir), wanted)


@query(""", hops AS (
  SELECT -d.doc_id AS ord, e.edge_seq, n.id AS cue_id, n.text FROM documents d
    JOIN edges e ON e.target_id = 'content:doc:' || d.doc_id AND e.edge_type = 'cue_of'
    JOIN nodes n ON n.id = e.source_id AND n.node_type = 'cue')
SELECT ord, edge_seq, cue_id, text FROM (SELECT *, row_number() OVER (PARTITION BY cue_id ORDER BY ord, edge_seq) AS place FROM hops)
  WHERE place = 1""")
def traverse_reverse(spark, sf_dir):
    contents = table(spark, sf_dir, "documents").select(
        (-F.col("doc_id")).alias("ord"),
        F.concat(F.lit("content:doc:"), F.col("doc_id").cast("string")).alias("id"),
    )
    return read.traverse_reverse(projection.graph(spark, sf_dir), contents)


@query(" SELECT id, redirect_id FROM redirects")
def redirect_resolve(spark, sf_dir):
    return g.redirects(projection.graph(spark, sf_dir))


@query(" SELECT id, array_to_string(list_sort(list(category || '=' || value)), ',') AS tags FROM tags_of GROUP BY id")
def content_tags(spark, sf_dir):
    return g.content_tags(projection.graph(spark, sf_dir)).withColumn("tags", F.array_join("tags", ","))


_FETCH_IDS = ", wanted AS (SELECT event_id AS ord, 'content:doc:' || (user_id * 3) AS id FROM events)"


@query(
    _FETCH_IDS + """ SELECT w.ord, w.id, c.git_sha, c.symbol_name, length(c.body) AS body_length FROM wanted w
   JOIN nodes c ON c.id = w.id AND c.node_type = 'content' AND c.status = 'active'"""
)
def fetch(spark, sf_dir):
    ids = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"),
        F.concat(F.lit("content:doc:"), (F.col("user_id") * 3).cast("string")).alias("id"),
    )
    return read.fetch(projection.graph(spark, sf_dir), ids).select(
        "ord",
        "id",
        "git_sha",
        "symbol_name",
        F.length("body").cast("long").alias("body_length"),
    )


@query(""" SELECT c.id, 'content' AS node_kind, coalesce(nullif(c.signature, ''), nullif(c.symbol_name, ''), c.kind) AS label,
  CASE WHEN length(c.body) > 500 THEN c.body[1:500] || '…' ELSE c.body END AS snippet,
  coalesce((SELECT array_to_string(list_sort(list(t.category || '=' || t.value)), ',') FROM tags_of t WHERE t.id = c.id), '') AS tags
FROM nodes c WHERE c.node_type = 'content'""")
def node_summaries(spark, sf_dir):
    return read.content_summaries(projection.graph(spark, sf_dir)).withColumn("tags", F.array_join("tags", ","))


@query(
    """ SELECT id, status, source_file, git_sha, kind, memory_layer, symbol_name, signature, length(body) AS body_length FROM nodes
   WHERE node_type = 'content'"""
)
def content_detail(spark, sf_dir):
    rows = read.content_details(projection.nodes(spark, sf_dir))
    return rows.select(
        "id",
        "status",
        "source_file",
        "git_sha",
        "kind",
        "memory_layer",
        "symbol_name",
        "signature",
        F.length("body").cast("long").alias("body_length"),
    )


@query(" SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count")
def graph_counts(spark, sf_dir):
    return g.counts(projection.graph(spark, sf_dir))


@query(
    """ SELECT count(*) AS size, CAST(max(len(embedding)) AS INTEGER) AS embedding_dim, 'driver-d64' AS embedding_model FROM nodes
   WHERE embedding IS NOT NULL"""
)
def index_metadata(spark, sf_dir):
    return g.index_metadata(projection.graph(spark, sf_dir))


@query(" SELECT id, node_type, kind, memory_layer FROM nodes WHERE source_file = 'src5'")
def nodes_for_file(spark, sf_dir):
    return g.nodes_for_file(projection.graph(spark, sf_dir), "src5").select("id", "node_type", "kind", "memory_layer")


# ------------------------------------------------------------------ writes

_NODE_LOG = """, log AS (SELECT 'cue:vec:' || (event_id % 700) AS id, event_type AS text, row_number() OVER (ORDER BY ts, event_id) AS version
  FROM events), top AS (SELECT max(node_seq) AS t FROM nodes)"""


def _versions(spark, sf_dir) -> DataFrame:
    """Events with the place of each in the log.

    Log places are counted in two steps, by day and within the day.
    """
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    days = events.groupBy("day").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a day
    days = days.select("day", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("day").orderBy("ts", "event_id"))
    return events.withColumn("inside", inside).join(days, "day").withColumn("version", (F.col("before") + F.col("inside")).cast("long"))


@query(_NODE_LOG + """ SELECT coalesce(n.id, l.id) AS id, coalesce(l.text, n.text) AS text, coalesce(n.node_seq, t + 1 + l.first) AS node_seq
FROM (SELECT * FROM nodes WHERE node_type = 'cue') n FULL JOIN (SELECT id, arg_max(text, version) AS text, min(version) AS first FROM log
  GROUP BY id) l ON n.id = l.id, top""")
def upsert_nodes(spark, sf_dir):
    graph = projection.graph(spark, sf_dir)
    delta = _versions(spark, sf_dir).select(
        F.concat(F.lit("cue:vec:"), (F.col("event_id") % 700).cast("string")).alias("id"),
        F.lit("cue").alias("node_type"),
        F.lit("active").alias("status"),
        F.lit("concept").alias("cue_type"),
        F.col("event_type").alias("text"),
        "version",
    )
    return mutate.upsert_nodes(graph, delta).nodes.where("node_type = 'cue'").select("id", "text", "node_seq")


@query(""", log AS (
  SELECT 'cue:vec:' || (event_id % (SELECT count(*)
    FROM embeddings)) AS source_id, 'content:doc:' || (user_id % n) AS target_id, event_type AS source_file, row_number() OVER (ORDER BY ts, event_id) AS version
    FROM events, n_docs),
latest AS (SELECT source_id, target_id, arg_max(source_file, version) AS source_file, min(version) AS first FROM log GROUP BY ALL),
top AS (SELECT max(edge_seq) AS t FROM edges)
SELECT coalesce(e.source_id, l.source_id) AS source_id, coalesce(e.target_id, l.target_id) AS target_id, coalesce(l.source_file, e.source_file) AS source_file, coalesce(e.edge_seq, t + 1 + l.first) AS edge_seq
FROM (SELECT * FROM edges WHERE edge_type = 'cue_of') e FULL JOIN latest l ON e.source_id = l.source_id AND e.target_id = l.target_id, top""")
def upsert_edges(spark, sf_dir):
    graph = projection.graph(spark, sf_dir)
    n, vectors = table(spark, sf_dir, "documents").count(), table(spark, sf_dir, "embeddings").count()
    delta = _versions(spark, sf_dir).select(
        F.concat(F.lit("cue:vec:"), (F.col("event_id") % vectors).cast("string")).alias("source_id"),
        F.concat(F.lit("content:doc:"), (F.col("user_id") % n).cast("string")).alias("target_id"),
        F.lit("cue_of").alias("edge_type"),
        F.col("event_type").alias("source_file"),
        "version",
    )
    return mutate.upsert_edges(graph, delta).edges.where("edge_type = 'cue_of'").select("source_id", "target_id", "source_file", "edge_seq")


_GONE = """, gone AS (SELECT 'cue:vec:' || vec_id AS id FROM embeddings WHERE label = 3 UNION SELECT 'content:doc:' || doc_id FROM documents
  WHERE lang = 'es')"""
def _row_hash_sql(columns: list[str]) -> str:
    """The sum over rows of a hash of all their columns, so that a wrong value in any of them shows."""
    texts = ", ".join(f"CAST({c} AS VARCHAR)" for c in columns)
    return f"CAST(sum(CAST('0x' || substr(md5(concat_ws('|', {texts})), 1, 8) AS BIGINT)) AS BIGINT)"


_NODE_COLUMNS = ["id", "node_type", "status", "source_file", "git_sha", "text", "category", "value", "kind", "memory_layer", "symbol_name", "signature", "body"]
_EDGE_COLUMNS = ["source_id", "target_id", "edge_type", "source_file"]
_VECTOR = "list_sum(list_transform(embedding, lambda x, i: CAST(round(x * 1000000) AS BIGINT) * i))"
_KINDS = f"""SELECT 'node' AS what, node_type AS kind, count(*) AS n, {_row_hash_sql([*_NODE_COLUMNS, _VECTOR])} AS rows_hash FROM kept_nodes GROUP BY node_type
  UNION ALL SELECT 'edge', edge_type, count(*), {_row_hash_sql(_EDGE_COLUMNS)} FROM kept_edges GROUP BY edge_type"""
KINDS = "what string, kind string, n long, rows_hash long"


def _row_hash(columns: list) -> F.Column:
    text = F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns])
    return F.sum(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")).alias("rows_hash")


def _kinds(graph: Graph) -> DataFrame:
    """Nodes and edges by type: how many, and a hash of all their columns."""
    vector = F.aggregate(F.transform("embedding", lambda x, i: F.round(x * 1000000).cast("long") * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    nodes = graph.nodes.groupBy(F.lit("node").alias("what"), F.col("node_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), _row_hash([*_NODE_COLUMNS, vector]))
    edges = graph.edges.groupBy(F.lit("edge").alias("what"), F.col("edge_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), _row_hash(_EDGE_COLUMNS))
    return nodes.unionByName(edges)


@query(
    _GONE + ", kept_nodes AS (SELECT * FROM nodes WHERE id NOT IN (SELECT id FROM gone)), kept_edges AS (SELECT * FROM edges WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)) " + _KINDS
)
def delete_nodes(spark, sf_dir):
    graph = projection.graph(spark, sf_dir)
    cues = table(spark, sf_dir, "embeddings").where("label = 3").select(F.concat(F.lit("cue:vec:"), F.col("vec_id").cast("string")).alias("id"))
    docs = table(spark, sf_dir, "documents").where("lang = 'es'").select(F.concat(F.lit("content:doc:"), F.col("doc_id").cast("string")).alias("id"))
    return _kinds(mutate.delete_nodes(graph, cues.unionByName(docs)))


@query(""", dying AS (SELECT id FROM nodes WHERE source_file IN ('src0', 'src7')), kept_nodes AS (SELECT * FROM nodes WHERE id NOT IN (SELECT id FROM dying)),
kept_edges AS (SELECT * FROM edges WHERE source_id NOT IN (SELECT id FROM dying) AND target_id NOT IN (SELECT id FROM dying) AND coalesce(source_file, '') NOT IN ('src0', 'src7')) """ + _KINDS)
def delete_for_file(spark, sf_dir):
    files = spark.createDataFrame([("src0",), ("src7",)], "source_file string")
    return _kinds(mutate.delete_nodes_for_files(projection.graph(spark, sf_dir), files))


@query(
    ", kept_nodes AS (SELECT * FROM nodes WHERE status = 'active'), kept_edges AS (SELECT * FROM edges WHERE source_id IN (SELECT id FROM kept_nodes) AND target_id IN (SELECT id FROM kept_nodes)) " + _KINDS
)
def compact(spark, sf_dir):
    return _kinds(mutate.compact(projection.graph(spark, sf_dir)))


# ------------------------------------------------------------------ scans and scalars

_BLOB = "sha1(encode('blob ' || octet_length(encode(html))) || '\\x00'::BLOB || encode(html))"


@plain(f"SELECT page_id, {_BLOB} AS git_sha FROM pages")
def blob_sha(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalar.git_blob_sha("html").alias("git_sha"))


def _scan_and_manifest(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    scan = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("file_path"), scalar.git_blob_sha("html").alias("git_sha"))
    known = scan.where("page_id % 3 <> 2").select(
        "file_path",
        F.when(F.col("page_id") % 3 == 0, F.col("git_sha")).otherwise("stale").alias("git_sha"),
    )
    return scan, known


_MANIFEST = f"""scan AS (SELECT page_id, url AS file_path, {_BLOB} AS git_sha
  FROM pages), known AS (SELECT file_path, CASE WHEN page_id % 3 = 0 THEN git_sha ELSE 'stale' END AS git_sha FROM scan
  WHERE page_id % 3 <> 2)"""


@plain(
    f"""WITH {_MANIFEST} SELECT page_id, file_path FROM scan s WHERE NOT EXISTS (SELECT 1 FROM known k
  WHERE k.file_path = s.file_path AND k.git_sha = s.git_sha)"""
)
def manifest_skip(spark, sf_dir):
    return mutate.changed_files(*_scan_and_manifest(spark, sf_dir)).select("page_id", "file_path")


@plain(
    f"""WITH {_MANIFEST} SELECT count(*) AS scanned, count(*) FILTER (WHERE k.git_sha IS NOT NULL) AS skipped, count(*) FILTER (WHERE k.git_sha IS NULL) AS indexed
  FROM scan s LEFT JOIN (SELECT DISTINCT * FROM known) k ON k.file_path = s.file_path AND k.git_sha = s.git_sha"""
)
def index_stats(spark, sf_dir):
    scan, known = _scan_and_manifest(spark, sf_dir)
    joined = scan.join(known.distinct().withColumn("hit", F.lit(1)), ["file_path", "git_sha"], "left")
    return joined.agg(F.count(F.lit(1)).alias("scanned"), F.count("hit").alias("skipped"), F.count_if(F.col("hit").isNull()).alias("indexed"))


@plain(
    r"SELECT p_partkey, replace(regexp_replace(regexp_replace(path, '\.py$', ''), '(^|/)__init__$', ''), '/', '.') AS module FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '__init__.py' WHEN 1 THEN 'pkg' || p_size || '/__init__.py' ELSE 'pkg' || p_size || '/mod_' || p_partkey || '.py' END AS path FROM part)"
)
def module_path(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    path = F.when(key % 4 == 0, F.lit("__init__.py")).when(key % 4 == 1, F.concat(F.lit("pkg"), size, F.lit("/__init__.py"))).otherwise(
        F.concat(F.lit("pkg"), size, F.lit("/mod_"), key.cast("string"), F.lit(".py"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", scalar.module_path(path).alias("module"))


_BYTES = "list_transform(range(0, 32), lambda i: CAST(CAST('0x' || substr(sha256(text), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT) AS DOUBLE) - 128.0)"


@plain(
    f"""SELECT item_id, round(list_sum(list_transform(v, lambda x: x * x)), 9) AS squared, round(v[1], 9) AS v0, round(v[32], 9) AS v31
  FROM (SELECT item_id, list_transform(b, lambda x: x / sqrt(list_inner_product(b, b))) AS v FROM (SELECT item_id, {_BYTES} AS b
  FROM benchmark))"""
)
def hash_embed(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", scalar.hash_embedding("text").alias("v"))
    return rows.select(
        "item_id",
        F.round(scalar.dot("v", "v"), 9).alias("squared"),
        F.round(F.col("v")[0], 9).alias("v0"),
        F.round(F.col("v")[31], 9).alias("v31"),
    )


@plain(f"""WITH raw AS (SELECT item_id, {_BYTES} AS b FROM benchmark), q AS (SELECT {_BYTES} AS b
  FROM (SELECT 'how is a transaction committed' AS text))
SELECT CAST(item_id AS VARCHAR) AS node_id, round({_COSINE.format(a="raw.b", b="q.b")}, 6) AS score
  FROM raw, q ORDER BY score DESC, node_id LIMIT 5""")
def hash_embed_search(spark, sf_dir):
    import hashlib

    raw = [b - 128.0 for b in hashlib.sha256(b"how is a transaction committed").digest()]
    rows = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("id"),
        F.lit("active").alias("status"),
        F.lit("cue").alias("node_type"),
        scalar.hash_embedding("text").alias("embedding"),
    )
    return vector.knn(rows, raw, 5)


# ------------------------------------------------------------------ walk


@query(", topics AS (SELECT 'content:doc:' || doc_id AS id, doc_id FROM documents WHERE doc_id % 10 = 0), " + """
cue_part AS (SELECT t.id AS qid, n.id AS candidate_id, 0 AS branch, e.edge_seq FROM topics t
  JOIN edges e ON e.target_id = t.id AND e.edge_type = 'cue_of'
  JOIN nodes n ON n.id = e.source_id AND n.node_type = 'cue' AND n.status = 'active'),
peer_part AS (SELECT t.id AS qid, c.id AS candidate_id, 1 AS branch, e.edge_seq FROM topics t
  JOIN edges e ON e.source_id = t.id AND e.edge_type = 'part_of_topic' LEFT JOIN redirects r ON r.id = e.target_id
  JOIN nodes c ON c.id = coalesce(r.redirect_id, e.target_id) AND c.node_type = 'content' AND c.status = 'active')
SELECT * FROM cue_part UNION ALL SELECT * FROM peer_part""")
def walk_candidates(spark, sf_dir):
    """Candidates of every tenth document as a current node."""
    from ..operators import walk

    graph = projection.graph(spark, sf_dir)
    current = table(spark, sf_dir, "documents").where("doc_id % 10 = 0").select(
        F.concat(F.lit("content:doc:"), F.col("doc_id").cast("string")).alias("id")
    )
    found = walk.candidates(graph, current.withColumn("qid", F.col("id")))
    return found.select("qid", "candidate_id", "ord.branch", "ord.edge_seq")


@query(", topics AS (SELECT 'content:doc:' || doc_id AS id FROM documents), " + """
cue_part AS (SELECT t.id AS qid, n.id AS candidate_id, 0 AS branch, e.edge_seq FROM topics t
  JOIN edges e ON e.target_id = t.id AND e.edge_type = 'cue_of'
  JOIN nodes n ON n.id = e.source_id AND n.node_type = 'cue' AND n.status = 'active'),
peer_part AS (SELECT t.id AS qid, c.id AS candidate_id, 1 AS branch, e.edge_seq FROM topics t
  JOIN edges e ON e.source_id = t.id AND e.edge_type = 'part_of_topic' LEFT JOIN redirects r ON r.id = e.target_id
  JOIN nodes c ON c.id = coalesce(r.redirect_id, e.target_id) AND c.node_type = 'content' AND c.status = 'active')
SELECT * FROM cue_part UNION ALL SELECT * FROM peer_part""")
def walk_candidates_all(spark, sf_dir):
    """Candidates of every document as a current node."""
    from ..operators import walk

    graph = projection.graph(spark, sf_dir)
    current = table(spark, sf_dir, "documents").select(F.concat(F.lit("content:doc:"), F.col("doc_id").cast("string")).alias("id"))
    found = walk.candidates(graph, current.withColumn("qid", F.col("id")))
    return found.select("qid", "candidate_id", "ord.branch", "ord.edge_seq")


@query()
def reconstruct_rule(spark, sf_dir):
    """Walks of all vectors as queries, 3 seeds each, by the rule planner; as 3 steps of a depth-first state this has no oracle in SQL."""
    from ..operators import walk

    graph = projection.graph(spark, sf_dir)
    queries = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("qid"), "embedding")
    hits = vector.knn_batch(graph.nodes, queries, 3, "cue")
    seeds = hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_id"))), lambda h: h["node_id"]).alias("seeds"))
    return walk.reconstruct(graph, seeds, walk.rule_planner(), budget=3)


# ------------------------------------------------------------------ cross-references


def _occurrences(spark, sf_dir) -> DataFrame:
    """Line items as occurrences: suppliers are files, parts symbols, the first line of an order defines."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    empty = F.lit(None).cast("array<int>")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(
            F.lit("src/f"),
            (F.col("l_suppkey") % 50).cast("string"),
            F.lit(".py"),
        ).alias("relative_path"), (F.col("l_suppkey") % 50).cast("int").alias("doc_idx"), (key * 10 + line).alias("occ_idx"),
        F.concat(
            F.lit("sym "),
            (F.col("l_partkey") % 500).cast("string"),
            F.lit("#"),
        ).alias("symbol"), F.when(line == 1, 1).otherwise(8).alias("symbol_roles"),
        F.when(
            line % 4 == 0,
            F.struct(
                (key % 1000).cast("int").alias("line"),
                line.cast("int").alias("start_character"),
                (line + 5).cast("int").alias("end_character"),
            ),
        ).alias("single_line"),
        F.when(
            line % 4 == 1,
            F.struct(
                (key % 1000).cast("int").alias("start_line"),
                line.cast("int").alias("start_character"),
                (key % 1000 + 2).cast("int").alias("end_line"),
                F.lit(1).alias("end_character"),
            ),
        ).alias("multi_line"),
        F.when(line % 4 == 2, F.array((key % 1000).cast("int"), line.cast("int"), (line + 9).cast("int"))).when(
            line % 4 == 3,
            F.array((key % 1000).cast("int"), line.cast("int"), (key % 1000 + 1).cast("int"), F.lit(4)),
        ).otherwise(empty).alias("range"),
    )


_OCC = """WITH occ AS (
  SELECT 'src/f' || (l_suppkey % 50) || '.py' AS relative_path, l_orderkey * 10 + l_linenumber AS occ_idx, 'sym ' || (l_partkey % 500) || '#' AS symbol, l_linenumber = 1 AS is_definition,
         CAST(l_orderkey % 1000 AS INTEGER) AS start_line, l_linenumber AS start_character,
         CAST(CASE l_linenumber % 4 WHEN 0 THEN l_orderkey % 1000 WHEN 1 THEN l_orderkey % 1000 + 2 WHEN 2 THEN l_orderkey % 1000 ELSE l_orderkey % 1000 + 1 END AS INTEGER) AS end_line,
         CAST(CASE l_linenumber % 4 WHEN 0 THEN l_linenumber + 5 WHEN 1 THEN 1 WHEN 2 THEN l_linenumber + 9 ELSE 4 END AS INTEGER) AS end_character
  FROM lineitem) """


@plain(_OCC + "SELECT relative_path, occ_idx, symbol, start_line, start_character, end_line, end_character FROM occ WHERE is_definition")
def scip_definitions(spark, sf_dir):
    from ..operators import scip

    return scip.definitions(_occurrences(spark, sf_dir)).drop("doc_idx", "is_definition")


@plain(
    _OCC + """SELECT relative_path, occ_idx, symbol, start_line, end_line FROM occ
  WHERE NOT is_definition AND symbol IN (SELECT DISTINCT 'sym ' || (p_partkey % 500) || '#' FROM part WHERE p_size = 7)"""
)
def scip_references(spark, sf_dir):
    """References of contents whose ids are symbols, for the parts of one size."""
    from ..operators import scip

    ids = table(spark, sf_dir, "part").where("p_size = 7").select(
        F.concat(F.lit("sym "), (F.col("p_partkey") % 500).cast("string"), F.lit("#")).alias("content_id")
    ).distinct()
    nodes = ids.select(F.col("content_id").alias("id"), F.lit("content").alias("node_type"))
    return scip.content_references(nodes, _occurrences(spark, sf_dir), ids).select("relative_path", "occ_idx", "symbol", "start_line", "end_line")


@plain(
    _OCC + """SELECT relative_path AS source_file, start_line + 1 AS lineno, arg_max(symbol, {'a': occ_idx, 'b': symbol}) AS scip_symbol FROM occ
  WHERE is_definition GROUP BY ALL"""
)
def scip_line_symbols(spark, sf_dir):
    from ..operators import scip

    return scip.line_symbols(_occurrences(spark, sf_dir))


@plain("""WITH rel AS (
  SELECT CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'src/f' || (s_suppkey % 5) || '.py' END AS relative_path, s_suppkey AS sym_idx, 'sym ' || (s_suppkey % 40) || '#' AS symbol, 'sym ' || (s_suppkey % 7) || '#' AS target, s_nationkey % 2 = 0 AS is_implementation
    FROM supplier),
contents AS (SELECT DISTINCT 'sym ' || (s_suppkey % 40) || '#' AS symbol, 'src/f' || (s_suppkey % 40 % 5) || '.py' AS source_file
  FROM supplier),
ranked AS (SELECT r.*, rank() OVER (PARTITION BY r.symbol ORDER BY r.relative_path IS NULL, sym_idx) AS place FROM contents c
  JOIN rel r ON r.symbol = c.symbol AND (r.relative_path = c.source_file OR r.relative_path IS NULL))
SELECT symbol, target FROM ranked WHERE place = 1 AND is_implementation""")
def scip_relations(spark, sf_dir):
    from ..operators import scip

    key = F.col("s_suppkey")
    symbol = F.concat(F.lit("sym "), (key % 40).cast("string"), F.lit("#"))
    even = F.col("s_nationkey") % 2 == 0
    relationships = table(spark, sf_dir, "supplier").select(
        F.when(
            key % 3 != 0,
            F.concat(F.lit("src/f"), (key % 5).cast("string"), F.lit(".py")),
        ).alias("relative_path"), key.alias("sym_idx"), symbol.alias("symbol"), F.concat(
            F.lit("sym "),
            (key % 7).cast("string"),
            F.lit("#"),
        ).alias("target"),
        F.lit(False).alias("is_reference"), even.alias("is_implementation"), (~even).alias("is_type_definition"), F.lit(False).alias("is_definition"),
    )
    contents = table(spark, sf_dir, "supplier").select(
        symbol.alias("id"),
        F.concat(F.lit("src/f"), (key % 40 % 5).cast("string"), F.lit(".py")).alias("source_file"),
        F.lit("content").alias("node_type"),
    ).distinct()
    return scip.content_relations(
        contents,
        relationships,
        contents.select(F.col("id").alias("content_id")),
        "is_implementation",
    ).select("symbol", "target")


@query()
def extract_sources(spark, sf_dir):
    """Nodes of this package's own source files by type and kind (parsing has no SQL)."""
    from datetime import datetime
    from pathlib import Path

    from ..operators import extract
    from ..sources import files

    scan = files.scan(spark, Path(__file__).resolve().parent.parent)
    return extract.extract_files(scan, datetime(2026, 1, 1)).nodes.groupBy("node_type", "kind").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ further single operators


@query(
    """ SELECT w.ord, w.id, n.node_type, n.status
   FROM (SELECT event_id AS ord, CASE WHEN event_id % 2 = 0 THEN 'cue:vec:' || user_id ELSE 'content:doc:' || user_id END AS id
   FROM events) w JOIN nodes n ON n.id = w.id"""
)
def get_nodes(spark, sf_dir):
    """Point lookups in a batch, tombstones included."""
    user = F.col("user_id").cast("string")
    ids = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("cue:vec:"), user)).otherwise(F.concat(F.lit("content:doc:"), user)).alias("id"),
    )
    return g.get_nodes(projection.graph(spark, sf_dir), ids).select("ord", "id", "node_type", "status")


@query(
    """ SELECT node_type, CASE WHEN id IN (SELECT 'content:doc:' || doc_id FROM documents
   WHERE doc_id % 7 = 0) THEN 'deleted' ELSE status END AS status, count(*) AS n FROM nodes GROUP BY ALL"""
)
def tombstones(spark, sf_dir):
    gone = table(spark, sf_dir, "documents").where("doc_id % 7 = 0").select(
        F.concat(F.lit("content:doc:"), F.col("doc_id").cast("string")).alias("id")
    )
    marked = mutate.tombstone(projection.graph(spark, sf_dir), gone, "2026-01-01 00:00:00", "c0ffee")
    return marked.nodes.groupBy("node_type", "status").agg(F.count(F.lit(1)).alias("n"))


@query(""" SELECT id, embedding IS NOT NULL AND CAST(replace(id, 'cue:vec:', '') AS BIGINT) % 3 <> 0 AS has_vector FROM nodes WHERE node_type = 'cue'""")
def remove_vectors(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings").where("vec_id % 3 = 0").select(F.concat(F.lit("cue:vec:"), F.col("vec_id").cast("string")).alias("id"))
    left = mutate.remove_vectors(projection.graph(spark, sf_dir), ids).nodes.where("node_type = 'cue'")
    return left.select("id", F.col("embedding").isNotNull().alias("has_vector"))


@plain(
    """SELECT file_path, arg_max(sha, moment) AS git_sha
  FROM (SELECT 'src/' || user_id || '.py' AS file_path, event_type || event_id AS sha, {'odd': event_id % 2, 't': ts, 'e': event_id} AS moment
  FROM events) GROUP BY file_path"""
)
def record_files(spark, sf_dir):
    """Events as file versions: even ones are recorded first, odd ones then; the last write of a file stays, whatever its time."""
    from ..schema import INDEXED_FILES

    rows = _versions(spark, sf_dir).select(
        F.concat(F.lit("src/"), F.col("user_id").cast("string"), F.lit(".py")).alias("file_path"),
        F.concat("event_type", F.col("event_id").cast("string")).alias("git_sha"),
        F.col("ts").cast("timestamp_ntz").alias("indexed_at"),
        "version",
        "event_id",
    )
    even = F.col("event_id") % 2 == 0
    manifest = mutate.record_files(spark.createDataFrame([], INDEXED_FILES), rows.where(even))
    return mutate.record_files(manifest, rows.where(~even)).select("file_path", "git_sha")


@plain(
    """SELECT item_id, 'cue:error:f' || item_id || '.py::' || substr(sha1(text), 1, 12) AS error_cue, 'tag:language:python' AS tag, CASE WHEN item_id % 2 = 0 THEN 'sym ' || item_id ELSE 'content:f' || item_id || '.py::C.m' END AS content
  FROM benchmark"""
)
def identity_scheme(spark, sf_dir):
    """Ids of error cues, tags and contents, with and without a cross-reference symbol."""
    item = F.col("item_id").cast("string")
    file = F.concat(F.lit("f"), item, F.lit(".py"))
    symbol = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("sym "), item)).otherwise("")
    return table(spark, sf_dir, "benchmark").select(
        "item_id", scalar.error_cue_id(file, F.col("text")).alias("error_cue"), scalar.tag_id(F.lit("language"), F.lit("python")).alias("tag"), scalar.definition_content_id(file, F.lit("C.m"), symbol).alias("content")
    )


@plain(_OCC + "SELECT occ_idx, symbol, start_line, start_character, is_definition FROM occ WHERE relative_path = 'src/f7.py'")
def scip_occurrences(spark, sf_dir):
    from ..operators import scip

    return scip.occurrences_of(_occurrences(spark, sf_dir), "src/f7.py").select("occ_idx", "symbol", "start_line", "start_character", "is_definition")


@plain("SELECT DISTINCT 'src/f' || (l_suppkey % 50) || '.py' AS relative_path FROM lineitem")
def scip_files(spark, sf_dir):
    from ..operators import scip

    return scip.files(_occurrences(spark, sf_dir))
