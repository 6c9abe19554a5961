"""Queries over generated source files, with equivalent DuckDB SQL: parsing, extraction, indexing and the store.

Every part is a Python file: a decorated function that raises, a class with a
method and an async test; each fifth ends in a broken statement, each seventh is
not UTF-8.  SQL builds the expected rows from the same pieces of text.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..index import index_files
from ..operators import extract, mutate
from ..operators import graph as g
from ..operators.graph import Graph
from ..sources.store import Store
from . import lineage, projection
from .projection import table
from .queries import _KINDS, KINDS, _kinds, plain, query

AT = datetime(2026, 1, 1)

#: The pieces of a file: {k} is the part's key, {s} its size, {b} its brand.
PIECES = {
    "head": '"""Module {k} of {b}."""\nimport os\n\n\n@deco({k})\n',
    "run": 'def run_{k}(a: int, b=1) -> str:\n    """Run {b}."""\n    raise ValueError("no {b}")',
    "gap": "\n\n\n",
    "box": 'class Box{k}(Base, Mixin):\n    """Box."""\n\n    ',
    "size": 'def size(self) -> int:\n        raise KeyError("lost {k}")',
    "between": "\n\n    ",
    "test": "async def test_open(self):\n        return {s}",
    "tail": "\n",
    "broken": "\n\ndef broken(:\n    pass\n",
}


def _spark_text(pattern: str) -> F.Column:
    c = F.lit(pattern)
    for mark, name in (("{k}", "p_partkey"), ("{s}", "p_size"), ("{b}", "p_brand")):
        c = F.replace(c, F.lit(mark), F.col(name).cast("string"))
    return c


def _sql_text(pattern: str) -> str:
    c = "'" + pattern.replace("'", "''") + "'"
    for mark, name in (("{k}", "p_partkey"), ("{s}", "p_size"), ("{b}", "p_brand")):
        c = f"replace({c}, '{mark}', CAST({name} AS VARCHAR))"
    return c


def source_files(spark, sf_dir: str) -> DataFrame:
    """(source_file, content) of every part."""
    pieces = {n: _spark_text(t) for n, t in PIECES.items()}
    whole = F.concat(*[pieces[n] for n in PIECES if n != "broken"], F.when(F.col("p_partkey") % 5 == 0, pieces["broken"]).otherwise(F.lit("")))
    content = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit(b"\xff\xfe"), whole.cast("binary"))).otherwise(whole.cast("binary"))
    name = F.concat(F.lit("pkg"), F.col("p_size").cast("string"), F.lit("/mod_"), F.col("p_partkey").cast("string"), F.lit(".py"))
    return table(spark, sf_dir, "part").select(name.alias("source_file"), content.alias("content"))


_FILES = f"""
pieces AS (
  SELECT p_partkey AS k, p_size AS s, p_brand AS b, 'pkg' || p_size || '/mod_' || p_partkey || '.py' AS source_file, 'pkg' || p_size || '.mod_' || p_partkey AS module_path,
    p_partkey % 7 = 0 AS bad, {", ".join(f'{_sql_text(t)} AS "{n}"' for n, t in PIECES.items())} FROM part),
files AS (
  SELECT *, "head" || "run" || "gap" || "box" || "size" || "between" || "test" || "tail" || CASE WHEN k % 5 = 0 THEN "broken" ELSE '' END AS source
    FROM pieces),
shas AS (
  SELECT source_file, sha1(encode('blob ' || octet_length(bytes)) || '\\x00'::BLOB || bytes) AS git_sha
  FROM (SELECT source_file, CASE WHEN bad THEN '\\xff\\xfe'::BLOB || encode(source) ELSE encode(source) END AS bytes FROM files)),
good AS (SELECT * FROM files WHERE NOT bad),
definitions AS (
  SELECT k, source_file, module_path, 0 AS place, 'run_' || k AS name, 'run_' || k AS qualified_name, 'function' AS kind, 'def run_' || k || '(a: int, b=1) -> str' AS signature,
         'Run ' || b || '.' AS docstring, "run" AS source, 6 AS lineno, 'deco(' || k || ')' AS decorators, 'no ' || b AS error_messages, false AS is_test
           FROM good
  UNION ALL SELECT k, source_file, module_path, 1, 'Box' || k, 'Box' || k, 'class', 'class Box' || k || '(Base, Mixin)', 'Box.', rtrim("box", ' ') || '    ' || "size" || "between" || "test", 11, '', '', false
    FROM good
  UNION ALL SELECT k, source_file, module_path, 2, 'size', 'Box' || k || '.size', 'method', 'def size(self) -> int', NULL, "size", 14, '', 'lost ' || k, false
    FROM good
  UNION ALL SELECT k, source_file, module_path, 3, 'test_open', 'Box' || k || '.test_open', 'async_method', 'async def test_open(self)', NULL, "test", 17, '', '', true
    FROM good),
contents AS (
  SELECT 'content:' || source_file || '::<module>' AS id, source_file, 'module' AS kind, 'topic' AS memory_layer, module_path AS symbol_name, NULL AS signature, 'Module ' || k || ' of ' || b || '.' AS docstring, source AS body, module_path, 'module' AS construct
    FROM good
  UNION ALL SELECT 'content:' || source_file || '::' || qualified_name, source_file, CASE WHEN is_test THEN 'test' WHEN kind = 'class' THEN 'class' ELSE 'function' END, 'semantic', qualified_name, signature, docstring, source, module_path, kind
    FROM definitions),
cues AS (
  SELECT 'cue:symbol:' || source_file || '::' || qualified_name AS id, source_file, 'symbol' AS cue_type, name AS text, 'content:' || source_file || '::' || qualified_name AS target
    FROM definitions
  UNION ALL SELECT 'cue:error:' || source_file || '::' || substr(sha1(error_messages), 1, 12), source_file, 'error_message', error_messages, 'content:' || source_file || '::' || qualified_name
    FROM definitions WHERE error_messages <> ''),
tags AS (
  SELECT id, source_file, 'language' AS category, 'python' AS value FROM contents
  UNION ALL SELECT id, source_file, 'module_path', module_path FROM contents
  UNION ALL SELECT id, source_file, 'lang_construct', construct FROM contents)
"""


def sources(sql: str):
    """Register a query with SQL over the expected tables."""
    return plain("WITH " + _FILES.strip() + " " + sql)


def _extracted(spark, sf_dir: str, symbols: DataFrame | None = None) -> Graph:
    return extract.extract_files(source_files(spark, sf_dir), AT, symbols)


@sources("""SELECT source_file, name, qualified_name, kind, signature, docstring, source, lineno, decorators, error_messages, is_test FROM definitions""")
def parse_definitions(spark, sf_dir):
    """Definitions of every file: names, signatures, docstrings, sources, lines, decorators, messages, tests."""
    rows = extract.parse_files(source_files(spark, sf_dir)).where("error IS NULL").select(
        "source_file",
        F.explode("definitions").alias("d"),
    ).select("source_file", "d.*")
    return rows.withColumns({"decorators": F.array_join("decorators", "|"), "error_messages": F.array_join("error_messages", "|")})


#: A class whose second method is broken in each fifth file, and a function after it.
_BOX = (
    'class Box{k}(Base):\n    """Box."""\n\n    def one(self):\n        raise KeyError("lost {k}")\n\n    @deco\n    def two(self, a):\n        """Two."""\n        raise OSError("no {b}")\n        return '
)
_BOX_REST = "a\n\n    async def three(self):\n        return {s}\n\n\ndef last_{k}():\n    return {s}\n"


@plain("""WITH f AS (SELECT p_partkey AS k, p_brand AS b FROM part)
SELECT k AS p_partkey, 'Box' || k AS name, 'class' AS kind, 1 AS lineno, 'class Box' || k || '(Base)' AS signature, 'Box.' AS docstring, '' AS decorators, '' AS error_messages FROM f
UNION ALL SELECT k, 'Box' || k || '.one', 'method', 4, 'def one(self)', NULL, '', 'lost ' || k FROM f
UNION ALL SELECT k, 'Box' || k || '.two', 'method', 8, 'def two(self, a)', 'Two.', 'deco', 'no ' || b FROM f
UNION ALL SELECT k, 'Box' || k || '.three', 'async_method', 13, 'async def three(self)', NULL, '', '' FROM f
UNION ALL SELECT k, 'last_' || k, 'function', 17, 'def last_' || k || '()', NULL, '', '' FROM f""")
def parse_broken_members(spark, sf_dir):
    """Definitions of files in which, each fifth time, a method does not parse: it and all others are found."""
    broken = F.when(F.col("p_partkey") % 5 == 0, "(").otherwise("")
    text = F.concat(_spark_text(_BOX), broken, _spark_text(_BOX_REST))
    files = table(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".py")).alias("source_file"), text.cast("binary").alias("content"))
    rows = extract.parse_files(files).select(F.regexp_extract("source_file", r"\d+", 0).cast("long").alias("p_partkey"), F.explode("definitions").alias("d"))
    listed = [F.array_join(f"d.{c}", "|").alias(c) for c in ("decorators", "error_messages")]
    return rows.select("p_partkey", F.col("d.qualified_name").alias("name"), "d.kind", "d.lineno", "d.signature", "d.docstring", *listed)


@sources(
    """SELECT f.source_file, h.git_sha, f.module_path, f.bad AS failed, CASE WHEN NOT f.bad THEN 'Module ' || f.k || ' of ' || f.b || '.' END AS docstring
  FROM files f JOIN shas h ON h.source_file = f.source_file"""
)
def parse_modules(spark, sf_dir):
    """Every file with its hash, module, docstring and whether it is not UTF-8."""
    rows = extract.parse_files(source_files(spark, sf_dir))
    return rows.select("source_file", "git_sha", "module_path", F.col("error").isNotNull().alias("failed"), "docstring")


_TWICE = 'def run():\n    """First."""\n    return {k}\n\n\ndef run():\n    raise ValueError("no {b}")\n'


@plain(f"""WITH f AS (SELECT 'f' || p_partkey || '.py' AS file, p_partkey, p_brand, {_sql_text(_TWICE)} AS body FROM part)
SELECT 'content:' || file || '::<module>' AS id, 'content' AS node_type, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS VARCHAR) AS docstring, body FROM f
UNION ALL SELECT 'content:' || file || '::run', 'content', NULL, NULL, 'def run():' || chr(10) || '    raise ValueError("no ' || p_brand || '")' FROM f
UNION ALL SELECT 'cue:symbol:' || file || '::run', 'cue', 'run', NULL, NULL FROM f
UNION ALL SELECT 'cue:error:' || file || '::' || substr(sha1('no ' || p_brand), 1, 12), 'cue', 'no ' || p_brand, NULL, NULL FROM f""")
def extract_duplicates(spark, sf_dir):
    """Files that define a function twice: one content and one cue of that name, with the last one's values."""
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("source_file"), _spark_text(_TWICE).cast("binary").alias("content"))
    nodes = extract.extract_files(files, AT).nodes
    return nodes.where("node_type <> 'tag'").select("id", "node_type", "text", "docstring", "body")


@sources("""SELECT c.id, 'content' AS node_type, c.kind, c.memory_layer, c.symbol_name, c.signature, c.docstring, c.body, h.git_sha, CAST(NULL AS VARCHAR) AS cue_type, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS value
FROM contents c JOIN shas h ON h.source_file = c.source_file
UNION ALL SELECT u.id, 'cue', NULL, NULL, NULL, NULL, NULL, NULL, h.git_sha, cue_type, text, NULL, NULL FROM cues u
  JOIN shas h ON h.source_file = u.source_file
UNION ALL SELECT DISTINCT 'tag:' || category || ':' || value, 'tag', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, category, value
  FROM tags""")
def extract_nodes(spark, sf_dir):
    """Module, definition, cue and tag rows of every file."""
    return _extracted(spark, sf_dir).nodes.select(
        "id",
        "node_type",
        "kind",
        "memory_layer",
        "symbol_name",
        "signature",
        "docstring",
        "body",
        "git_sha",
        "cue_type",
        "text",
        "category",
        "value",
    )


@sources("""SELECT id AS source_id, 'tag:' || category || ':' || value AS target_id, 'tagged_with' AS edge_type, source_file FROM tags
UNION ALL SELECT 'content:' || source_file || '::' || qualified_name, 'content:' || source_file || '::<module>', 'part_of_topic', source_file
  FROM definitions
UNION ALL SELECT id, target, 'cue_of', source_file FROM cues""")
def extract_edges(spark, sf_dir):
    return _extracted(spark, sf_dir).edges.select("source_id", "target_id", "edge_type", "source_file")


@sources("""SELECT id, row_number() OVER (PARTITION BY source_file ORDER BY place, step) AS nth FROM (
  SELECT id, source_file, -1 AS place, 0 AS step FROM contents WHERE kind = 'module'
  UNION ALL SELECT 'content:' || source_file || '::' || qualified_name, source_file, place, 0 FROM definitions
  UNION ALL SELECT 'cue:symbol:' || source_file || '::' || qualified_name, source_file, place, 1 FROM definitions
  UNION ALL SELECT 'cue:error:' || source_file || '::' || substr(sha1(error_messages), 1, 12), source_file, place, 2 FROM definitions
    WHERE error_messages <> '')""")
def extract_order(spark, sf_dir):
    """The order in which a file's contents and cues are first inserted."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("source_file").orderBy("node_seq"))
    return _extracted(spark, sf_dir).nodes.where("node_type <> 'tag'").select("id", nth.cast("long").alias("nth"))


@sources(
    """SELECT CASE WHEN kind = 'class' AND k % 2 = 0 THEN 'sym Box' || k || '#' ELSE 'content:' || source_file || '::' || qualified_name END AS id, kind, qualified_name
  FROM definitions"""
)
def extract_symbol_ids(spark, sf_dir):
    """Cross-reference symbols, by line, in place of content ids; empty ones do not count."""
    key = F.col("p_partkey")
    symbol = F.when(key % 2 == 0, F.concat(F.lit("sym Box"), key.cast("string"), F.lit("#"))).otherwise("")
    file = F.concat(F.lit("pkg"), F.col("p_size").cast("string"), F.lit("/mod_"), key.cast("string"), F.lit(".py"))
    symbols = table(spark, sf_dir, "part").select(file.alias("source_file"), F.lit(11).alias("lineno"), symbol.alias("scip_symbol"))
    graph = _extracted(spark, sf_dir, symbols)
    nodes = graph.nodes.where("memory_layer = 'semantic'")
    constructs = graph.edges.where("edge_type = 'tagged_with' AND target_id LIKE 'tag:lang_construct:%'").select(
        F.col("source_id").alias("id"),
        F.replace("target_id", F.lit("tag:lang_construct:"), F.lit("")).alias("kind"),
    )
    return nodes.select("id", F.col("symbol_name").alias("qualified_name")).join(constructs, "id").select("id", "kind", "qualified_name")


_BYTES = "list_transform(range(0, 32), lambda i: CAST(CAST('0x' || substr(sha256(text), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT) AS DOUBLE) - 128.0)"


@sources(
    f"""SELECT id, '{scalar.HASH_MODEL}' AS embedding_model, 32 AS dim, round(v[1] / sqrt(list_inner_product(v, v)), 9) AS v0, round(v[32] / sqrt(list_inner_product(v, v)), 9) AS v31
  FROM (SELECT id, {_BYTES} AS v FROM cues)"""
)
def attach_embeddings(spark, sf_dir):
    """Vectors of all cues, each distinct text embedded once."""
    nodes = extract.attach_embeddings(_extracted(spark, sf_dir).nodes, scalar.hash_embedding, scalar.HASH_MODEL).where("embedding IS NOT NULL")
    return nodes.select(
        "id",
        "embedding_model",
        F.size("embedding").alias("dim"),
        F.round(F.col("embedding")[0], 9).alias("v0"),
        F.round(F.col("embedding")[31], 9).alias("v31"),
    )


# ------------------------------------------------------------------ store


def _store(spark, *more) -> Store:
    out = Store(spark, f"{lineage.shared_folder(spark)}/store-{uuid.uuid4().hex}", *more)
    out.initialize()
    return out


def _finish(store: Store, rows: list[tuple], schema: str) -> DataFrame:
    """A few collected figures; the store's folder goes."""
    store.folder.delete()
    return store.spark.createDataFrame(rows, schema)


def _written(changes) -> list:
    return [tuple(r) for r in changes.collect()]


@sources("""SELECT 1 AS run, (SELECT count(*) FROM good) AS indexed, 0 AS skipped, (SELECT count(*) FROM files WHERE bad) AS failed,
  (SELECT count(*) FROM contents) + (SELECT count(*) FROM cues) + (SELECT count(*) FROM (SELECT DISTINCT category, value
    FROM tags)) AS nodes, (SELECT count(*) FROM tags) + (SELECT count(*) FROM definitions) + (SELECT count(*) FROM cues) AS edges,
  (SELECT count(*) FROM good) AS files
UNION ALL SELECT 2, (SELECT count(*) FROM good WHERE k % 3 = 0), (SELECT count(*) FROM good WHERE k % 3 <> 0), (SELECT count(*) FROM files
  WHERE bad),
  (SELECT count(*) FROM contents) + (SELECT count(*) FROM cues) + (SELECT count(*) FROM (SELECT DISTINCT category, value
    FROM tags)), (SELECT count(*) FROM tags) + (SELECT count(*) FROM definitions) + (SELECT count(*) FROM cues), (SELECT count(*) FROM good)""")
def index_run(spark, sf_dir):
    """Index all files into a store, change each third and index again: what each run did, and what the store then holds."""
    store, rows = _store(spark, scalar.HASH_MODEL, scalar.HASH_DIM), []
    files = source_files(spark, sf_dir)
    third = F.regexp_extract("source_file", r"mod_(\d+)\.py", 1).cast("long") % 3 == 0
    changed = files.withColumn("content", F.when(third, F.concat("content", F.lit(b"# changed\n"))).otherwise(F.col("content")))
    for run, scan in ((1, files), (2, changed)):
        stats = index_files(store, scan, scalar.hash_embedding, scalar.HASH_MODEL, at=AT)
        nodes, edges = g.counts(store.graph).head()
        rows.append((run, stats.indexed_files, stats.skipped_files, len(stats.failed_files), nodes, edges, store.indexed_files.count()))
    return _finish(store, rows, "run int, indexed long, skipped long, failed long, nodes long, edges long, files long")


@query(", kept_nodes AS (SELECT * FROM nodes), kept_edges AS (SELECT * FROM edges) " + _KINDS)
def store_round_trip(spark, sf_dir):
    """The graph written to a store by upserts in one transaction, and read back by another one."""
    graph, store = projection.graph(spark, sf_dir), _store(spark, "driver-d64", 64)
    version = lambda *by: F.xxhash64(*by)
    with store.transaction():
        store.upsert_nodes(graph.nodes.withColumn("version", version("id")))
        store.upsert_edges(graph.edges.withColumn("version", version("source_id", "target_id", "edge_type")))
    again = Store(spark, store.folder.uri)
    again.initialize()
    return _finish(store, _written(_kinds(again.graph)), KINDS)


@query(""", gone AS (SELECT 'content:doc:' || doc_id AS id FROM documents WHERE lang = 'fr'), kept_nodes AS (SELECT * FROM nodes
  WHERE id NOT IN (SELECT id FROM gone)),
kept_edges AS (SELECT * FROM edges WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)) """ + _KINDS)
def store_transactions(spark, sf_dir):
    """A commit that deletes, an uncommitted delete that is rolled back, and one that an exception undoes."""
    graph, store = projection.graph(spark, sf_dir), _store(spark, "driver-d64", 64)
    doc = lambda lang: table(spark, sf_dir, "documents").where(F.col("lang") == lang).select(
        F.concat(F.lit("content:doc:"), F.col("doc_id").cast("string")).alias("id")
    )
    with store.transaction():
        store.upsert_nodes(graph.nodes.withColumn("version", F.xxhash64("id")))
        store.upsert_edges(graph.edges.withColumn("version", F.xxhash64("source_id", "target_id", "edge_type")), check=False)
    with store.transaction():
        store.delete_nodes(doc("fr"))
    store.begin()
    store.delete_nodes(doc("de"))
    store.rollback()
    try:
        with store.transaction():
            store.compact()
            raise KeyError("undo")
    except KeyError:
        pass
    again = Store(spark, store.folder.uri)
    again.initialize()
    return _finish(store, _written(_kinds(again.graph)), KINDS)


@plain("""WITH writes AS (SELECT 'src/' || user_id || '.py' AS file_path, event_type || event_id AS git_sha, row_number() OVER (ORDER BY event_id % 2, ts, event_id) AS nth
  FROM events)
SELECT file_path, git_sha, row_number() OVER (ORDER BY first) AS place
  FROM (SELECT file_path, arg_max(git_sha, nth) AS git_sha, min(nth) AS first FROM writes GROUP BY file_path)""")
def manifest_list(spark, sf_dir):
    """Files recorded in two calls, even events and then odd ones: the last write stays, in the order of first insertion."""
    store = _store(spark)
    events = table(spark, sf_dir, "events")
    for rest in (0, 1):
        mine = events.where(F.col("event_id") % 2 == rest)
        rows = mine.select(
            F.concat(F.lit("src/"), F.col("user_id").cast("string"), F.lit(".py")).alias("file_path"),
            F.concat("event_type", F.col("event_id").cast("string")).alias("git_sha"),
            F.col("ts").cast("timestamp_ntz").alias("indexed_at"),
            (F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.pmod("event_id", F.lit(1000))).alias("version"),
        )
        with store.transaction():
            store.record_files(rows)
    listed = [(r.file_path, r.git_sha, i + 1) for i, r in enumerate(store.list_files().collect())]  # a row a file, for a person to read
    return _finish(store, listed, "file_path string, git_sha string, place long")


@query(""", delta AS (SELECT 'cue:vec:' || event_id AS source_id, 'content:doc:' || (user_id * 10) AS target_id FROM events)
SELECT source_id, target_id, 'source' AS missing FROM delta WHERE source_id NOT IN (SELECT id FROM nodes)
  UNION ALL SELECT source_id, target_id, 'target' FROM delta WHERE target_id NOT IN (SELECT id FROM nodes)""")
def missing_endpoints(spark, sf_dir):
    """Edges of a delta that lack a source or a target among the nodes."""
    graph = projection.graph(spark, sf_dir)
    delta = table(spark, sf_dir, "events").select(
        F.concat(F.lit("cue:vec:"), F.col("event_id").cast("string")).alias("source_id"),
        F.concat(F.lit("content:doc:"), (F.col("user_id") * 10).cast("string")).alias("target_id"),
    )
    return mutate.missing_endpoints(graph, delta).select("source_id", "target_id", "missing")


@plain("""SELECT event_id, CASE
  WHEN event_id % 5 = 1 THEN 'invalid node: n' || event_id
  WHEN event_id % 5 = 2 THEN 'invalid node: n' || event_id
  WHEN event_id % 5 = 3 THEN 'embedding does not fit the store: n' || event_id
  WHEN event_id % 35 = 4 THEN 'embedding does not fit the store: n' || event_id END AS fault FROM events""")
def node_guards(spark, sf_dir):
    """What the write boundary finds wrong: an unknown status or kind, a vector of another model or dimension."""
    from ..schema import as_nodes, node_fault

    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("n"), n.cast("string")).alias("id"), F.lit("cue").alias("node_type"), F.when(n % 5 == 1, "lost").otherwise("active").alias("status"), F.when(n % 5 == 2, "poem").alias("kind"),
        F.when(n % 5 == 3, F.array(F.lit(1.0))).when(n % 5 == 4, F.array(F.lit(0.0), F.lit(1.0))).alias("embedding"), F.when(n % 35 == 4, "other").otherwise("m").alias("embedding_model"),
    )
    nodes = as_nodes(rows).withColumn("event_id", F.substring("id", 2, 20).cast("long"))
    return nodes.select("event_id", node_fault("m", 2).alias("fault"))


@plain("""SELECT 'src/' || event_id || '.py' AS file_path, substr(sha1(event_type), 1, 7) AS sha, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM events""")
def status_rows(spark, sf_dir):
    """The status report's rows: short hashes and times to the second."""
    from ..service import status_rows as report

    files = table(spark, sf_dir, "events").select(
        F.concat(F.lit("src/"), F.col("event_id").cast("string"), F.lit(".py")).alias("file_path"),
        F.sha1(F.col("event_type").cast("binary")).alias("git_sha"),
        F.col("ts").cast("timestamp_ntz").alias("indexed_at"),
    )
    return report(files)
