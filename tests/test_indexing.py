from __future__ import annotations

import subprocess

import pytest
from pyspark.sql import functions as F

from helpers import NOW

from cuelattice import cli, factories
from cuelattice.functions import scalar
from cuelattice.functions.parsing import parse_module
from cuelattice.index import index_files, index_repository
from cuelattice.operators import extract, scip
from cuelattice.plans.lineage import cut
from cuelattice.schema import as_nodes
from cuelattice.service import Service, open_references
from cuelattice.sources import files
from cuelattice.sources import scip as scip_source
from cuelattice.sources.store import Store
from cuelattice.streaming import incremental

SOURCE = '''"""Module doc."""
import os

@deco(1)
async def fetch(a: int = 1,
          *args) -> list[int]:
    """Doc
       line."""
    def inner():
        raise KeyError("inner")
    raise ValueError("bad", "worse")
    raise ValueError("bad")
    raise ValueError(f"no {a}", b"no", "two" "parts")


class Plain:
    x = 1
    def method(self): pass

    @property
    def prop(self):
        "p"
    class Nested:
        def hidden(self): pass


class TestThing(Base, metaclass=M): "doc"

def test_it(): ...
if True:
    def no(): pass
'''


def test_parser():
    module = parse_module(SOURCE)
    by = {d.qualified_name: d for d in module.definitions}
    assert module.docstring == "Module doc." and list(by) == ["fetch", "Plain", "Plain.method", "Plain.prop", "TestThing", "test_it"]
    f = by["fetch"]
    assert f.kind == "async_function" and f.signature == "async def fetch(a: int = 1,\n          *args) -> list[int]" and f.docstring == "Doc\nline."
    assert f.lineno == 5 and f.decorators == ["deco(1)"] and f.error_messages == ["bad", "worse", "inner"] and f.source.startswith("async def fetch")
    assert by["Plain"].signature == "class Plain" and by["TestThing"].signature == "class TestThing(Base, metaclass=M)" and by["TestThing"].docstring == "doc"
    assert by["Plain.prop"].decorators == ["property"] and by["Plain.method"].kind == "method" and by["test_it"].is_test and by["TestThing"].is_test


def test_parser_recovers():
    module = parse_module('"""d"""\ndef good():\n    pass\n\ndef bad(:\n    pass\n\nclass Also:\n    def m(self): pass\n')
    assert [d.qualified_name for d in module.definitions] == ["good", "Also", "Also.m"]
    assert module.definitions[1].lineno == 8 and module.docstring == "d"
    assert parse_module("").definitions == [] and parse_module("\0").definitions == []


def test_scalars(spark, tmp_path):
    data = "héllo\n".encode()
    row = spark.createDataFrame([(bytearray(data), "a/b/__init__.py", "__init__.py", "a/x.py", "t" * 501)], "d binary, p string, q string, r string, t string")
    got = row.select(scalar.git_blob_sha("d"), scalar.module_path("p"), scalar.module_path("q"), scalar.module_path("r"), scalar.truncated("t"), scalar.hash_embedding("p")).head()
    (tmp_path / "f").write_bytes(data)
    try:
        assert got[0] == subprocess.run(["git", "hash-object", tmp_path / "f"], capture_output=True, text=True, check=True).stdout.strip()
    except FileNotFoundError:
        pass
    assert (got[1], got[2], got[3], got[4]) == ("a.b", "", "a.x", "t" * 500 + "…")
    assert got[5] == pytest.approx(factories.hash_vectors(["a/b/__init__.py"])[0])


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    for name, text in {"pkg/__init__.py": "", "pkg/mod.py": SOURCE, "venv/no.py": "x", ".hid/no.py": "x", "pkg/.dot.py": "y = 1", "a.txt": "no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "pkg/latin.py").write_bytes(b"x = '\xe9'")
    return root


def test_index_repository(spark, repo, tmp_path):
    assert files.discover(repo) == ["pkg/.dot.py", "pkg/__init__.py", "pkg/latin.py", "pkg/mod.py"]
    store = Store(spark, tmp_path / "store", scalar.HASH_MODEL, scalar.HASH_DIM)
    store.initialize()
    stats = index_repository(store, repo, scalar.hash_embedding, scalar.HASH_MODEL, scalar.HASH_DIM)
    assert (stats.indexed_files, stats.skipped_files, stats.failed_files) == (3, 0, ["pkg/latin.py"])
    nodes = {r.id: r for r in store.graph.nodes.collect()}
    assert nodes["content:pkg/mod.py::<module>"].memory_layer == "topic" and nodes["content:pkg/mod.py::test_it"].kind == "test"
    assert nodes["cue:symbol:pkg/mod.py::Plain.method"].text == "method" and len(nodes["cue:symbol:pkg/mod.py::Plain.method"].embedding) == 32
    assert nodes["tag:lang_construct:async_function"].source_file is None and nodes["content:pkg/mod.py::fetch"].embedding is None
    errors = [r.text for r in nodes.values() if r.cue_type == "error_message"]
    assert sorted(errors) == ["bad", "inner", "worse"]
    edges = {(r.source_id, r.target_id, r.edge_type) for r in store.graph.edges.collect()}
    assert ("content:pkg/mod.py::fetch", "content:pkg/mod.py::<module>", "part_of_topic") in edges and len(edges) == stats.edges_written
    again = index_repository(store, repo, scalar.hash_embedding, scalar.HASH_MODEL, scalar.HASH_DIM)
    assert (again.indexed_files, again.skipped_files) == (0, 3)
    (repo / "pkg/mod.py").write_text("def only(): pass")
    third = index_repository(store, repo, scalar.hash_embedding, scalar.HASH_MODEL, scalar.HASH_DIM)
    assert third.indexed_files == 1
    left = {r.id for r in store.graph.nodes.where("source_file = 'pkg/mod.py'").collect()}
    assert left == {"content:pkg/mod.py::<module>", "content:pkg/mod.py::only", "cue:symbol:pkg/mod.py::only"}
    service = Service(store.graph, factories.hash_vectors)
    assert service.search("only", 1).head().id == "cue:symbol:pkg/mod.py::only"
    (repo / "pkg/mod.py").unlink()
    index_files(store, files.scan(spark, repo), scalar.hash_embedding, scalar.HASH_MODEL, prune=True)
    assert store.graph.nodes.where("source_file = 'pkg/mod.py'").count() == 0 and store.file_sha("pkg/mod.py") is None


def test_cli(spark, repo):
    said = []
    for argv in (["index", str(repo)], ["status", "--repo", str(repo)], ["search", "fetch", "-k", "1", "--repo", str(repo)], ["reconstruct", "fetch", "--repo", str(repo)], ["doctor", "--repo", str(repo)]):
        cli.main(argv, spark, out=said.append, env={"CUELATTICE_EMBED_MODEL": scalar.HASH_MODEL, "CUELATTICE_LLM_MODEL": "rule"})
    assert "3 indexed" in said[0] and "files: 3" in said[1] and "cue:symbol:pkg/mod.py::fetch" in said[2] and "content:pkg/mod.py::fetch" in said[3] and "run manifest" in said[4]


def test_stream(spark, tmp_path):
    store = Store(spark, tmp_path / "store", scalar.HASH_MODEL, scalar.HASH_DIM)
    store.initialize()
    folder = str(tmp_path / "in")
    rows = lambda *r: spark.createDataFrame([(f, bytearray(c.encode()), v) for f, c, v in r], incremental.SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    for batch in ([("a.py", "def old(): pass", 1), ("a.py", "def new(): pass", 2)], [("b.py", "def b(): pass", 3), ("a.py", "def newer(): pass", 4)]):
        rows(*batch)
        incremental.start(incremental.file_versions(spark, folder), store, scalar.hash_embedding, scalar.HASH_MODEL, str(tmp_path / "cp")).awaitTermination()
    found = {r.symbol_name for r in store.graph.nodes.where("kind = 'function'").collect()}
    assert found == {"newer", "b"}


def test_broken_members():
    """A method, a function or a header that does not parse hides neither its siblings nor its class."""
    source = """class A(Base):
    \"\"\"Doc.\"\"\"
    def one(self): return 1

    @prop
    def two(self, a=3) -> str:
        raise ValueError("bad")
        return (a

    def three(self:
        pass

    async def test_four(self):
        raise KeyError("four")


def a(x): return (x


def old():
    print "hello"
    raise OSError("old")


def after():
    s = \"\"\"
def not_me():
\"\"\"
"""
    found = {d.qualified_name: d for d in parse_module(source).definitions}
    assert list(found) == ["A", "A.one", "A.two", "A.test_four", "a", "old", "after"]
    assert [d.lineno for d in found.values()] == [1, 3, 6, 13, 17, 20, 25]
    two = found["A.two"]
    assert (two.signature, two.decorators, two.error_messages, two.kind) == ("def two(self, a=3) -> str", ["prop"], ["bad"], "method")
    assert two.source.endswith("return (a") and found["A"].docstring == "Doc." and found["A"].signature == "class A(Base)"
    assert found["a"].signature == "def a(x)" and found["old"].error_messages == ["old"] and found["A.test_four"].is_test
    assert [d.qualified_name for d in parse_module('class B:\n    def f(self):\n        """open\n    def g(self): pass\n').definitions] == ["B", "B.f", "B.g"]
    assert parse_module("def f(").definitions == []


def test_no_text_is_embedded_twice(spark, tmp_path):
    """A second run asks for the texts that are new alone; another model asks for all."""
    asked = tmp_path / "asked"
    asked.mkdir()
    log = str(asked)

    def embed(texts):
        import uuid

        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        return [[float(len(t)), 1.0] for t in texts]

    def run(model, **files):
        scan = spark.createDataFrame([(f"{n}.py", bytearray(c.encode())) for n, c in files.items()], "source_file string, content binary")
        index_files(store, scan, extract.embedder_udf(embed), model)
        seen = sorted(x for p in asked.iterdir() for x in p.read_text().split("\n"))
        for p in asked.iterdir():
            p.unlink()
        return seen

    store = Store(spark, tmp_path / "store", None, 2)
    store.initialize()
    assert run("m", a="def one(): pass\ndef two(): pass") == ["one", "two"]
    assert run("m", a="def two(): pass\ndef three(): pass", b="def one(): pass") == ["three"]
    assert store.graph.nodes.where("text = 'one'").head().embedding == [3.0, 1.0]
    assert run("m", a="def two(): pass\ndef three(): return 1") == []
    assert extract.known_vectors(store.graph.nodes, "other").isEmpty()


def test_stream_out_of_order(spark, tmp_path):
    """Older versions that come in a later batch, replays and deletions: the newest version is what the store has."""
    store = Store(spark, tmp_path / "store", scalar.HASH_MODEL, scalar.HASH_DIM)
    store.initialize()
    folder = str(tmp_path / "in")

    def batch(*rows):
        data = [(f, None if c is None else bytearray(c.encode()), v) for f, c, v in rows]
        spark.createDataFrame(data, incremental.SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        incremental.start(incremental.file_versions(spark, folder), store, scalar.hash_embedding, scalar.HASH_MODEL, str(tmp_path / "cp")).awaitTermination()
        return {r.symbol_name for r in store.graph.nodes.where("kind = 'function'").collect()}

    assert batch(("a.py", "def new(): pass", 5), ("b.py", "def b(): pass", 1), (None, "def x(): pass", 9), ("c.py", "def c(): pass", None)) == {"new", "b"}
    version = store.folder.read("CURRENT")
    assert batch(("a.py", "def old(): pass", 2), ("b.py", "def b(): pass", 1), ("b.py", "def b(): pass", 3)) == {"new", "b"}
    assert store.folder.read("CURRENT") == version  # older, repeated and unchanged versions write nothing
    assert batch(("a.py", None, 6), ("b.py", None, 2)) == {"b"}
    assert [r.file_path for r in store.list_files().collect()] == ["b.py"]
    assert batch(("a.py", "def late(): pass", 4), ("d.py", None, 1)) == {"b"}
    assert batch(("a.py", "def again(): pass", 7)) == {"b", "again"}


# ------------------------------------------------------------------ cross-references


def varint(n):
    out = b""
    n &= (1 << 64) - 1
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            value = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def packed(*numbers):
    return b"".join(map(varint, numbers))


@pytest.fixture
def index_file(tmp_path):
    occurrence = lambda symbol, roles, *more: (2, message((2, symbol), (3, roles), *more))
    a = message((1, "a.py"), occurrence("foo", 1, (8, message((1, 4), (2, 0), (3, 3)))), occurrence("bar", 0, (1, packed(3, 1, 9))), occurrence("p", 1, (1, packed(4, 8, 9))),
                (3, message((1, "bar"))), (3, message((1, "foo"), (4, message((1, "base"), (3, 1))), (4, message((1, "T"), (4, 1))))))
    b = message((1, "b.py"), occurrence("foo", 0, (9, message((1, 7), (2, 0), (3, 8), (4, 2)))), occurrence("foo", 8, (1, packed(12, 1, 13, 9))), occurrence("foo", 0))
    external = message((1, "bar"), (4, message((1, "ext"), (3, 1))))
    path = tmp_path / "index.scip"
    path.write_bytes(message((2, a), (2, b), (3, external)))
    return path


def test_scip(spark, index_file, make_graph):
    occurrences, relations = scip_source.read(spark, index_file)
    rows = scip.decoded(occurrences).orderBy("doc_idx", "occ_idx").collect()
    assert [(r.start_line, r.start_character, r.end_line, r.end_character) for r in rows] == [(4, 0, 4, 3), (3, 1, 3, 9), (4, 8, 4, 9), (7, 0, 8, 2), (12, 1, 13, 9), (0, 0, 0, 0)]
    assert [r.symbol for r in scip.definitions(occurrences, "a.py").collect()] == ["foo", "p"]
    assert {r.relative_path for r in scip.files(occurrences).collect()} == {"a.py", "b.py"}
    assert scip.occurrences_of(occurrences, "none.py").count() == 0
    assert [(r.lineno, r.scip_symbol) for r in scip.line_symbols(occurrences).collect()] == [(5, "p")]
    assert {r.target for r in scip.symbol_info(relations, "foo", "a.py").collect()} == {"base", "T"}
    assert scip.symbol_info(relations, "bar", "a.py").count() == 0  # known in the file, without relationships
    assert [r.target for r in scip.symbol_info(relations, "bar", "b.py").collect()] == ["ext"] == [r.target for r in scip.symbol_info(relations, "bar").collect()]
    graph = make_graph([("foo", "content", {}), ("bar", "content", {})], [])
    service = Service(graph, references_data=open_references(spark, index_file))
    assert [(r.relative_path, r.start_line) for r in service.references("foo").collect()] == [("b.py", 7), ("b.py", 12), ("b.py", 0)]
    assert [r.target for r in service.implementations("foo").collect()] == ["base"] and [r.target for r in service.type_definition("foo").collect()] == ["T"]
    assert service.implementations("bar").count() == 0
    with pytest.raises(ValueError):
        service.references("unknown")
    index_file.write_bytes(b"\xff\xff\xff")
    assert open_references(spark, index_file) is None and open_references(spark, index_file.parent / "none") is None


def test_scip_ids_in_extraction(spark):
    from cuelattice.operators import extract

    data = spark.createDataFrame([("a.py", bytearray(b"\n\ndef f(): pass\ndef g(): pass"))], "source_file string, content binary")
    symbols = spark.createDataFrame([("a.py", 3, "sym f"), ("a.py", 4, "")], "source_file string, lineno int, scip_symbol string")
    ids = {r.id for r in extract.extract(extract.parse_files(data), "2026-01-01", symbols).nodes.where(F.col("memory_layer") == "semantic").collect()}
    assert ids == {"sym f", "content:a.py::g"}


def test_scip_generation_is_optional(tmp_path):
    if not scip_source.tool_available():
        with pytest.raises(scip_source.GenerationError):
            scip_source.generate(tmp_path, tmp_path / "x")


def _parts(rows):
    return rows.select(F.spark_partition_id().alias("p")).distinct().count()


def test_files_of_one_block_are_parsed_on_all_cores(spark):
    files_ = spark.range(400).select(F.concat("id", F.lit(".py")).alias("source_file"), F.lit(b"def f(): pass\n").alias("content")).coalesce(1)
    parsed = extract.parse_files(files_)
    assert _parts(parsed) > 1 and parsed.count() == 400


def test_extracted_files_are_parsed_once(spark):
    files_ = spark.createDataFrame([("a.py", bytearray(b"def f(): pass\n")), ("b.py", bytearray(b"\xff"))], "source_file string, content binary")
    graph = extract.extract_files(files_, NOW)
    for rows in (graph.nodes, graph.edges):  # both read what was written
        assert "MapInPandas" not in rows._jdf.queryExecution().toString()
    assert sorted(r.id for r in graph.nodes.where("node_type <> 'tag'").collect()) == ["content:a.py::<module>", "content:a.py::f", "cue:symbol:a.py::f"]


_ONCE, _TWICE = b"def f(): raise KeyError('no')\n", b"class A:\n    def x(self): pass\n    def x(self): raise OSError('no')\ndef g(): raise OSError('no')\n"


def test_only_files_with_repeats_are_looked_through(spark):
    """A name or a message twice: the same rows as when all files are looked through; without them, rows are not grouped by id."""
    files_ = spark.createDataFrame([("a.py", bytearray(_ONCE)), ("b.py", bytearray(_TWICE)), ("c.py", bytearray(b"\xff"))], "source_file string, content binary")
    parsed = cut(extract.parse_files(files_).withColumn("repeats", extract.repeats()))
    assert {r.source_file: r.repeats for r in parsed.select("source_file", "repeats").collect()} == {"a.py": False, "b.py": True, "c.py": False}
    some, every = extract.extract(parsed, NOW, repeated=None), extract.extract(parsed, NOW)
    for a, b in ((some.nodes, every.nodes), (some.edges, every.edges)):
        rows = sorted(map(str, a.collect()))
        assert rows == sorted(map(str, b.collect())) and len(rows) > 8
    none = extract.extract(parsed.where("source_file = 'a.py'"), NOW, repeated=False)
    assert all("Window" not in rows._jdf.queryExecution().optimizedPlan().toString() for rows in (none.nodes, none.edges))


def test_a_file_that_a_scan_has_twice(spark, tmp_path):
    store = Store(spark, tmp_path, scalar.HASH_MODEL, scalar.HASH_DIM)
    store.initialize()
    files_ = spark.createDataFrame([("a.py", bytearray(_ONCE))] * 2, "source_file string, content binary")
    index_files(store, files_, scalar.hash_embedding, scalar.HASH_MODEL, at=NOW)
    ids = [r.id for r in store.graph.nodes.where("node_type <> 'tag'").collect()]
    assert len(ids) == len(set(ids)) == 4 and store.indexed_files.count() == 1


def test_the_first_publish_groups_and_joins_nothing(spark, tmp_path, monkeypatch):
    """Every row was grouped twice by its key, and joined with the empty tables of a new store."""
    plans, publish = [], Store._publish

    def seen(store):
        plans.extend(rows._jdf.queryExecution().optimizedPlan().toString() for rows in (store.graph.nodes, store.graph.edges))
        publish(store)

    monkeypatch.setattr(Store, "_publish", seen)
    store = Store(spark, tmp_path, scalar.HASH_MODEL, scalar.HASH_DIM)
    store.initialize()
    files_ = spark.createDataFrame([("a.py", bytearray(_ONCE)), ("b.py", bytearray(_TWICE))], "source_file string, content binary")
    index_files(store, files_, scalar.hash_embedding, scalar.HASH_MODEL, at=NOW)
    assert len(plans) == 2 and not any(x in p for p in plans for x in ("max_by", "LeftAnti", "LeftOuter", "LeftSemi"))


def test_hash_embedding_hashes_once_a_text(spark):
    plan = spark.range(3).select(scalar.hash_embedding(F.col("id").cast("string")).alias("v"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("sha2(") == 1  # it stood in the lambdas of the norm too, and was computed for each of 32 elements there
    zero = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>").select(scalar.l2_normalise("v").alias("u"))
    assert [r.u for r in zero.collect()] == [[0.0, 0.0], [0.6, 0.8]]


def test_rows_without_vectors_do_not_meet_in_one_task(spark):
    rows = spark.range(200).select(F.concat(F.lit("content:"), "id").alias("id"), F.lit("content").alias("node_type"), F.lit(None).cast("string").alias("text"))
    cue = spark.createDataFrame([("cue:1", "cue", "hello"), ("cue:2", "cue", None)], "id string, node_type string, text string")
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in zip(names, ("false", "-1"), strict=True):
            spark.conf.set(n, v)
        out = extract.attach_embeddings(as_nodes(rows.unionByName(cue)), scalar.hash_embedding, scalar.HASH_MODEL)
        assert _parts(out.where("node_type = 'content'")) > 1
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    found = {r.id: r.embedding for r in out.where("embedding IS NOT NULL OR node_type = 'cue'").collect()}
    assert len(found["cue:1"]) == 32 and found["cue:2"] is None and len(found) == 2 and out.count() == 202


def test_raised_messages_of_all_blocks():
    text = """def f(x):
    try:
        with x:
            raise A("with")
    except E:
        raise B("except")
    else:
        raise C("else")
    finally:
        for i in x:
            raise D("for")
    match x:
        case 1:
            raise G("case") from H("cause")
    def g():
        raise I("inner")
    raise J("first")
"""
    # level by level, as a walk over all nodes finds them
    assert parse_module(text).definitions[0].error_messages == ["first", "else", "inner", "with", "except", "for", "case", "cause"]
