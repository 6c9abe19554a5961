"""A Merkle manifest of a dataset: a tree of fanout 3 for each source, and one over the sources.

Leaves are digests of whole rows.  Each source's leaves are range-sorted, so a
task holds contiguous runs of them, whose places are known once the counts of
the runs are summed.  :class:`Mountain` is the stack of such a run: a digest is
put on its level, and when it ends an aligned group of three, or the short group
at the end of the source, the group's digest is carried one level up.  Groups
that began in another run stay open; their nodes, the unaligned edges, are all
that leaves the task.  They are merged for each aligned block of ``3 ** LEVELS``
leaves, and the blocks' digests are the leaves of the next tree of the same
kind, until a source is one block.  No group is padded.

What a task or group holds does not grow with the input: a run is cut at
``CHUNK`` leaves and at the borders of blocks, and a block gets at most a few
dozen edge nodes a run.  The driver learns the largest number of leaves only.

Defined cases: an empty table has no rows; a null is hashed as ``-`` and orders
first; rows with equal order keys follow by their digests, so equal rows are
interchangeable; a source of one row is its own subroot; rows without a source
form a source of their own, before all others; columns that are not named to
:func:`manifest` are neither hashed nor returned.  ``columns`` must be strings
or integers; text must be UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, documents, materialise, remainder

FANOUT = 3
#: Levels of one merged block: 531,441 leaves.
LEVELS = 12
#: Leaves of one run at most.
CHUNK = 8192
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex sha256 of values: ``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def node_digest(digests: list[bytes]) -> bytes:
    """The digest of a group: of its members' hex texts, one after the other."""
    return sha256(b"".join(d.hex().encode() for d in digests)).digest()


def sizes(total: int, levels: int) -> list[int]:
    """How many nodes each level has, up to the one node, or up to ``levels`` levels above the leaves."""
    out = [total]
    while out[-1] > 1 and len(out) <= levels:
        out.append(-(-out[-1] // FANOUT))
    return out


class Mountain:
    """The stack of a run of leaves that begins at ``lo``: ``done`` has whole groups' digests a level, ``edges`` what stays open."""

    def __init__(self, lo: int, counts: list[int]):
        self.counts, self.top = counts, len(counts) - 1
        self.first = [lo]  # the index of the first node a level
        self.nodes: list[list[bytes]] = [[]]
        self.edges: list[tuple[int, int, bytes]] = []

    def push(self, digest: bytes, level: int = 0) -> None:
        while True:
            nodes = self.nodes[level]
            at = self.first[level] + len(nodes)
            nodes.append(digest)
            if level == self.top:
                self.edges.append((level, at, digest))  # a peak: a block or a whole source
                return
            place = at % FANOUT
            if place != FANOUT - 1 and at != self.counts[level] - 1:
                return  # the group goes on
            group = nodes[-1 - place :]
            if len(group) <= place:  # the group began in another run
                self.edges += [(level, at - len(group) + 1 + i, d) for i, d in enumerate(group)]
                return
            if level + 1 == len(self.nodes):
                self.nodes.append([])
                self.first.append(at // FANOUT)
            level, digest = level + 1, node_digest(group)

    def close(self) -> list[tuple[int, int, bytes]]:
        """All edges: those seen, and the groups that another run goes on with."""
        for level, nodes in enumerate(self.nodes[: self.top]):
            end = self.first[level] + len(nodes)
            if end < self.counts[level]:
                n = min(end % FANOUT, len(nodes))
                self.edges += [(level, end - n + i, d) for i, d in enumerate(nodes[len(nodes) - n :])]
        return self.edges


def merge(edges: list[tuple[int, int, bytes]], counts: list[int]) -> dict[tuple[int, int], bytes]:
    """All nodes of a block that stand on an unaligned edge, by level and index, with the digests that close them."""
    found = {(level, at): d for level, at, d in edges}
    for level in range(len(counts) - 1):
        for group in {at // FANOUT for lv, at in found if lv == level}:
            if (level + 1, group) not in found:
                found[level + 1, group] = node_digest([found[level, at] for at in members(group, counts[level])])
    return found


def members(group: int, count: int) -> range:
    return range(group * FANOUT, min((group + 1) * FANOUT, count))


def beside(lo: int, hi: int, counts: list[int]) -> Iterator[tuple[int, int]]:
    """Nodes that the proofs of leaves lo to hi need and the run does not have, by level and index."""
    span = 1
    for level, count in enumerate(counts[:-1]):
        for group in {lo // span // FANOUT, (hi - 1) // span // FANOUT}:
            for at in members(group, count):
                if at * span < lo or min((at + 1) * span, counts[0]) > hi:
                    yield level, at
        span *= FANOUT


def _pack_nodes(nodes: list[tuple[int, int, bytes]]) -> bytes:
    return b"".join(level.to_bytes(1, "little") + at.to_bytes(8, "little") + d for level, at, d in nodes)


def _unpack_nodes(data: bytes) -> list[tuple[int, int, bytes]]:
    return [(data[i], int.from_bytes(data[i + 1 : i + 9], "little"), data[i + 9 : i + 41]) for i in range(0, len(data), 41)]


# ------------------------------------------------------------------ runs of leaves


def _cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted leaves as one row for each run: its tree, task, leaves of the tree before it in the task, digests and carried rows."""
    part, tree, before = TaskContext.get().partitionId(), None, 0
    for b in batches:
        trees, leaves, rows = column(b, "tree"), column(b, "leaf"), b.column(b.schema.get_field_index("carried"))
        at = 0
        while at < len(trees):
            end = at + 1
            while end < len(trees) and trees[end] == trees[at] and end - at < CHUNK:
                end += 1
            if trees[at] != tree:
                tree, before = trees[at], 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([tree.decode()]),
                    pa.array([part], pa.int32()),
                    pa.array([before], pa.int64()),
                    pa.array([end - at], pa.int32()),
                    pa.array([b"".join(leaves[at:end])]),
                    pa.ListArray.from_arrays(pa.array([0, end - at], pa.int32()), rows.slice(at, end - at)),
                ],
                names=["tree", "part", "before", "n", "leaves", "carried"],
            )
            before, at = before + end - at, end


def runs_of(df: DataFrame) -> DataFrame:
    """tree, lo, n, total, leaves, carried: the range-sorted leaves (tree, ord, leaf, carried) with their places in their trees."""
    kept, _ = materialise(df, "merkle-leaves")  # else sorting by range would hash the texts twice
    # equal rows are told apart by where they were read, so that a hot row can be split
    dealt = kept.withColumn("tie", F.monotonically_increasing_id())
    order = ["tree", "ord", "leaf", "tie"]
    schema = T.StructType([T.StructField("tree", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("leaves", T.BinaryType()), T.StructField("carried", T.ArrayType(df.schema["carried"].dataType))])
    found, _ = materialise(dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("tree", "leaf", "carried").mapInArrow(_cut_runs, schema), "merkle-runs")
    # one row for each tree and task
    counts = found.groupBy("tree", "part").agg(F.sum("n").alias("n"))
    starts, _ = materialise(
        counts.selectExpr("tree", "part", "sum(n) OVER (PARTITION BY tree ORDER BY part) - n AS start", "sum(n) OVER (PARTITION BY tree) AS total"), "merkle-starts"
    )
    return found.join(starts, ["tree", "part"]).select("tree", (F.col("start") + F.col("before")).alias("lo"), "n", "total", "leaves", "carried")


def pieces_of(found: DataFrame, levels: int) -> DataFrame:
    """The runs cut at the borders of blocks: tree, block, lo, n, total, leaves, carried."""
    size = F.lit(FANOUT**levels).cast("long")
    hi = F.col("lo") + F.col("n")
    cut = found.withColumn("block", F.explode(F.sequence((F.col("lo") / size).cast("long"), ((hi - 1) / size).cast("long"))))
    at, to = F.greatest("lo", F.col("block") * size), F.least(hi, (F.col("block") + 1) * size)
    skip, n = (at - F.col("lo")).cast("int"), (to - at).cast("int")
    return cut.select("tree", "block", at.alias("lo"), n.alias("n"), "total", F.substring("leaves", skip * 32 + 1, n * 32).alias("leaves"), F.slice("carried", skip + 1, n).alias("carried"))


def _edges(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = ["tree", "block", "lo", "n", "total"]
            found = []
            for lo, total, leaves in zip(column(b, "lo"), column(b, "total"), column(b, "leaves"), strict=True):
                stack = Mountain(lo, sizes(total, levels))
                for i in range(0, len(leaves), 32):
                    stack.push(leaves[i : i + 32])
                found.append(_pack_nodes(stack.close()))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(found, pa.binary())], names=[*names, "edges"])

    return run


def _merged(levels: int):
    """For each block: a row with the nodes that each of its runs lacks, and one with its digest (lo is null)."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        tree, block = key
        total = rows.column("total")[0]
        counts = sizes(total.as_py(), levels)
        found = merge([node for edges in rows.column("edges").to_pylist() for node in _unpack_nodes(edges)], counts)
        los = rows.column("lo").to_pylist()
        nodes = [_pack_nodes([(*k, found[k]) for k in sorted(set(beside(lo, lo + n, counts)))]) for lo, n in zip(los, rows.column("n").to_pylist(), strict=True)]
        n = len(los) + 1
        return pa.table(
            {
                "tree": pa.array([tree.as_py()] * n),
                "block": pa.array([block.as_py()] * n, pa.int64()),
                "lo": pa.array([*los, None], pa.int64()),
                "total": pa.array([total.as_py()] * n, pa.int64()),
                "nodes": pa.array([*nodes, found[len(counts) - 1, block.as_py()]], pa.binary()),
            }
        )

    return run


def plant(found: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Grow the trees of runs.  Returns the runs with what their proofs need, and the digest of each tree.

    Runs: tree, block, lo, n, total, leaves, carried, nodes (those beside the run in its block), and the path
    from the block up: siblings, steps.  Digests: tree, root (bytes).
    """
    pieces = pieces_of(found, levels)
    edges = pieces.drop("carried").mapInArrow(_edges(levels), "tree string, block long, lo long, n int, total long, edges binary")
    merged, _ = materialise(edges.groupBy("tree", "block").applyInArrow(_merged(levels), "tree string, block long, lo long, total long, nodes binary"), "merkle-nodes")
    tops = merged.where("lo IS NULL").drop("lo")
    pieces = pieces.join(merged.where("lo IS NOT NULL").select("tree", "lo", "nodes"), ["tree", "lo"])
    size = FANOUT**levels
    if (tops.agg(F.max("total")).first()[0] or 0) <= size:
        return pieces.withColumns({"siblings": F.lit(""), "steps": F.array().cast("array<int>")}), tops.select("tree", F.col("nodes").alias("root"))
    above = tops.select("tree", F.col("block").alias("lo"), F.lit(1).alias("n"), F.ceil(F.col("total") / size).alias("total"), F.col("nodes").alias("leaves"), F.array(F.struct("block")).alias("carried"))
    grown, roots = plant(above, levels)
    paths = prove(grown, levels).select("tree", "carried.block", "siblings", "steps")
    return pieces.join(paths, ["tree", "block"]), roots


def _paths(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = ["lo", "n", "total", "leaves", "nodes", "siblings", "steps"]
            for i, (lo, n, total, leaves, nodes, above, steps) in enumerate(zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in names), strict=True)):
                yield _proved(b.slice(i, 1), lo, lo + n, sizes(total, levels), leaves, nodes, (above, steps))

    return run


def _proved(row: pa.RecordBatch, lo: int, hi: int, counts: list[int], leaves: bytes, nodes: bytes, above: tuple[str, list[int]]) -> pa.RecordBatch:
    """One row for each leaf of a run: the digests beside its way to the root, and at each step the size of the group and its place there."""
    stack = Mountain(lo, counts)
    for i in range(0, len(leaves), 32):
        stack.push(leaves[i : i + 32])
    digests = [{first + i: d.hex() for i, d in enumerate(own)} for first, own in zip(stack.first, stack.nodes, strict=True)]
    digests += [{} for _ in range(len(counts) - len(digests))]
    for level, at, d in _unpack_nodes(nodes):
        digests[level][at] = d.hex()
    top = len(counts) - 1
    paths = {lo // FANOUT**top: above}
    for level in range(top - 1, -1, -1):
        span, found = FANOUT**level, {}
        for at in range(lo // span, (hi - 1) // span + 1):
            group = members(at // FANOUT, counts[level])
            siblings, steps = paths[at // FANOUT]
            found[at] = "".join([digests[level][x] for x in group if x != at]) + siblings, [4 * len(group) + at - group[0], *steps]
        paths = found
    n = hi - lo
    proofs = [paths[at] for at in range(lo, hi)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(row.column(row.schema.get_field_index("tree")).to_pylist() * n, pa.string()),
            row.column(row.schema.get_field_index("carried")).flatten(),
            pa.array([digests[0][at] for at in range(lo, hi)], pa.string()),
            pa.array([siblings for siblings, _ in proofs], pa.string()),
            pa.array([steps for _, steps in proofs], pa.list_(pa.int32())),
        ],
        names=["tree", "carried", "leaf", "siblings", "steps"],
    )


def prove(grown: DataFrame, levels: int = LEVELS) -> DataFrame:
    """tree, carried, leaf, siblings, steps: a row for each leaf of the runs of :func:`plant`."""
    schema = T.StructType(
        [
            T.StructField("tree", T.StringType()),
            T.StructField("carried", grown.schema["carried"].dataType.elementType),
            T.StructField("leaf", T.StringType()),
            T.StructField("siblings", T.StringType()),
            T.StructField("steps", T.ArrayType(T.IntegerType())),
        ]
    )
    return grown.select("tree", "lo", "n", "total", "leaves", "nodes", "siblings", "steps", "carried").mapInArrow(_paths(levels), schema)


def fold(leaf: Column, siblings: Column, steps: Column) -> Column:
    """The root that a leaf and the digests beside its way give."""

    def step(so_far: Column, s: Column) -> Column:
        place, size = s % 4, F.floor(s / 4).cast("int")
        before, after = place * 64, (size - 1 - place) * 64
        at = so_far["at"]
        return F.struct(F.sha2(F.concat(siblings.substr(at, before), so_far["digest"], siblings.substr(at + before, after)), 256).alias("digest"), (at + before + after).alias("at"))

    return F.aggregate(steps, F.struct(leaf.alias("digest"), F.lit(1).alias("at")), step, lambda x: x["digest"])


def manifest(df: DataFrame, columns=COLUMNS, by: str = "source", order: str = "doc_id", carried: list[Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """The manifest of a table: carried (a struct; by default all columns), leaf, subroot, root, siblings, steps.

    ``siblings`` holds the digests beside the way from the leaf to the root, all in one text, and ``steps`` for
    each group on the way ``4 * size + place``; :func:`fold` recomputes the root from them.
    """
    tree = F.when(F.col(by).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(by).cast("string")))  # "-" is less than "="
    leaves = df.select(tree.alias("tree"), F.col(order).alias("ord"), F.unhex(leaf_digest(*[F.col(c) for c in columns])).alias("leaf"), F.struct(*(carried or [F.col(c) for c in df.columns])).alias("carried"))
    grown, subroots = plant(runs_of(leaves), levels)
    over, root = plant(runs_of(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("ord"), F.col("root").alias("leaf"), F.struct("tree").alias("carried"))), levels)
    sources = prove(over, levels).join(root, "tree").select(F.col("carried.tree").alias("tree"), F.col("leaf").alias("subroot"), F.lower(F.hex("root")).alias("root"), F.col("siblings").alias("more"), F.col("steps").alias("further"))
    sources, _ = materialise(sources, "merkle-sources")
    out = prove(grown, levels).join(sources, "tree")
    return out.select("carried", "leaf", "subroot", "root", F.concat("siblings", "more").alias("siblings"), F.concat("steps", "further").alias("steps"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    touched = remainder(F.col("doc_id"), 2) == 0
    tampered = leaf_digest(*[F.when(touched, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")) if c == "text" else F.col(c) for c in COLUMNS])
    out = manifest(docs, carried=[F.col("doc_id"), F.when(touched, tampered).alias("tampered")])
    folded = fold(F.coalesce("carried.tampered", "leaf"), F.col("siblings"), F.col("steps"))
    out = out.select("carried.doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = """
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY b) AS t
  FROM (SELECT range AS b FROM range(256))
),
docs AS (
  SELECT doc_id, source, lang, n_chars, text, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS tree,
    list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) & 1 = 1 AS touched
  FROM documents CROSS JOIN crc_table
),
leaves AS (
  SELECT doc_id, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n,
    sha256(head || CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' || text END) AS leaf,
    sha256(head || CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(other)) || ':' || other END) AS changed
  FROM (SELECT *, CASE WHEN touched THEN replace(text, chr(10), '') ELSE text END AS other,
    concat(coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
      coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-')) AS head FROM docs)
),
nodes(tree, level, idx, h, n) AS (
  SELECT tree, 0, idx, leaf, n FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 3, n
),
subroots AS (SELECT tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, count(*) OVER () AS n, h FROM nodes WHERE n = 1),
upper_nodes(level, idx, h, n) AS (
  SELECT 0, idx, h, n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM upper_nodes WHERE n > 1 GROUP BY level, idx // 3, n
),
groups AS (
  SELECT tree, level, idx // 3 AS g, list(h ORDER BY idx) AS members FROM nodes WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT NULL, level, idx // 3, list(h ORDER BY idx) FROM upper_nodes WHERE n > 1 GROUP BY ALL
),
way(doc_id, tree, level, idx, folded, proof) AS (
  SELECT doc_id, tree, 0, idx, changed, '' FROM leaves
  UNION ALL
  SELECT doc_id, w.tree, w.level + 1, idx // 3,
    sha256(array_to_string(members[:idx % 3] || [folded] || members[idx % 3 + 2:], '')),
    proof || array_to_string(members[:idx % 3] || members[idx % 3 + 2:], '')
  FROM way w JOIN groups g ON g.tree = w.tree AND g.level = w.level AND g.g = w.idx // 3
),
at_subroot AS (SELECT * FROM way QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) = 1),
upper_way(doc_id, level, idx, folded, proof) AS (
  SELECT doc_id, 0, s.idx, folded, proof FROM at_subroot JOIN subroots s USING (tree)
  UNION ALL
  SELECT doc_id, w.level + 1, idx // 3,
    sha256(array_to_string(members[:idx % 3] || [folded] || members[idx % 3 + 2:], '')),
    proof || array_to_string(members[:idx % 3] || members[idx % 3 + 2:], '')
  FROM upper_way w JOIN groups g ON g.tree IS NULL AND g.level = w.level AND g.g = w.idx // 3
),
at_root AS (SELECT * FROM upper_way QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) = 1)
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.h AS verified
FROM at_root JOIN leaves USING (doc_id) JOIN subroots s USING (tree) CROSS JOIN (SELECT h FROM upper_nodes WHERE n = 1) r
"""
