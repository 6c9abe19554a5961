"""The facade: the read tools, cross-references, prompts and renderings over a graph."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.scalar import content_label, short_sha
from .index import IndexStats
from .operators import graph as g
from .operators import read, scip, walk
from .operators.graph import Graph, ordered_ids
from .schema import parse_tag_filters
from .sources.scip import TOOL, tool_available
from .sources.workspace import RunManifest, Workspace

Embed = Callable[[list[str]], list[list[float]]]


@dataclass
class Service:
    """Read tools over a graph.  ``embed`` turns query texts into vectors; ``references`` are (occurrences, relationships)."""

    graph: Graph
    embed: Embed | None = None
    planner: walk.Planner | None = None
    references_data: tuple[DataFrame, DataFrame] | None = None
    seeds: int = 5

    @property
    def _spark(self):
        return self.graph.nodes.sparkSession

    def search(self, query: str, k: int = 5) -> DataFrame:
        """Nearest cues as summaries, with their scores; failures say what to check."""
        if self.embed is None:
            raise RuntimeError("search needs an embedder and none is set")
        try:
            (vector,) = self.embed([query])
            hits = read.search(self.graph, list(vector), k)
        except Exception as e:
            raise RuntimeError(f"search failed: {e}; check the embedding endpoint and that the index was built with the same model") from e
        empty = F.array().cast("array<string>")
        return hits.select(
            "id",
            F.lit("cue").alias("node_kind"),
            F.col("text").alias("label"),
            F.lit(None).cast("string").alias("snippet"),
            empty.alias("tags"),
            "score",
        ).orderBy(F.desc("score"), "id")

    def traverse_forward(self, cue_ids: list[str], tag_filters: list[tuple[str, str]] | None = None) -> DataFrame:
        found = read.traverse_forward(self.graph, ordered_ids(self._spark, cue_ids), parse_tag_filters(tag_filters))
        # Summaries and tags of the contents found alone.
        contents = self.graph.nodes.where("node_type = 'content'").join(found.select(F.col("content_id").alias("id")), "id", "left_semi")
        tagged = self.graph.edges.where("edge_type = 'tagged_with'").join(found.select(F.col("content_id").alias("source_id")), "source_id", "left_semi")
        rows = read.content_summaries(Graph(self.graph.nodes, tagged), contents).join(found.withColumnRenamed("content_id", "id"), "id")
        return rows.orderBy("ord", "edge_seq").drop("ord", "edge_seq")

    def traverse_reverse(self, content_ids: list[str]) -> DataFrame:
        found = read.traverse_reverse(self.graph, ordered_ids(self._spark, content_ids))
        rows = read.cue_summaries(self.graph.nodes).join(found.select(F.col("cue_id").alias("id"), "ord", "edge_seq"), "id")
        return rows.orderBy("ord", "edge_seq").drop("ord", "edge_seq")

    def fetch(self, ids: list[str]) -> DataFrame:
        rows = read.fetch(self.graph, ordered_ids(self._spark, ids))
        return rows.orderBy("ord").select(
            "id",
            "status",
            "source_file",
            "git_sha",
            "kind",
            "memory_layer",
            "symbol_name",
            "signature",
            "docstring",
            "body",
        )

    def content_tags(self, content_id: str) -> list[str]:
        row = g.content_tags(self.graph).where(F.col("id") == content_id).head()
        return list(row["tags"]) if row else []

    def reconstruct(self, query: str, budget: int = 3, tag_filters: list[tuple[str, str]] | None = None) -> DataFrame:
        """Contents found by the walk, best first."""
        if self.planner is None:
            raise RuntimeError("reconstruct needs a planner and none is set")
        seeds = [r.id for r in self.search(query, self.seeds).collect()]
        spark = self._spark
        state = spark.createDataFrame([("q", seeds)] if seeds else [], "qid string, seeds array<string>")
        found = walk.reconstruct(
            self.graph,
            state,
            self.planner,
            budget,
            tag_filters,
            spark.createDataFrame([("q", query)], "qid string, query string"),
        )
        rows = self.graph.nodes.join(found.select(F.col("content_id").alias("id"), "relevance", "place"), "id")
        return rows.orderBy("place").select("id", "memory_layer", "source_file", content_label().alias("label"), "relevance", "body")

    def _scip(self) -> tuple[DataFrame, DataFrame]:
        if self.references_data is None:
            raise RuntimeError("no cross-references are loaded; index the repository with the cross-reference tool installed")
        return self.references_data

    def _content(self, content_id: str) -> DataFrame:
        if self.graph.nodes.where((F.col("id") == content_id) & (F.col("node_type") == "content")).isEmpty():
            raise ValueError(f"no content node {content_id!r}")
        return self._spark.createDataFrame([(content_id,)], "content_id string")

    def references(self, content_id: str) -> DataFrame:
        occurrences, _ = self._scip()
        return scip.content_references(self.graph.nodes, occurrences, self._content(content_id)).orderBy("doc_idx", "occ_idx")

    def implementations(self, content_id: str) -> DataFrame:
        _, relations = self._scip()
        return scip.content_relations(self.graph.nodes, relations, self._content(content_id), "is_implementation")

    def type_definition(self, content_id: str) -> DataFrame:
        _, relations = self._scip()
        return scip.content_relations(self.graph.nodes, relations, self._content(content_id), "is_type_definition")

    def tools(self) -> dict[str, Callable]:
        """The read tools by name, for whatever transport serves them."""
        names = ("search", "traverse_forward", "traverse_reverse", "fetch", "references", "implementations", "type_definition")
        return {n: getattr(self, n) for n in names}


#: What each read tool takes and gives, as the walk prompt lists them.
TOOL_NOTES = {
    "search": "text -> cues with a score; start here",
    "traverse_forward": "cue ids (and category=value tags) -> contents with label, snippet and tags",
    "traverse_reverse": "content ids -> every cue that points at them",
    "fetch": "content ids -> whole bodies with their file and git_sha",
    "references": "one content id -> where its symbol is used",
    "implementations": "one content id -> symbols that implement it",
    "type_definition": "one content id -> the symbols of its type",
}


def reconstruct_prompt(query: str, budget: int = 3) -> str:
    """Instructions for an agent that plans the walk itself with the read tools."""
    tools = "\n".join(f"  {name}: {note}" for name, note in TOOL_NOTES.items())
    return (
        f"Question: {query}\nBudget: {budget} steps, where a step is one traverse call.\n\nTools\n{tools}\n\n"
        "Keep a list of (content id, relevance from 0 to 1) and a stack of ids to return to.\n"
        "In every step, rate the new contents, push the current id and move to the best one; if none is better than what is listed, pop.\n"
        "The walk ends with the budget, with an empty stack, or when two steps in a row add nothing.\n"
        "Then fetch the listed ids in order of relevance and answer from their bodies alone, naming the ids used."
    )


# ------------------------------------------------------------------ renderings


class Part(NamedTuple):
    """A part of the setup, whether it is there, and a remark."""

    part: str
    ok: bool
    remark: str


def doctor(workspace: Workspace, manifest: RunManifest | None, embed_model: str) -> list[Part]:
    """What a search needs, from the folder up; what cross-references need comes last, once something is indexed."""
    built = f"{embed_model}, {manifest.embed_dim} dimensions" if manifest else "nothing is indexed"
    parts = [
        (f"{TOOL} tool", tool_available(), "optional, for cross-references"),
        ("workspace", workspace.dir.is_dir(), str(workspace.dir)),
        ("store", workspace.store_path.is_dir(), str(workspace.store_path)),
        ("run manifest", manifest is not None, built),
    ]
    if manifest is not None:
        runs = "one run" if manifest.is_consistent else f"graph {manifest.run_id[:8]}, references {(manifest.scip_run_id or 'none')[:8]}"
        parts += [("reference file", workspace.scip_path.is_file(), manifest.scip_status), ("same run", manifest.is_consistent, runs)]
    return [Part(*p) for p in parts]


def _columns(rows: list[tuple]) -> str:
    """Rows as left-aligned columns."""
    widths = [max(len(r[i]) for r in rows) for i in range(len(rows[0]))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in rows)


def render_doctor(parts: list[Part]) -> str:
    return _columns([("part", "there", "remark"), *((p.part, "yes" if p.ok else "FAIL", p.remark) for p in parts)])


def render_stats(stats: IndexStats) -> str:
    lines = [
        f"files: {stats.indexed_files} indexed, {stats.skipped_files} skipped, {len(stats.failed_files)} failed",
        f"rows: {stats.nodes_written} nodes, {stats.edges_written} edges",
    ]
    return "\n".join(lines + [f"failed: {f}" for f in stats.failed_files])


def status_rows(files: DataFrame) -> DataFrame:
    """Indexed files with a short hash and the time of their indexing, to the second."""
    return files.select("file_path", short_sha("git_sha").alias("sha"), F.date_format("indexed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))


def render_status(embed_model: str, embed_dim: int, files: DataFrame, manifest: RunManifest | None) -> str:
    rows = status_rows(files).orderBy("file_path").collect()  # for a person to read
    state = "no run manifest" if manifest is None else f"cross-references {manifest.scip_status}, " + (
        "consistent" if manifest.is_consistent else "stale"
    )
    lines = [f"embedding: {embed_model}, dimension {embed_dim}", state, f"files: {len(rows)}"]
    return "\n".join(lines + [f"  {r.sha}  {r.at}  {r.file_path}" for r in rows])


def render_search(hits: DataFrame) -> str:
    rows = [(str(i), f"{r.score:.4f}", r.id, r.label) for i, r in enumerate(hits.collect(), 1)]
    return _columns([("rank", "score", "cue", "text"), *rows]) if rows else "nothing is near the query"


def render_reconstruct(contents: DataFrame) -> str:
    rows = [(f"{r.relevance:.3f}", r.memory_layer, r.id, r.source_file or "", r.label) for r in contents.collect()]
    return _columns([("relevance", "layer", "content", "file", "label"), *rows]) if rows else "nothing found"


def open_references(spark, path: str | Path) -> tuple[DataFrame, DataFrame] | None:
    """Cross-reference tables of a file; None where it is missing or damaged."""
    from .sources import scip as source

    if not Path(path).is_file():
        return None
    try:
        occurrences, relations = source.read(spark, path)
        occurrences.limit(1).collect()
    except Exception:  # noqa: BLE001 - a damaged file only means that there are no cross-references
        return None
    return occurrences, relations
