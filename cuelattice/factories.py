"""The parts that a configuration names: embedder, planner, store and cross-references."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from .config import Config, Settings, check_model, require_embed_key, require_llm_model
from .functions.scalar import HASH_DIM, HASH_MODEL, hash_embedding
from .operators import walk
from .operators.extract import embedder_udf
from .sources.endpoints import EndpointEmbedder, EndpointPlanner
from .sources.store import Store

#: The chat model's name that stands for the planner without a model.
RULE_PLANNER = "rule"


def hash_vectors(texts: list[str]) -> list[list[float]]:
    """The offline embedder on the driver; the same numbers as the column expression."""
    out = []
    for t in texts:
        raw = [b - 128.0 for b in hashlib.sha256(t.encode()).digest()]
        length = math.sqrt(sum(x * x for x in raw)) or 1.0
        out.append([x / length for x in raw])
    return out


@dataclass(frozen=True)
class Embedder:
    """``embed`` for a query's texts on the driver, ``column`` for a column of texts."""

    model: str
    dimensions: int
    embed: Callable[[list[str]], list[list[float]]]
    column: Callable[[Column], Column]


HASH = Embedder(HASH_MODEL, HASH_DIM, hash_vectors, hash_embedding)


def embedder(config: Config) -> Embedder:
    """The offline embedder if the model is its name, else the endpoint's, which needs a key or a server of one's own."""
    if config.embed_model == HASH_MODEL:
        return HASH
    s = config.settings
    endpoint = EndpointEmbedder(config.embed_model, config.embed_dim, s.embed_send_dim, base_url=s.embed_base_url, api_key=require_embed_key(s))
    return Embedder(endpoint.model, endpoint.dimensions, endpoint.embed, lambda text: embedder_udf(endpoint.embed)(text))


def planner(settings: Settings) -> walk.Planner:
    """A planner over the configured chat model; there must be one."""
    model = require_llm_model(settings)
    if model == RULE_PLANNER:
        return walk.rule_planner()
    return walk.callable_planner(EndpointPlanner(model, settings.llm_base_url, settings.llm_api_key or "").decide)


def store(spark: SparkSession, config: Config) -> Store:
    """The workspace's store, open; its model and dimension must be the configured ones."""
    config.workspace.ensure_dirs()
    out = Store(spark, config.workspace.store_path)
    out.initialize()
    check_model(out.embedding_model, out.embedding_dim, config.embed_model, config.embed_dim)
    out.embedding_model, out.embedding_dim = config.embed_model, config.embed_dim
    return out


def references(spark: SparkSession, config: Config) -> tuple[DataFrame, DataFrame] | None:
    """Cross-reference tables of the workspace, if they are there and can be read."""
    from .service import open_references

    return open_references(spark, config.workspace.scip_path)
