"""Settings: validated values, precedence, and constructors of the parts."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from .functions.scalar import HASH_DIM, HASH_MODEL
from .sources.workspace import PREFIX, Workspace, load_dotenv

DEFAULT_MODEL, DEFAULT_DIM = "nomic-embed-text", 768
#: Dimensions of well-known embedding models.
KNOWN_DIMS = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536}
TRUE, FALSE = {"1", "true", "yes", "on", "y", "t"}, {"0", "false", "no", "off", "n", "f"}


class ConfigError(RuntimeError):
    """A setting that does not validate; the message names it."""


@dataclass(frozen=True)
class Settings:
    embed_model: str | None = None
    embed_dim: int | None = None
    embed_base_url: str | None = None
    embed_api_key: str | None = dataclasses.field(default=None, repr=False)
    embed_send_dim: bool = False
    llm_model: str | None = None
    llm_base_url: str | None = None
    llm_api_key: str | None = dataclasses.field(default=None, repr=False)

    @classmethod
    def from_mapping(cls, values: Mapping[str, str]) -> Settings:
        """Settings from these values alone, never from the process's environment."""
        out: dict = {}
        for name, field in cls.__dataclass_fields__.items():
            raw = values.get(PREFIX + name.upper())
            if raw is None:
                continue
            if field.type == "int | None":
                try:
                    raw = int(raw)
                except ValueError:
                    raise ConfigError(f"{PREFIX}{name.upper()}: {raw!r} is not a whole number") from None
            elif field.type == "bool":
                low = raw.strip().lower()
                if low not in TRUE | FALSE:
                    raise ConfigError(f"{PREFIX}{name.upper()}: {raw!r} is neither true nor false")
                raw = low in TRUE
            out[name] = raw
        return cls(**out)


@dataclass(frozen=True)
class Config:
    workspace: Workspace
    settings: Settings
    embed_model: str
    embed_dim: int


def merged(env: Mapping[str, str], root: str | Path) -> dict[str, str]:
    """config.toml, overridden by .env, overridden by the environment."""
    return {**Workspace(root).load_config(), **load_dotenv(root), **{k: v for k, v in env.items() if k.startswith(PREFIX)}}


def resolve(env: Mapping[str, str], root: str | Path = ".") -> Config:
    """Configuration of a repository: given settings first, then what its index was built with, then defaults."""
    workspace = Workspace(root)
    settings = Settings.from_mapping(merged(env, root))
    manifest = workspace.load_manifest()
    model = settings.embed_model or (manifest.embed_model if manifest else DEFAULT_MODEL)
    if settings.embed_dim is not None:
        dim = settings.embed_dim
    elif model == HASH_MODEL:
        dim = HASH_DIM
    else:
        dim = manifest.embed_dim if manifest and manifest.embed_model == model else KNOWN_DIMS.get(model, DEFAULT_DIM)
    return Config(workspace, settings, model, dim)


def embedding_dim(model: str, dimensions: int | None = None) -> int:
    """A model's dimension: as given, else as known; an unknown model needs one."""
    if dimensions is not None:
        return dimensions
    if model not in KNOWN_DIMS:
        raise ValueError(f"unknown embedding model {model!r}: give its dimensions")
    return KNOWN_DIMS[model]


def check_model(index_model: str | None, index_dim: int | None, model: str, dim: int) -> None:
    """Queries must be embedded as the index was."""
    if index_model is not None and index_model != model:
        raise RuntimeError(f"embedder model {model!r} is not the index's {index_model!r}")
    if index_dim is not None and index_dim != dim:
        raise RuntimeError(f"embedder dimension {dim} is not the index's {index_dim}; check {PREFIX}EMBED_DIM")


def require_embed_key(settings: Settings) -> str:
    """The key of the embedding endpoint; only an endpoint of one's own goes without."""
    if settings.embed_api_key:
        return settings.embed_api_key
    if settings.embed_base_url is None:
        raise ConfigError(f"no embedding key: set {PREFIX}EMBED_API_KEY, or {PREFIX}EMBED_BASE_URL for a server of your own")
    return "none"


def require_llm_model(settings: Settings) -> str:
    if not settings.llm_model:
        raise RuntimeError(f"reconstruct needs a chat model: set {PREFIX}LLM_MODEL")
    return settings.llm_model
