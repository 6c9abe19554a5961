"""The workspace folder of an indexed repository: paths, run manifest, config file, .env."""

from __future__ import annotations

import json
import logging
import os
import tomllib
from dataclasses import asdict, dataclass
from pathlib import Path

logger = logging.getLogger(__name__)

FOLDER = ".cuelattice"
PREFIX = "CUELATTICE_"
SCIP_STATES = ("present", "absent", "failed")
#: Sections and keys of config.toml; secrets are read from the environment only.
CONFIG_KEYS = {
    "embed": {"model": "EMBED_MODEL", "dim": "EMBED_DIM", "base_url": "EMBED_BASE_URL", "send_dimensions": "EMBED_SEND_DIM"},
    "llm": {"model": "LLM_MODEL", "base_url": "LLM_BASE_URL"},
}


@dataclass(frozen=True)
class RunManifest:
    """Provenance of a workspace: which run wrote the graph and which the cross-references."""

    repo_root: str
    embed_model: str
    embed_dim: int
    run_id: str
    updated_at: str
    files: int
    scip_status: str = "absent"
    scip_run_id: str | None = None
    scip_generated_at: str | None = None
    embed_model_version: str | None = None
    format_version: int = 1

    @property
    def is_consistent(self) -> bool:
        return self.scip_status == "present" and self.scip_run_id == self.run_id


class Workspace:
    def __init__(self, root: str | Path):
        self.root = Path(root).resolve()
        self.dir = self.root / FOLDER
        self.store_path = self.dir / "store"
        self.scip_path = self.dir / "index.scip"
        self.manifest_path = self.dir / "manifest.json"
        self.config_path = self.dir / "config.toml"

    def ensure_dirs(self) -> None:
        self.store_path.mkdir(parents=True, exist_ok=True)

    def load_manifest(self) -> RunManifest | None:
        """The run manifest; None where it is missing, unreadable or has other fields."""
        try:
            found = RunManifest(**json.loads(self.manifest_path.read_text(encoding="utf-8")))
        except (OSError, ValueError, TypeError):
            return None
        return found if found.scip_status in SCIP_STATES else None

    def write_manifest(self, manifest: RunManifest) -> None:
        self.dir.mkdir(parents=True, exist_ok=True)
        draft = self.manifest_path.with_suffix(".tmp")
        draft.write_text(json.dumps(asdict(manifest), indent=2) + "\n", encoding="utf-8")
        os.replace(draft, self.manifest_path)

    def load_config(self) -> dict[str, str]:
        """config.toml as environment-style settings; unknown sections and keys are warned of."""
        if not self.config_path.is_file():
            return {}
        out = {}
        for section, values in tomllib.loads(self.config_path.read_text(encoding="utf-8")).items():
            keys = CONFIG_KEYS.get(section)
            if keys is None or not isinstance(values, dict):
                logger.warning("config.toml: unknown section or key %r", section)
                continue
            for key, value in values.items():
                if key not in keys:
                    logger.warning("config.toml: unknown key %r in [%s]", key, section)
                else:
                    out[PREFIX + keys[key]] = str(int(value)) if isinstance(value, bool) else str(value)
        return out


def load_dotenv(root: str | Path) -> dict[str, str]:
    """``.env`` of exactly this folder; keys without a value are left out, and the process's environment is not touched."""
    path = Path(root) / ".env"
    out: dict[str, str] = {}
    if not path.is_file():
        return out
    for line in path.read_text(encoding="utf-8").splitlines():
        line = line.strip().removeprefix("export ").lstrip()
        key, equals, value = line.partition("=")
        if not line or line.startswith("#") or not equals:
            continue
        value = value.strip()
        if value[:1] in "\"'" and value[:1] and value[-1:] == value[:1] and len(value) > 1:
            value = value[1:-1]
        else:
            value = value.split(" #", 1)[0].rstrip()
        out[key.strip()] = value
    return out
