from __future__ import annotations

import logging

import pytest

from cuelattice import cli, config, factories
from cuelattice.service import doctor, reconstruct_prompt, render_doctor
from cuelattice.sources.workspace import RunManifest, Workspace, load_dotenv


def manifest(**more):
    return RunManifest(**{"repo_root": "/r", "embed_model": "built", "embed_dim": 12, "run_id": "1", "updated_at": "x", "files": 1, **more})


def test_manifest(tmp_path):
    w = Workspace(tmp_path)
    assert w.load_manifest() is None
    w.write_manifest(manifest(scip_status="present", scip_run_id="1"))
    assert w.load_manifest().is_consistent and not manifest(scip_status="present", scip_run_id="0").is_consistent and not manifest().is_consistent
    for bad in ("{", "{}", '{"other": 1}'):
        w.manifest_path.write_text(bad)
        assert w.load_manifest() is None


def test_precedence(tmp_path, caplog):
    w = Workspace(tmp_path)
    w.ensure_dirs()
    assert config.resolve({}, tmp_path).embed_model == config.DEFAULT_MODEL
    w.write_manifest(manifest())
    assert (config.resolve({}, tmp_path).embed_model, config.resolve({}, tmp_path).embed_dim) == ("built", 12)
    w.config_path.write_text('[embed]\nmodel = "file"\nsend_dimensions = true\ncolour = 1\n[other]\na = 1\n')
    with caplog.at_level(logging.WARNING):
        found = config.resolve({}, tmp_path)
    assert found.embed_model == "file" and found.settings.embed_send_dim and "colour" in caplog.text and "other" in caplog.text
    (tmp_path / ".env").write_text("# c\nexport CUELATTICE_EMBED_MODEL='dot'\nEMPTY\nCUELATTICE_LLM_MODEL=chat # note\n")
    assert load_dotenv(tmp_path) == {"CUELATTICE_EMBED_MODEL": "dot", "CUELATTICE_LLM_MODEL": "chat"} and load_dotenv(tmp_path / "x") == {}
    assert config.resolve({}, tmp_path).embed_model == "dot"
    assert config.resolve({"CUELATTICE_EMBED_MODEL": "env"}, tmp_path).embed_model == "env"


def test_validation():
    for bad in ({"CUELATTICE_EMBED_DIM": "many"}, {"CUELATTICE_EMBED_SEND_DIM": "perhaps"}):
        with pytest.raises(config.ConfigError, match=next(iter(bad))):
            config.Settings.from_mapping(bad)
    with pytest.raises(config.ConfigError):
        config.require_embed_key(config.Settings())
    assert config.require_embed_key(config.Settings(embed_base_url="http://x")) and config.require_embed_key(config.Settings(embed_api_key="k")) == "k"
    with pytest.raises(RuntimeError):
        config.require_llm_model(config.Settings())
    assert config.embedding_dim("text-embedding-3-small") == 1536 and config.embedding_dim("own", 5) == 5
    with pytest.raises(ValueError):
        config.embedding_dim("own")
    config.check_model("m", 3, "m", 3)
    for model, dim in (("n", 3), ("m", 4)):
        with pytest.raises(RuntimeError):
            config.check_model("m", 3, model, dim)


def test_doctor_and_prompt(tmp_path):
    w = Workspace(tmp_path)
    assert [c.ok for c in doctor(w, None, "m")][1:] == [False, False, False]
    w.ensure_dirs()
    checks = doctor(w, manifest(), "m")
    assert len(checks) == 6 and "FAIL" in render_doctor(checks)
    assert "why" in reconstruct_prompt("why", 7) and "7 steps" in reconstruct_prompt("why", 7)


def test_logging_is_set_once():
    cli.configure_logging()
    cli.configure_logging(True)
    log = logging.getLogger("cuelattice")
    assert len(log.handlers) == 1 and log.level == logging.DEBUG


def test_factories(spark, tmp_path):
    config_of = lambda **env: config.resolve({f"CUELATTICE_{k}": v for k, v in env.items()}, tmp_path)
    with pytest.raises(config.ConfigError, match="EMBED_API_KEY"):
        factories.embedder(config_of())
    endpoint = factories.embedder(config_of(EMBED_MODEL="text-embedding-3-small", EMBED_API_KEY="k"))
    assert (endpoint.model, endpoint.dimensions) == ("text-embedding-3-small", 1536)
    offline = factories.embedder(config_of(EMBED_MODEL="hash-sha256-d32"))
    assert (offline.dimensions, len(offline.embed(["a"])[0])) == (32, 32)
    with pytest.raises(RuntimeError, match="LLM_MODEL"):
        factories.planner(config.Settings())
    assert callable(factories.planner(config.Settings(llm_model="chat"))) and callable(factories.planner(config.Settings(llm_model="rule")))
    store = factories.store(spark, config_of(EMBED_MODEL="m", EMBED_DIM="4"))
    with store.transaction():
        store.upsert_nodes(spark.createDataFrame([("a", "cue", "active", [1.0, 0.0, 0.0, 0.0], "m", 1)], "id string, node_type string, status string, embedding array<double>, embedding_model string, version long"))
    for model, dim in (("n", "4"), ("m", "5")):
        with pytest.raises(RuntimeError, match="index"):
            factories.store(spark, config_of(EMBED_MODEL=model, EMBED_DIM=dim))
    assert factories.references(spark, config_of()) is None


def test_a_wrong_model_stops_the_command_line(spark, tmp_path):
    said = []
    assert cli.main(["search", "x", "--repo", str(tmp_path)], spark, out=said.append, env={}) == 2 and "EMBED_API_KEY" in said[0]
