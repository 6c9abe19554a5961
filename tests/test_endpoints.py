from __future__ import annotations

import io
import json

import pytest

from cuelattice import server
from cuelattice.service import Service
from cuelattice.config import Settings
from cuelattice.sources import endpoints
from cuelattice.sources.endpoints import EndpointEmbedder, EndpointPlanner
from helpers import unit


def test_embedder():
    seen = []

    def post(url, headers, body):
        seen.append((url, headers, body))
        return {"data": [{"index": i, "embedding": [i, len(t)]} for i, t in reversed(list(enumerate(body["input"])))]}

    e = EndpointEmbedder("own", 2, base_url="http://x/", api_key="k", post=post)
    assert e.embed([]) == [] and not seen
    assert e.embed(["a", "bcd"]) == [[0.0, 1.0], [1.0, 3.0]]
    assert seen[0] == ("http://x/embeddings", {"Authorization": "Bearer k"}, {"model": "own", "input": ["a", "bcd"], "dimensions": 2})
    quiet = EndpointEmbedder("text-embedding-3-small", post=post)
    quiet.embed(["a"])
    assert quiet.dimensions == 1536 and "dimensions" not in seen[-1][2]
    with pytest.raises(ValueError):
        EndpointEmbedder("own")
    with pytest.raises(ValueError):
        EndpointEmbedder("own", 2, post=lambda *a: {"data": []}).embed(["a"])


def test_requests_are_cut():
    """Many texts are several requests, and their vectors come in the texts' order."""
    sizes = []

    def post(url, headers, body):
        sizes.append(len(body["input"]))
        return {"data": [{"index": i, "embedding": [int(t)]} for i, t in enumerate(body["input"])]}

    got = EndpointEmbedder("own", 1, post=post, batch=300).embed([str(i) for i in range(1000)])
    assert sizes == [300, 300, 300, 100] and got == [[float(i)] for i in range(1000)]


def test_requests_are_tried_again(monkeypatch):
    """A busy or unreachable endpoint is tried again a few times; a refusal is not."""
    answers, waited = [], []

    def urlopen(request, timeout):
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return io.BytesIO(json.dumps(answer).encode())

    monkeypatch.setattr(endpoints.urllib.request, "urlopen", urlopen)
    monkeypatch.setattr(endpoints.time, "sleep", waited.append)
    error = lambda code: endpoints.urllib.error.HTTPError("http://x", code, "", {}, None)
    answers[:] = [error(429), error(503), ConnectionResetError(), {"ok": 1}]
    assert endpoints.http_post("http://x", {}, {}) == {"ok": 1} and waited == [1, 4, 16]
    answers[:] = [error(401), {"ok": 1}]
    with pytest.raises(endpoints.urllib.error.HTTPError):
        endpoints.http_post("http://x", {}, {})
    answers[:] = [error(500)] * 4
    with pytest.raises(endpoints.urllib.error.HTTPError):
        endpoints.http_post("http://x", {}, {})


def test_keys_do_not_print():
    shown = repr([EndpointEmbedder("own", 1, api_key="hush"), EndpointPlanner("m", api_key="hush"), Settings(embed_api_key="hush", llm_api_key="hush")])
    assert "hush" not in shown


def test_planner():
    answer = {"content": json.dumps({"collect": [{"id": "x", "relevance": 0.5}], "descend_into": None, "stop": False})}
    planner = EndpointPlanner("chat", post=lambda url, h, body: {"choices": [{"message": answer}]})
    assert planner.decide({"query": "q", "candidates": []})["collect"] == [{"id": "x", "relevance": 0.5}]
    answer["content"] = None
    assert planner.decide({"query": "q"}) is None
    answer["content"] = json.dumps({"collect": [{"id": "x", "relevance": 2}]})
    with pytest.raises(ValueError):
        planner.decide({})


def test_server(make_graph):
    graph = make_graph([("cue-1", "cue", {"text": "one", "embedding": unit(0), "embedding_model": "m"}), ("c", "content", {})], [("cue-1", "c", "cue_of")])
    service = Service(graph, embed=lambda texts: [unit(0) for _ in texts])
    call = lambda i, method, **params: json.dumps({"jsonrpc": "2.0", "id": i, "method": method, "params": params})
    lines = [
        call(1, "initialize"), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), call(2, "tools/list"), call(3, "tools/call", name="search", arguments={"query": "q", "k": 1}),
        call(4, "tools/call", name="traverse_forward", arguments={"cue_ids": ["cue-1"], "tag_filters": [["colour", "red"]]}), call(5, "prompts/get", name="reconstruct", arguments={"query": "why", "budget": "2"}),
        call(6, "what"), "", "{", call(7, "prompts/list"), call(8, "ping"), call(9, "tools/call", name="fetch", arguments={"ids": ["c"]}),
    ]
    out = io.StringIO()
    server.serve(service, lines, out)
    answers = {a["id"]: a for a in map(json.loads, out.getvalue().splitlines())}
    assert len(answers) == 10 and answers[1]["result"]["serverInfo"]["name"] == "cuelattice"
    tools = {t["name"]: t for t in answers[2]["result"]["tools"]}
    assert set(tools) == set(service.tools()) and tools["search"]["inputSchema"]["required"] == ["query"]
    assert json.loads(answers[3]["result"]["content"][0]["text"])[0]["id"] == "cue-1"
    assert answers[4]["result"]["isError"] and "valid" in answers[4]["result"]["content"][0]["text"]
    assert "why" in answers[5]["result"]["messages"][0]["content"]["text"] and "error" in answers[6] and answers[None]["error"]["code"] == -32700
    assert json.loads(answers[9]["result"]["content"][0]["text"])[0]["body"] == "c"
