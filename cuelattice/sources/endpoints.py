"""Clients of OpenAI-compatible endpoints: an embedder and a hop planner.

Both take a ``post`` function (url, headers, body) -> response for tests and
for other transports; the default speaks HTTP with the standard library.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from ..config import embedding_dim
from ..operators.walk import checked_decision

BASE_URL = "https://api.openai.com/v1"
Post = Callable[[str, dict, dict], dict]


#: Seconds to wait before each further try of a request.
WAITS = (1, 4, 16)


def http_post(url: str, headers: dict, body: dict) -> dict:
    """One request, tried again where the endpoint is busy, fails or cannot be reached."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    for wait in (*WAITS, None):
        try:
            with urllib.request.urlopen(request, timeout=120) as response:
                return json.load(response)
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            if wait is None or isinstance(e, urllib.error.HTTPError) and e.code != 429 and e.code < 500:
                raise
            time.sleep(wait)
    raise AssertionError("not reached")


@dataclass
class EndpointEmbedder:
    """Vectors of texts.  An unknown model needs ``dimensions``; they are sent only if ``send_dimensions``."""

    model: str
    dimensions: int | None = None
    send_dimensions: bool = True
    model_version: str | None = None
    base_url: str | None = None
    api_key: str = field(default="", repr=False)
    post: Post = field(default=http_post, repr=False)
    #: Texts of one request at most.
    batch: int = 256

    def __post_init__(self):
        given = self.dimensions is not None
        self.dimensions = embedding_dim(self.model, self.dimensions)
        self.send_dimensions = self.send_dimensions and given

    def embed(self, texts: list[str]) -> list[list[float]]:
        """One vector a text, in the texts' order whatever order the endpoint answers in."""
        return [v for lo in range(0, len(texts), self.batch) for v in self._request(texts[lo : lo + self.batch])]

    def _request(self, texts: list[str]) -> list[list[float]]:
        body = {"model": self.model, "input": list(texts)} | ({"dimensions": self.dimensions} if self.send_dimensions else {})
        found = self.post(f"{(self.base_url or BASE_URL).rstrip('/')}/embeddings", {"Authorization": f"Bearer {self.api_key}"}, body)["data"]
        if len(found) != len(texts):
            raise ValueError(f"the endpoint gave {len(found)} vectors for {len(texts)} texts")
        return [list(map(float, item["embedding"])) for item in sorted(found, key=lambda item: item["index"])]


DECISION_SCHEMA = {
    "type": "object",
    "additionalProperties": False,
    "required": ["collect", "descend_into", "stop"],
    "properties": {
        "collect": {
            "type": "array",
            "items": {
                "type": "object",
                "additionalProperties": False,
                "required": ["id", "relevance"],
                "properties": {"id": {"type": "string"}, "relevance": {"type": "number", "minimum": 0, "maximum": 1}},
            },
        },
        "descend_into": {"type": ["string", "null"]},
        "stop": {"type": "boolean"},
    },
}
INSTRUCTIONS = (
    "You steer a walk through a memory graph. You see the question, the current node and its candidates. "
    "Collect the candidates that help to answer, with a relevance from 0 to 1; name at most one to go down into; stop when nothing more is to be had."
)


@dataclass
class EndpointPlanner:
    """Decisions by a chat model with structured output; an empty answer means stop.  Use it through ``walk.callable_planner(planner.decide)``."""

    model: str
    base_url: str | None = None
    api_key: str = field(default="", repr=False)
    post: Post = field(default=http_post, repr=False)

    def decide(self, request: dict) -> dict | None:
        shown = {k: request[k] for k in ("query", "current", "candidates", "hops_left") if k in request}
        body = {
            "model": self.model,
            "messages": [{"role": "system", "content": INSTRUCTIONS}, {"role": "user", "content": json.dumps(shown, default=str)}],
            "response_format": {"type": "json_schema", "json_schema": {"name": "decision", "strict": True, "schema": DECISION_SCHEMA}},
        }
        answer = self.post(f"{(self.base_url or BASE_URL).rstrip('/')}/chat/completions", {"Authorization": f"Bearer {self.api_key}"}, body)
        content = answer["choices"][0]["message"].get("content")
        return checked_decision(json.loads(content)) if content else None
