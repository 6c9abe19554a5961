"""The read tools and the walk prompt over stdio: JSON-RPC, one message a line, as the Model Context Protocol has it."""

from __future__ import annotations

import inspect
import json
import sys
from collections.abc import Iterable
from typing import TextIO

from .service import Service, reconstruct_prompt

PROTOCOL = "2024-11-05"
#: Argument schemas by parameter name.
ARGUMENTS = {
    "query": {"type": "string"},
    "k": {"type": "integer"},
    "cue_ids": {"type": "array", "items": {"type": "string"}},
    "content_ids": {"type": "array", "items": {"type": "string"}},
    "ids": {"type": "array", "items": {"type": "string"}},
    "content_id": {"type": "string"},
    "tag_filters": {"type": "array", "items": {"type": "array", "items": {"type": "string"}, "minItems": 2, "maxItems": 2}},
}


def _tool(name: str, method) -> dict:
    parameters = inspect.signature(method).parameters
    required = [p for p, v in parameters.items() if v.default is inspect.Parameter.empty]
    return {
        "name": name,
        "description": (inspect.getdoc(method) or name).split("\n")[0],
        "inputSchema": {"type": "object", "properties": {p: ARGUMENTS[p] for p in parameters}, "required": required},
    }


def handle(service: Service, message: dict) -> dict | None:
    """The answer to one message; None to a notification."""
    method, params = message.get("method"), message.get("params") or {}
    if "id" not in message:
        return None
    answer = {"jsonrpc": "2.0", "id": message["id"]}
    tools = service.tools()
    if method == "initialize":
        return answer | {
            "result": {
                "protocolVersion": PROTOCOL,
                "capabilities": {"tools": {}, "prompts": {}},
                "serverInfo": {"name": "cuelattice", "version": "1"},
            }
        }
    if method == "ping":
        return answer | {"result": {}}
    if method == "tools/list":
        return answer | {"result": {"tools": [_tool(n, m) for n, m in tools.items()]}}
    if method == "tools/call":
        arguments = dict(params.get("arguments") or {})
        try:
            if arguments.get("tag_filters") is not None:
                arguments["tag_filters"] = [tuple(p) for p in arguments["tag_filters"]]
            rows = [r.asDict(True) for r in tools[params["name"]](**arguments).collect()]
            return answer | {"result": {"content": [{"type": "text", "text": json.dumps(rows, default=str)}], "isError": False}}
        except Exception as e:  # noqa: BLE001 - a tool's failure is its answer
            return answer | {"result": {"content": [{"type": "text", "text": f"{type(e).__name__}: {e}"}], "isError": True}}
    if method == "prompts/list":
        return answer | {
            "result": {
                "prompts": [{"name": "reconstruct", "arguments": [{"name": "query", "required": True}, {"name": "budget", "required": False}]}]
            }
        }
    if method == "prompts/get" and params.get("name") == "reconstruct":
        given = params.get("arguments") or {}
        text = reconstruct_prompt(given.get("query", ""), int(given.get("budget", 3)))
        return answer | {"result": {"messages": [{"role": "user", "content": {"type": "text", "text": text}}]}}
    return answer | {"error": {"code": -32601, "message": f"unknown method {method}"}}


def serve(service: Service, lines: Iterable[str] = sys.stdin, out: TextIO = sys.stdout) -> None:
    """Answer messages until the input ends."""
    for line in lines:
        if not line.strip():
            continue
        try:
            answer = handle(service, json.loads(line))
        except ValueError:
            answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if answer is not None:
            out.write(json.dumps(answer) + "\n")
            out.flush()
