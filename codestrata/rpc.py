"""Tools over standard input and output: one JSON-RPC message a line."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterable
from typing import Any, TextIO

from codestrata import __version__
from codestrata.project import Project

_TEXT = {"type": "string"}
#: name: (description, properties, required).
TOOLS: dict[str, tuple[str, dict[str, Any], list[str]]] = {
    "build_graph": ("Builds or rebuilds the project's graph.", {}, []),
    "get_blast_radius": ("What a change to a file reaches: functions, files, tests and the risk.", {"file": _TEXT}, ["file"]),
    "get_review_context": ("The least that a reviewer of a file needs.", {"file": _TEXT}, ["file"]),
    "semantic_search": ("Functions and classes by name or meaning, with their neighbours.", {"query": _TEXT, "mode": {"type": "string", "enum": ["auto", "hybrid", "keyword", "semantic"], "default": "auto"}, "limit": {"type": "integer", "default": 5}}, ["query"]),
    "query_graph": ("Callers, callees or tests of a function.", {"function_name": _TEXT, "query_type": {"type": "string", "enum": ["callers", "callees", "tests", "all"], "default": "all"}}, ["function_name"]),
    "get_stats": ("Counts of nodes, edges, files, languages and vectors.", {}, []),
}


class Server:
    def __init__(self, project: Project):
        self.project = project
        self.handlers: dict[str, Callable[[dict], Any]] = {
            "build_graph": lambda a: project.build(),
            "get_blast_radius": lambda a: project.blast(a["file"], "claude"),
            "get_review_context": lambda a: project.review_context(a["file"]),
            "semantic_search": lambda a: project.search(a["query"], a.get("mode", "auto"), a.get("limit", 5), "claude", with_graph=True),
            "query_graph": lambda a: project.query_graph(a["function_name"], a.get("query_type", "all")),
            "get_stats": lambda a: project.stats(),
        }

    def call(self, name: str, arguments: dict) -> dict:
        """A tool's answer as text content; failures are answers marked as errors."""
        content = lambda x, **more: {"content": [{"type": "text", "text": json.dumps(x, indent=2, default=str)}], **more}
        if name not in self.handlers:
            return content({"error": f"Unknown tool: {name}"}, isError=True)
        try:
            return content(self.handlers[name](arguments))
        except Exception as error:
            return content({"error": str(error)}, isError=True)

    def answer(self, message: dict) -> dict | None:
        """The response to a message, or None for notifications and unknown methods."""
        method, params = message.get("method", ""), message.get("params") or {}
        if method == "initialize":
            result: dict = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {"listChanged": False}}, "serverInfo": {"name": "codestrata", "version": __version__}}
        elif method == "tools/list":
            result = {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p} | ({"required": r} if r else {})} for n, (d, p, r) in TOOLS.items()]}
        elif method == "tools/call":
            result = self.call(params.get("name", ""), params.get("arguments") or {})
        else:
            return None
        return {"jsonrpc": "2.0", "id": message["id"], "result": result} if message.get("id") is not None else None

    def run(self, lines: Iterable[str] = sys.stdin, out: TextIO = sys.stdout) -> None:
        """Answers line by line; lines that are no JSON are passed over."""
        for line in lines:
            try:
                message = json.loads(line)
            except ValueError:
                continue
            response = self.answer(message) if isinstance(message, dict) else None
            if response is not None:
                out.write(json.dumps(response) + "\n")
                out.flush()
