"""The same answers over HTTP."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.project import Project, rows

PAGE = """<!doctype html><meta charset="utf-8"><title>codestrata</title>
<style>body{font:15px/1.5 system-ui;margin:2em auto;max-width:60em}input{width:24em}pre{background:#f4f4f4;padding:1em;overflow:auto}</style>
<h1>codestrata</h1><pre id="stats"></pre>
<form id="search"><input name="q" placeholder="search"> <button>Search</button></form>
<form id="blast"><input name="file" placeholder="file"> <button>Impact</button></form>
<pre id="answer"></pre><h2>Activity</h2><pre id="activity"></pre>
<script>
const show = (id, data) => { document.getElementById(id).textContent = JSON.stringify(data, null, 1); };
const ask = (id, path) => fetch(path).then(r => r.json()).then(data => show(id, data));
for (const name of ["search", "blast"]) {
  const form = document.getElementById(name);
  form.onsubmit = event => { event.preventDefault(); ask("answer", `/api/${name}?` + new URLSearchParams(new FormData(form))); };
}
const refresh = () => { ask("stats", "/api/stats"); ask("activity", "/api/activity"); };
refresh();
setInterval(refresh, 5000);
</script>"""


def page_of(df: DataFrame, q: dict[str, str], key: str, *order: str) -> list[dict[str, Any]]:
    """All rows in ``order``, or, where a ``limit`` is asked for, so many rows by ``key`` after the key ``after``."""
    if "limit" not in q:
        return rows(df.orderBy(*order))
    left = df.where(F.col(key) > F.lit(q["after"]).cast(df.schema[key].dataType)) if q.get("after") else df
    return rows(left.orderBy(key).limit(int(q["limit"])))


def routes(project: Project) -> dict[str, Callable[[dict[str, str]], Any]]:
    need = lambda f: lambda q: f(q["file"]) if q.get("file") else {"error": "No file specified"}
    return {
        "/api/stats": lambda q: project.stats(),
        "/api/nodes": lambda q: page_of(project.nodes, q, "id", "file", "line"),
        "/api/edges": lambda q: page_of(project.resolved, q, "id", "id"),
        "/api/graph": lambda q: project.drawing(int(q["limit"]) if "limit" in q else None, q.get("after", "")),
        "/api/search": lambda q: project.search(q.get("q", ""), q.get("mode", "hybrid")),
        "/api/blast": need(project.blast),
        "/api/compare": need(project.compare),
        "/api/activity": lambda q: project.activity(),
        "/api/token-scenarios": lambda q: project.scenarios(),
    }


def make_server(project: Project, port: int = 8000) -> ThreadingHTTPServer:
    """A server that is not yet running. A project without a graph is built first."""
    if "nodes" not in project.store.snapshot():
        project.build()
    known = routes(project)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            parsed = urlparse(self.path)
            if parsed.path in ("/", "/index.html"):
                return self.send(200, PAGE.encode(), "text/html; charset=utf-8")
            if parsed.path not in known:
                return self.send(404, b'{"error": "not found"}')
            answer = known[parsed.path]({k: v[0] for k, v in parse_qs(parsed.query).items()})
            return self.send(200, json.dumps(answer, default=str).encode())

        def send(self, status: int, body: bytes, kind: str = "application/json") -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Access-Control-Allow-Origin", "*")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args: Any) -> None:
            """Requests are not logged."""

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
