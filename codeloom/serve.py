"""A small HTTP service: /api/status, /api/graph, /api/code, and a page that shows them."""

from __future__ import annotations

import json
import threading
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from codeloom.plans import project, reports

PAGE = """<!doctype html><meta charset="utf-8"><title>codeloom</title>
<style>body{font:14px sans-serif;margin:2em}input{width:30em}td,th{padding:2px 8px;text-align:left}</style>
<h1>codeloom</h1><pre id="status"></pre><input id="find" placeholder="search"><table id="nodes"></table><pre id="code"></pre>
<script src="/app.js"></script>"""
SCRIPT = """const get = async (path) => (await fetch(path)).json();
const row = (n) => { const r = document.createElement("tr"); for (const x of [n.kind, n.label, n.filePath, n.startLine ?? ""]) { const c = document.createElement("td"); c.textContent = x; r.append(c); }
  r.onclick = async () => { document.getElementById("code").textContent = (await get(`/api/code?path=${encodeURIComponent(n.filePath)}&line=${n.startLine ?? 1}&context=5`)).code ?? ""; }; return r; };
(async () => { document.getElementById("status").textContent = JSON.stringify(await get("/api/status"), null, 2);
  const { nodes } = await get("/api/graph"); const find = document.getElementById("find");
  find.oninput = () => { const t = find.value.toLowerCase(); document.getElementById("nodes").replaceChildren(...nodes.filter((n) => `${n.label} ${n.filePath} ${n.signature}`.toLowerCase().includes(t)).slice(0, 200).map(row)); }; find.oninput(); })();
"""


class HttpError(Exception):
    def __init__(self, status: int, message: str) -> None:
        super().__init__(message)
        self.status = status


def _number(query: dict[str, list[str]], name: str, default: int | None) -> int:
    given = query.get(name, [None])[0]
    if given is None:
        if default is None:
            raise HttpError(400, f"{name} is missing")
        return default
    if not given.lstrip("-").isdigit():
        raise HttpError(400, f"{name} must be an integer")
    return int(given)


def answer(spark: SparkSession, root: str, method: str, target: str) -> tuple[str, bytes]:
    """Content type and body of a request; HttpError if there is none."""
    if method != "GET":
        raise HttpError(405, "only GET is supported")
    url = urlsplit(target)
    query = parse_qs(url.query, keep_blank_values=True)
    as_json: Any
    if url.path == "/api/status":
        as_json = project.project_status(spark, root)
    elif url.path == "/api/graph":
        as_json = project.viewer_graph(spark, root)
    elif url.path == "/api/code":
        if "path" not in query:
            raise HttpError(400, "path is missing")
        try:
            as_json = reports.snippet(root, query["path"][0], _number(query, "line", None), _number(query, "context", 0))
        except (ValueError, OSError) as e:
            raise HttpError(400, str(e)) from e
    elif url.path == "/":
        return "text/html; charset=utf-8", PAGE.encode()
    elif url.path in ("/app.js", "/web/app.js"):
        return "text/javascript; charset=utf-8", SCRIPT.encode()
    else:
        raise HttpError(404, "there is no such resource")
    return "application/json; charset=utf-8", json.dumps(as_json, ensure_ascii=False).encode()


@dataclass
class Server:
    url: str
    _http: ThreadingHTTPServer
    _thread: threading.Thread

    def join(self) -> None:
        self._thread.join()

    def close(self) -> None:
        self._http.shutdown()
        self._http.server_close()


def start(spark: SparkSession, root: str, port: int = 0, host: str = "127.0.0.1") -> Server:
    """Serve a project until closed; port 0 takes any free one."""

    class Handler(BaseHTTPRequestHandler):
        def _respond(self) -> None:
            try:
                status, (kind, body) = 200, answer(spark, root, self.command, self.path)
            except HttpError as e:
                status, kind, body = e.status, "application/json; charset=utf-8", json.dumps({"error": str(e)}).encode()
            except Exception as e:  # noqa: BLE001  the service goes on
                status, kind, body = 500, "application/json; charset=utf-8", json.dumps({"error": str(e)}).encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        do_GET = do_POST = do_PUT = do_DELETE = _respond

        def log_message(self, *_: Any) -> None:
            pass

    http = ThreadingHTTPServer((host, port), Handler)
    thread = threading.Thread(target=http.serve_forever, daemon=True)
    thread.start()
    return Server(f"http://{host}:{http.server_address[1]}", http, thread)
