"""The calls of lineage.api over HTTP: JSON in, JSON out, on this machine only."""

from __future__ import annotations

import json
import os
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from tidemark import __version__, cli
from tidemark.lineage import api

#: Bytes of the largest request, and files that a watched folder may offer.
BODY, FILES = 100 << 20, 10_000


class App:
    """What the server knows: a dialect, a schema, folders and how templates are worked out."""

    def __init__(self, dialect: str = "generic", schema: dict | None = None, watch: list[str] | None = None, template: str = "raw", context: dict | None = None):
        self.dialect, self.schema, self.watch, self.template, self.context = dialect, schema or {}, watch or [], template, context

    def files(self) -> list[dict[str, str]]:
        out: list[dict[str, str]] = []
        for top in self.watch:
            for folder, _, names in sorted(os.walk(top)):
                for n in sorted(names):
                    path = os.path.join(folder, n)
                    if n.endswith(".sql") and len(out) < FILES and os.path.getsize(path) <= cli.SCRIPT_BYTES:
                        with open(path, encoding="utf-8", errors="replace") as f:
                            out.append({"name": os.path.relpath(path, top), "content": f.read()})
        return out

    def sources(self, body: dict[str, Any]) -> list[tuple[str | None, str]]:
        return [(f["name"], f["content"]) for f in body.get("files") or []] + ([(body.get("source_name"), body["sql"])] if body.get("sql") else [])

    def answer(self, method: str, path: str, body: dict[str, Any]) -> tuple[int, Any]:
        """(status, what to say); bytes are a file."""
        tables = self.schema.get("tables")
        if method == "GET":
            known: dict[str, Any] = {
                "/api/health": lambda: {"status": "ok", "version": __version__}, "/api/files": self.files, "/api/schema": lambda: self.schema,
                "/api/config": lambda: {"dialect": self.dialect, "watch_dirs": self.watch, "has_schema": bool(tables), "template_mode": self.template},
            }
            return (200, known[path]()) if path in known else (404, {"error": f"no {path}"})
        if path == "/api/analyze":
            return 200, api.analyze_files(self.sources(body), self.dialect, self.schema, body.get("template_mode") or self.template, self.context, bool(body.get("hide_ctes")))
        if path == "/api/completion":
            at = body.get("cursor_offset", body.get("position", len(body["sql"])))
            return 200, {"context": api.context(body["sql"], at, self.dialect), "items": api.complete(body["sql"], at, self.dialect, tables)}
        if path == "/api/split":
            return 200, {"statements": api.split(body["sql"], self.dialect)}
        if path.startswith("/api/export/"):
            kind = path.removeprefix("/api/export/")
            if kind == "json":
                return 200, api.analyze_files(self.sources(body), self.dialect, self.schema, self.template, self.context)
            if kind not in ("mermaid", "html", "sql", "csv"):
                return 404, {"error": f"no format {kind}"}
            made = cli.export(kind, cli.tables_of(self.sources(body), self.dialect, self.schema, "lineage", self.template, self.context), "lineage", body.get("view", "table"), body.get("schema"))
            return 200, made.encode() if isinstance(made, str) else made
        return 404, {"error": f"no {path}"}


def server(app: App, port: int = 3000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args: Any) -> None:
            pass

        def say(self, status: int, what: Any) -> None:
            data = what if isinstance(what, bytes) else json.dumps(what).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/octet-stream" if isinstance(what, bytes) else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def handle_call(self, method: str) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > BODY:
                return self.say(413, {"error": f"more than {BODY} bytes"})
            try:
                body = json.loads(self.rfile.read(size) or b"{}")
                self.say(*app.answer(method, self.path.split("?")[0], body))
            except (ValueError, KeyError, TypeError) as e:
                self.say(400, {"error": str(e)})

        def do_GET(self) -> None:
            self.handle_call("GET")

        def do_POST(self) -> None:
            self.handle_call("POST")

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def serve(port: int, *config: Any) -> None:
    with server(App(*config), port) as s:
        print(f"http://127.0.0.1:{s.server_address[1]}/api")
        s.serve_forever()
