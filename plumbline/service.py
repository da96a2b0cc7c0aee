"""HTTP services on the standard library: the workspace over an engine, and a record service over a table. Routes are
tables; a gateway may stand in front of them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from typing import Any
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import MODES, Engine
from .plans.strategies import STRATEGIES
from .sources.records import authorised, list_page

PAGE = "<!doctype html><title>Plumbline</title><h1>Plumbline</h1><form onsubmit=\"fetch('/api/query',{method:'POST',body:JSON.stringify({question:q.value})}).then(r=>r.json()).then(r=>{a.textContent=r.answer});return false\"><input id=q size=80><button>Ask</button></form><pre id=a></pre>"
TYPES = {
    ".html": "text/html", ".js": "text/javascript", ".css": "text/css", ".svg": "image/svg+xml", ".png": "image/png",
}


class Refused(Exception):
    """A request that gets an error status."""

    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status, self.detail = status, detail


@dataclass
class Request:
    path: dict[str, str] = field(default_factory=dict)
    query: dict[str, str] = field(default_factory=dict)
    body: dict = field(default_factory=dict)

    def number(self, name: str, default: int, low: int, high: int) -> int:
        try:
            n = int(self.query.get(name, self.body.get(name, default)))
        except (TypeError, ValueError):
            raise Refused(422, f"{name} has to be a whole number") from None
        if not low <= n <= high:
            raise Refused(422, f"{name} has to be {low} to {high}")
        return n

    def text(self, name: str, least: int, most: int) -> str:
        s = self.body.get(name)
        if not isinstance(s, str) or not least <= len(s) <= most:
            raise Refused(422, f"{name} has to have {least} to {most} characters")
        return s

    def one_of(self, name: str, allowed, default=None):
        s = self.query.get(name, self.body.get(name, default))
        if s is not None and s not in allowed:
            raise Refused(422, f"unknown {name}: {s}")
        return s


@dataclass(frozen=True)
class Reply:
    """Anything but JSON."""

    data: bytes
    kind: str


Handler = Callable[[Request], Any]


class Service:
    """Routes (method, pattern, handler, open to all) behind a key; called by any server with method, path, headers, body."""

    def __init__(self, routes: list[tuple[str, str, Handler, bool]], allowed: Callable[[dict[str, str]], bool]):
        self.routes = [(m, re.compile(p + r"\Z"), h, o) for m, p, h, o in routes]
        self.allowed = allowed

    def __call__(self, method: str, url: str, headers: dict[str, str], body: bytes = b"") -> tuple[int, Any]:
        parts = urlsplit(url)
        headers = {k.lower(): v for k, v in headers.items()}
        try:
            for m, pattern, handler, open_ in self.routes:
                if m == method and (found := pattern.match(unquote(parts.path))):
                    if not open_ and not self.allowed(headers):
                        raise Refused(401, "not authorised")
                    query = {k: v[-1] for k, v in parse_qs(parts.query).items()}
                    return 200, handler(Request(found.groupdict(), query, self._json(body)))
            raise Refused(404, "no such route")
        except Refused as e:
            return e.status, {"detail": e.detail}

    @staticmethod
    def _json(body: bytes) -> dict:
        if not body:
            return {}
        try:
            made = json.loads(body)
        except ValueError:
            raise Refused(422, "the body has to be JSON") from None
        if not isinstance(made, dict):
            raise Refused(422, "the body has to be an object")
        return made


def workspace(engine: Engine, ui_dir: str | None = None) -> Service:
    """Questions, patients, cohort, map, graph, evaluation and audit over an engine, and the pages of ui_dir."""

    def patient(r: Request) -> str | None:
        pid = r.body.get("patient_id")
        if pid and not engine.known(pid):
            raise Refused(404, "no such patient")
        return pid

    def query(r: Request) -> dict:
        question, k, mode = r.text("question", 2, 500), r.number(
            "k", engine.settings.top_k, 1, 20,
        ), r.one_of("mode", MODES)
        history = r.body.get("history") or []
        if len(history) > 6:
            raise Refused(422, "history has 6 questions at most")
        return engine.query(
            question, patient(r), k, mode, bool(r.body.get("redact")), strategy=r.one_of("strategy", STRATEGIES),
            history=history,
        )

    def compare(r: Request) -> list[dict]:
        question, k, names = r.text("question", 2, 500), r.number(
            "k", engine.settings.top_k, 1, 20,
        ), r.body.get("strategies")
        if names and not set(names) <= set(STRATEGIES):
            raise Refused(422, "unknown strategy in list")
        return engine.compare(question, patient(r), names, k)

    def found(value: Any) -> Any:
        if value is None:
            raise Refused(404, "no such patient")
        return value

    def asset(r: Request) -> Reply:
        root = Path(ui_dir or "/nonexistent").resolve()
        file = (root / r.path["name"]).resolve()
        if root not in file.parents or not file.is_file():
            raise Refused(404, "no such file")
        return Reply(file.read_bytes(), TYPES.get(file.suffix, "application/octet-stream"))

    def index(_: Request) -> Reply:
        page = Path(ui_dir) / "index.html" if ui_dir else None
        return Reply(page.read_bytes() if page and page.is_file() else PAGE.encode(), "text/html")

    def patients(r: Request) -> list[dict]:
        rows = engine.patient_list(r.query.get("q", ""), r.one_of("sort", ("risk", "name"), "risk"))
        # All of them, as the list is the answer, a partition at a time; a page of it where one is asked for.
        rows = rows.limit(r.number("limit", 500, 1, 5000)) if "limit" in r.query else rows
        return [x.asDict() for x in rows.toLocalIterator()]

    routes = [
        ("GET", "/api/health", lambda r: {"status": "ok"} | engine.stats(), True), (
            "GET", "/api/patients", patients, False,
        ), ("GET", "/api/patients/(?P<pid>[^/]+)", lambda r: found(engine.patient_view(r.path["pid"])), False),
        (
            "GET", "/api/patients/(?P<pid>[^/]+)/similar",
            lambda r: found(engine.similar(r.path["pid"], r.number("k", 5, 1, 15))), False,
        ), ("GET", "/api/strategies", lambda r: engine.strategies(), False), ("POST", "/api/query", query, False),
        ("POST", "/api/compare", compare, False), ("GET", "/api/cohort", lambda r: engine.cohort(), False), (
            "GET", "/api/cohort/map", lambda r: engine.cohort_map(), False,
        ), ("GET", "/api/graph", lambda r: engine.graph(), False),
        ("GET", "/api/benchmark", lambda r: engine.benchmark(r.query.get("refresh") == "true"), False), (
            "GET", "/api/audit",
            lambda r: {
                "verify": engine.audit.verify(), "entries": engine.audit.entries(r.number("limit", 40, 1, 200)),
            },
            False,
        ),
        ("GET", "/", index, True), ("GET", "/assets/(?P<name>.+)", asset, True),
    ]
    return Service(routes, lambda h: authorised(h.get("x-api-key"), engine.settings.api_key))


def record_service(records: DataFrame, token: str) -> Service:
    """Pages of patients and single records of a table, for a bearer of the token."""

    def one(r: Request) -> dict:
        row = records.filter(F.col("patient_id") == r.path["pid"]).first()
        if row is None:
            raise Refused(404, "no such patient")
        return row.asDict(recursive=True)

    def page(r: Request) -> dict:
        return list_page(records, r.number("limit", 100, 1, 500), r.number("offset", 0, 0, 2**31))

    routes = [
        ("GET", "/health", lambda r: {"status": "ok", "patients": records.count()}, True),
        ("GET", "/v1/patients", page, False), ("GET", "/v1/patients/(?P<pid>[^/]+)", one, False),
    ]
    return Service(routes, lambda h: authorised(h.get("authorization", "").removeprefix("Bearer "), token))


def server(service: Service, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server of one service, to be run by serve_forever."""

    class Handle(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, made = service(self.command, self.path, dict(self.headers), body)
            raw = made if isinstance(made, Reply) else Reply(
                json.dumps(made, ensure_ascii=False, default=str).encode(), "application/json",
            )
            self.send_response(status)
            self.send_header("Content-Type", raw.kind)
            self.send_header("Content-Length", str(len(raw.data)))
            self.end_headers()
            self.wfile.write(raw.data)

        do_GET = do_POST = _answer

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handle)
