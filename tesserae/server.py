"""The query service over HTTP, with the standard library's server: one thread a request, all of them on one Spark session."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qsl, unquote, urlsplit

from .service import Answer, Service

LARGEST_BODY = 1 << 20
_FLAGS = {"true": True, "1": True, "false": False, "0": False}
_COMMON = {"Content-Type": "application/json; charset=utf-8", "X-Content-Type-Options": "nosniff", "X-Frame-Options": "DENY", "Referrer-Policy": "no-referrer", "Content-Security-Policy": "default-src 'none'"}


def _error(status: int, detail: str) -> Answer:
    return status, {}, json.dumps({"detail": detail}).encode()


def _arguments(query: str, kinds: dict[str, type]) -> dict[str, Any]:
    """The known arguments of a query string in their types; the last of several counts."""
    out: dict[str, Any] = {}
    for name, text in parse_qsl(query, keep_blank_values=True):
        if name in kinds:
            out[name] = _FLAGS[text.lower()] if kinds[name] is bool else kinds[name](text)
    return out


class Routes:
    """What a method and a path of the interface ask of the service."""

    def __init__(self, service: Service, clock: Callable[[], str] = lambda: datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")) -> None:
        self.service, self.clock = service, clock

    def get(self, path: str, query: str, if_none_match: str) -> Answer:
        try:
            if path == "/api/search":
                asked = _arguments(query, {"q": str, "media": str, "ext": str, "sort": str, "page": int, "per": int, "cursor": str})
                return self.service.search(**asked, if_none_match=if_none_match)
            if path == "/api/albums":
                return self.service.albums(**_arguments(query, {"q": str, "page": int, "per": int, "indexed": bool}), if_none_match=if_none_match)
        except (KeyError, ValueError) as e:
            return _error(400, f"an argument cannot be read: {e}")
        if path == "/api/albums/random":
            return self.service.random_album()
        return self.service.stats() if path == "/api/stats" else _error(404, "no such address")

    def post(self, path: str, body: bytes, headers: dict[str, str]) -> Answer:
        if path != "/api/albums":
            return _error(404, "no such address")
        try:
            asked = json.loads(body)
        except ValueError:
            return _error(400, "the body is no JSON")
        return self.service.add(asked.get("urls") if isinstance(asked, dict) else None, self.clock(), headers)

    def delete(self, path: str, headers: dict[str, str]) -> Answer:
        folder, _, key = path.rpartition("/")
        return self.service.delete(unquote(key), headers) if folder == "/api/albums" and key else _error(404, "no such address")


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is bound and not yet running (``serve_forever``)."""
    routes = Routes(service)

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def _send(self, answer: Answer) -> None:
            status, headers, body = answer
            self.send_response(status)
            for name, value in {**_COMMON, **headers, "Content-Length": str(len(body))}.items():
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:  # noqa: N802
            at = urlsplit(self.path)
            self._send(routes.get(at.path, at.query, self.headers.get("If-None-Match", "")))

        def do_POST(self) -> None:  # noqa: N802
            length = self.headers.get("Content-Length", "0")
            if not length.isdigit() or int(length) > LARGEST_BODY:
                self.close_connection = True
                self._send(_error(413, "the body is too large"))
                return
            self._send(routes.post(urlsplit(self.path).path, self.rfile.read(int(length)), dict(self.headers)))

        def do_DELETE(self) -> None:  # noqa: N802
            self._send(routes.delete(urlsplit(self.path).path, dict(self.headers)))

        def log_message(self, *_: Any) -> None:
            """Requests are not logged."""

    return ThreadingHTTPServer((host, port), Handler)
