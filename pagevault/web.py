"""The engine's health over HTTP, as a WSGI application: /health/live, /health/ready, and /docs, which describes them.

python -m pagevault.web PORT serves it. A session is taken when the first request asks for one, not at import.
"""

from __future__ import annotations

import html
import json
import sys
from collections.abc import Callable, Iterable
from wsgiref.simple_server import make_server

from pagevault.service import Engine, create_engine

Answer = tuple[str, str, bytes]  # status, content type, body


def _health(check: str) -> Callable[[Engine], Answer]:
    return lambda engine: ("200 OK", "application/json", json.dumps(getattr(engine, check)().first().asDict(), separators=(",", ":")).encode())


def _docs(engine: Engine) -> Answer:
    rows = "".join(f"<li><code>GET {path}</code> {html.escape(text)}</li>" for path, (text, _) in ROUTES.items())
    page = f"<!doctype html><title>{html.escape(engine.title)}</title><h1>{html.escape(engine.title)} {engine.version}</h1><p>{html.escape(engine.description)}</p><ul>{rows}</ul>"
    return "200 OK", "text/html; charset=utf-8", page.encode()


ROUTES: dict[str, tuple[str, Callable[[Engine], Answer]]] = {
    "/health/live": ('answers {"status": "ok"} as long as the process runs', _health("live")),
    "/health/ready": ('answers {"status": "ok"}; no dependency is asked', _health("ready")),
    "/docs": ("this page", _docs),
}


def create_app(engine: Engine | None = None) -> Callable[[dict, Callable], Iterable[bytes]]:
    """A WSGI application over an engine, or over the one that the first request creates."""
    held = [engine]

    def app(environ: dict, start: Callable) -> list[bytes]:
        route, method = ROUTES.get(environ.get("PATH_INFO", "")), environ.get("REQUEST_METHOD", "GET")
        if route is None:
            status, kind, body = "404 Not Found", "application/json", b'{"detail":"Not Found"}'
        elif method not in ("GET", "HEAD"):
            status, kind, body = "405 Method Not Allowed", "application/json", b'{"detail":"Method Not Allowed"}'
        else:
            held[0] = held[0] or create_engine()
            status, kind, body = route[1](held[0])
        allow = [("Allow", "GET, HEAD")] if status.startswith("405") else []
        start(status, [("Content-Type", kind), ("Content-Length", str(len(body))), *allow])
        return [] if method == "HEAD" else [body]

    return app


def main(args: list[str]) -> int:
    with make_server("127.0.0.1", int(args[0]) if args else 8000, create_app()) as server:
        server.serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
