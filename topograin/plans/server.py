"""An HTTP server over the request handlers: routes, JSON bodies, query strings, status codes."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from .api import Api

#: Route to handler; those of the second take a body.
PLAIN = {"/": Api.root, "/health": Api.health, "/test": Api.test}
WITH_BODY = {"/resolve_sentence": Api.resolve_sentence, "/resolve_full_text": Api.resolve_full_text, "/run_ner": Api.run_ner, "/run_candidate_selection": Api.run_candidate_selection, "/run_disambiguation": Api.run_disambiguation}
MAX_BODY = 16 << 20


def answer(api: Api, path: str, body: bytes) -> tuple[int, object]:
    """Status and JSON value of a request. A body may be JSON, or its fields may be in the query string."""
    url = urlsplit(path)
    route = url.path.rstrip("/") or "/"
    if route in PLAIN:
        return 200, PLAIN[route](api)
    if route not in WITH_BODY:
        return 404, {"detail": "no such route"}
    try:
        given = json.loads(body) if body.strip() else dict(parse_qsl(url.query))
        if not isinstance(given, dict):
            raise ValueError("the body is no object")
        return 200, WITH_BODY[route](api, given)
    except KeyError as e:
        return 422, {"detail": f"{e.args[0]} is missing"}
    except (ValueError, TypeError) as e:
        return 422, {"detail": str(e)}


def serve(api: Api, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A bound server; serve_forever() runs it. Port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            size = int(self.headers.get("Content-Length") or 0)
            status, value = (413, {"detail": "the body is too long"}) if size > MAX_BODY else answer(api, self.path, self.rfile.read(size))
            data = json.dumps(value).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_POST = do_GET  # noqa: N815

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
