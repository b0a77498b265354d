"""The HTTP transport of the engine's calls."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from stratadoc.api import Engine

MOST_BODY_BYTES = 1 << 30


def make_server(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that hands each request to the engine; `serve_forever` runs it. Port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            length = int(self.headers.get("Content-Length") or 0)
            if length > MOST_BODY_BYTES:
                status, out = 413, {"error": "the body is too long"}
            else:
                status, out = engine.call(self.command, self.path, self.rfile.read(length).decode("utf-8", "replace"), dict(self.headers))
            body = json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        do_GET = do_POST = answer

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
