"""Search over HTTP: ``/``, ``/search?q=`` and ``/api/search?q=``; all threads share one session and index."""

from __future__ import annotations

from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from tidelex.plans.index import SearchIndex
from tidelex.serving.render import as_html, as_json

MOST_HEADER = 64 * 1024


def make_server(index: SearchIndex, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            if len(self.requestline) + sum(len(k) + len(v) + 4 for k, v in self.headers.items()) > MOST_HEADER:
                return self._send(400, "text/plain", "the header is too long")
            parts = urlsplit(self.path)
            args = dict(parse_qsl(parts.query, keep_blank_values=True))  # of repeated names the last holds
            try:
                if parts.path in ("/", "/search"):
                    self._send(200, "text/html", as_html(index, args.get("q", "")))
                elif parts.path == "/api/search":
                    status, body = as_json(index, args.get("q", ""))
                    self._send(status, "application/json", body)
                else:
                    self._send(404, "text/plain", "not found")
            except Exception as e:
                self._send(500, "text/plain", f"error: {type(e).__name__}")

        def _send(self, status: int, kind: str, body: str):
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.send_header("Connection", "close")
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
