"""An HTTP endpoint that lands request blobs as NDJSON files for the streaming reader.

POST /ingest takes one JSON object of at most ``MOST_BYTES``; GET /health tells counters.  Lines are
numbered as they arrive and gathered in a file that is renamed into the folder when it is full or
old enough, so that a reader never sees half a file.
"""

from __future__ import annotations

import json
import os
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

#: The largest body that is taken.
MOST_BYTES = 500_000


class Landing:
    """Appends lines and rolls files; safe for several threads.

    Numbers go on where the folder's files end, files that a lost process left open are landed, and a
    file that is old enough rolls even if no line follows.
    """

    def __init__(self, folder: str, lines: int = 10_000, seconds: float = 5.0):
        self.folder, self.most, self.seconds = folder, lines, seconds
        os.makedirs(folder, exist_ok=True)
        self.lock, self.counts, self.closed = threading.Lock(), Counter(), threading.Event()
        self._adopt()
        self.number = self._last_number()
        self._open()
        threading.Thread(target=self._watch, daemon=True).start()

    def _adopt(self) -> None:
        for name in sorted(os.listdir(self.folder)):
            if name.startswith("_") and name.endswith(".open"):
                path = os.path.join(self.folder, name)
                if os.path.getsize(path):
                    os.replace(path, os.path.join(self.folder, name[1 : -len(".open")]))
                else:
                    os.unlink(path)

    def _last_number(self) -> int:
        """The number of the folder's last line; names tell when a file was begun."""
        for name in sorted((n for n in os.listdir(self.folder) if n.endswith(".ndjson")), reverse=True):
            best = 0
            with open(os.path.join(self.folder, name), errors="replace") as f:
                for line in f:
                    try:
                        best = max(best, int(json.loads(line)["__relay_seq"]))
                    except (ValueError, TypeError, KeyError):
                        continue  # cut short when its process was lost
            if best:
                return best
        return 0

    def _open(self) -> None:
        self.name = f"{time.time_ns()}.ndjson"
        self.file, self.held, self.since = open(os.path.join(self.folder, f"_{self.name}.open"), "w"), 0, time.monotonic()  # noqa: SIM115

    def _watch(self) -> None:
        while not self.closed.wait(min(1.0, self.seconds / 2)):
            with self.lock:
                if self.held and not self.closed.is_set() and time.monotonic() - self.since > self.seconds:
                    self._roll()

    def add(self, blob: dict) -> int:
        with self.lock:
            self.number += 1
            self.file.write(json.dumps({**blob, "__relay_seq": self.number}, separators=(",", ":")) + "\n")
            self.file.flush()
            self.held += 1
            kind = blob.get("__kind", "request")
            self.counts[kind if kind in ("request", "input", "visibility") else "other"] += 1
            if self.held >= self.most:
                self._roll()
            return self.number

    def _land(self) -> None:
        self.file.close()
        if self.held:
            os.replace(self.file.name, os.path.join(self.folder, self.name))
        else:
            os.unlink(self.file.name)

    def _roll(self) -> None:
        self._land()
        self._open()

    def roll(self) -> None:
        with self.lock:
            self._roll()

    def close(self) -> None:
        """Land what is held and take no more."""
        with self.lock:
            self.closed.set()
            self._land()


def serve(landing: Landing, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server on a thread of its own; ``server_port`` tells the port, ``shutdown()`` ends it."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, status: int, body: dict) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            if self.path == "/health":
                self._reply(200, {"ok": True, "relay_seq": landing.number, "counts": dict(landing.counts)})
            else:
                self._reply(404, {"ok": False})

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if self.path != "/ingest":
                return self._reply(404, {"ok": False})
            if not 0 < size <= MOST_BYTES:
                return self._reply(400, {"ok": False, "error": "size"})
            try:
                blob = json.loads(self.rfile.read(size))
            except ValueError:
                return self._reply(400, {"ok": False, "error": "json"})
            if not isinstance(blob, dict):
                return self._reply(400, {"ok": False, "error": "object"})
            return self._reply(200, {"ok": True, "relay_seq": landing.add(blob)})

        def log_message(self, *args: object) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
