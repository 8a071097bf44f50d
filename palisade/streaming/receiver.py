"""Deliveries of a webhook over HTTP, as files of a folder that a stream reads."""

from __future__ import annotations

import json
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession

from palisade.sinks.folders import file_system
from palisade.streaming.webhook import MAX_BODY

DELIVERY = "method string, event_type string, signature string, body string"
#: Seconds that a client may take.
TIMEOUT = 10


def receiver(folder: str, port: int, host: str = "0.0.0.0") -> ThreadingHTTPServer:
    """A server, to be started with serve_forever(): POST /webhook keeps a delivery (202), GET /healthz says ok (200).
    Deliveries are neither verified nor decoded here: the stream does that. A body over MAX_BODY is refused (413)."""
    system, root = file_system(folder)
    system.create_dir(root, recursive=True)

    class Handler(BaseHTTPRequestHandler):
        timeout = TIMEOUT

        def _say(self, status: int, text: str) -> None:
            self.send_response(status)
            self.send_header("Content-Type", "text/plain")
            self.send_header("Content-Length", str(len(text) + 1))
            self.end_headers()
            self.wfile.write(f"{text}\n".encode())

        def do_GET(self) -> None:
            self._say(*((200, "ok") if self.path == "/healthz" else (404, "not found")))

        def do_POST(self) -> None:
            size = self.headers.get("Content-Length", "")
            if self.path != "/webhook":
                return self._say(404, "not found")
            if not size.isdigit():
                return self._say(411, "length required")
            if int(size) > MAX_BODY:
                return self._say(413, "too large")
            body = self.rfile.read(int(size)).decode("utf-8", "replace")
            row = {"method": "POST", "event_type": self.headers.get("X-GitHub-Event", ""), "signature": self.headers.get("X-Hub-Signature-256", ""), "body": body}
            name = uuid.uuid4().hex
            with system.open_output_stream(f"{root}/.{name}") as f:  # streams pass over names with a dot
                f.write(json.dumps(row).encode() + b"\n")
            system.move(f"{root}/.{name}", f"{root}/{name}.json")
            self._say(202, "accepted")

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of what a receiver keeps."""
    return spark.readStream.schema(DELIVERY).json(folder)
