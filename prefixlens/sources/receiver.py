"""HTTP source: POST /requests lands one captured request as one line. Spark reads what has landed."""

from __future__ import annotations

import datetime
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from prefixlens.functions import canonical as C
from prefixlens.functions.strings import py_trim
from prefixlens.options import ReceiverOptions
from prefixlens.sources.landing import NdjsonAppender

#: Header names follow this prefix; it is configurable so that any capturing proxy's headers fit.
PREFIX = "x-capture-"
#: Header -> field of the comparison metadata.
KEYS = {"endpoint-key": "endpoint_key", "agent-key": "agent_key", "model-deployment-key": "model_deployment_key", "kv-namespace": "kv_namespace"}


class BadRequest(ValueError):
    pass


def _header(headers, name: str, required: bool = False) -> str | None:
    raw = headers.get(name)
    if raw is None:
        if required:
            raise BadRequest(f"header {name} is missing")
        return None
    try:
        value = py_trim(raw.encode("latin-1").decode("utf-8"))
    except UnicodeError:
        raise BadRequest(f"header {name} is no text") from None
    if not value:
        raise BadRequest(f"header {name} is empty")
    return value


def captured(headers, body: bytes, prefix: str = PREFIX, now: datetime.datetime | None = None) -> dict:
    """The captured request of a body and its headers; BadRequest says what is wrong with them."""
    try:
        payload = C.parse(body.decode("utf-8"))
    except ValueError as e:
        raise BadRequest(f"the body is no JSON: {e}") from None
    if type(payload) is not dict:
        raise BadRequest("the body must be a JSON object")
    comparison = {field: v for name, field in KEYS.items() if (v := _header(headers, prefix + name, name == "endpoint-key")) is not None}
    stamp = (now or datetime.datetime.now(datetime.timezone.utc)).isoformat().replace("+00:00", "Z")
    out: dict = {"captured_at": stamp}
    if (source := headers.get(prefix + "source")) is not None:
        out["source"] = source
    if (session := _header(headers, prefix + "session-key")) is not None:
        out["session_key"] = session
    return {**out, "comparison": comparison, "payload": payload}


def make_server(appender: NdjsonAppender, options: ReceiverOptions = ReceiverOptions(), prefix: str = PREFIX) -> ThreadingHTTPServer:
    """A server bound to ``options.listen``; the appender's lock is taken before."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def answer(self, status: int, **body: object) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            if status >= 400:
                self.send_header("Connection", "close")
                self.close_connection = True
            self.end_headers()
            self.wfile.write(data)

        def do_POST(self) -> None:
            if self.path.split("?")[0] != "/requests":
                return self.answer(404, error="not found")
            length = self.headers.get("Content-Length")
            if length is None or not length.isdigit():
                return self.answer(411, error="Content-Length is missing")
            if int(length) > options.max_payload_bytes:
                return self.answer(413, error="the body is too large")
            try:
                value = captured(self.headers, self.rfile.read(int(length)), prefix)
            except BadRequest as e:
                return self.answer(400, error=str(e))
            try:
                appender.append(value)
            except OSError as e:
                return self.answer(500, error=str(e))
            return self.answer(202, accepted=True)

        def refuse(self) -> None:
            self.answer(405 if self.path.split("?")[0] == "/requests" else 404, error="only POST /requests")

        do_GET = do_PUT = do_DELETE = do_PATCH = do_HEAD = refuse

        def log_message(self, *_: object) -> None:
            pass

    host, _, port = options.listen.rpartition(":")
    server = ThreadingHTTPServer((host.strip("[]"), int(port)), Handler)
    server.daemon_threads = False
    return server
