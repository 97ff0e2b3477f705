"""A small HTTP server over an engine (standard library only).

Clients of outside services are passed in: sources are functions of a date that yield (name,
content), detail is a function of (owner, activity) that returns an activity as JSON.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from datetime import date
from email.parser import BytesParser
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from wayfold.functions import geo

SIZES = {"small": 256, "1x": 512, "2x": 1024}
BODY = 15 << 20


def split_size(y: str) -> tuple[str, int]:
    """The row and the image size of "y" or "y@small", "y@1x", "y@2x"."""
    row, at, size = y.partition("@")
    if at and size not in SIZES:
        raise ValueError(f"no such size: {size!r}")
    return row, SIZES[size] if at else 512


def uploads(content_type: str, body: bytes) -> list[tuple[str, bytes]]:
    """File name and bytes of the parts named file; other fields are passed over."""
    message = BytesParser().parsebytes(b"Content-Type: " + content_type.encode() + b"\r\n\r\n" + body)
    if not message.is_multipart():
        raise ValueError("not a form")
    out = []
    for part in message.get_payload():
        if part.get_param("name", header="content-disposition") == "file" and part.get_filename():
            out.append((part.get_filename(), part.get_payload(decode=True)))
    return out


class Handler(BaseHTTPRequestHandler):
    engine = None
    flags: dict = {}
    token: str | None = None
    secret: str | None = None
    sources: dict[str, Callable] = {}
    detail: Callable | None = None

    def log_message(self, *args) -> None:
        if self.flags.get("verbose"):
            super().log_message(*args)

    def answer(self, code: int, body: bytes = b"", kind: str = "text/plain", **headers: str) -> None:
        self.send_response(code)
        for k, v in {"Content-Type": kind, "Content-Length": str(len(body)), **headers}.items():
            self.send_header(k.replace("_", "-"), v)
        if self.flags.get("cors"):
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Access-Control-Allow-Methods", "GET")
        self.end_headers()
        self.wfile.write(body)

    def allowed(self) -> bool:
        """Anyone without a configured token, else its bearer."""
        return not self.token or self.headers.get("Authorization") == f"Bearer {self.token}"

    def do_GET(self) -> None:  # noqa: N802
        url = urlparse(self.path)
        q = {k: v[0] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
        parts = url.path.strip("/").split("/")
        try:
            some = {k: date.fromisoformat(q[k]) for k in ("before", "after") if q.get(k)} | ({"filter": q["filter"]} if q.get("filter") else {})
            look = {"color": q.get("color"), "gradient": q.get("gradient"), "default": "orange"}
            if parts == ["api", "activity-count"]:
                self.answer(200, str(self.engine.count(**some)).encode(), "application/json")
            elif parts == [""]:
                stats = {r["key"]: {"count": r["count"], "types": r["types"]} for r in self.engine.properties().collect()}
                self.answer(200, json.dumps({"properties": stats, **{k: bool(v) for k, v in self.flags.items()}}).encode(), "application/json")
            elif parts[0] == "tile" and len(parts) == 4:
                y, size = split_size(parts[3])
                self.image(lambda: self.tile(f"{parts[1]}/{parts[2]}/{y}", size, look, some), some)
            elif parts == ["strava", "webhook"] and self.flags.get("webhook"):
                self.confirm(q)
            elif parts == ["render"] and self.flags.get("render"):
                self.image(lambda: self.engine.render(q.get("bounds", ""), int(q.get("width", 1024)), int(q.get("height", 1024)), **look, **some), some)
            else:
                self.answer(404)
        except ValueError as e:
            self.answer(400, str(e).encode())

    def confirm(self, q: dict) -> None:
        """The challenge of a service that wants to know whether this address takes its events."""
        if q.get("hub.mode") != "subscribe":
            self.answer(400, b"invalid mode")
        elif not self.secret or q.get("hub.verify_token") != self.secret:
            self.answer(401, b"invalid verify token")
        else:
            self.answer(200, json.dumps({"hub.challenge": q.get("hub.challenge", "")}).encode(), "application/json")

    def tile(self, tile: str, size: int, look: dict, some: dict) -> bytes | None:
        if geo.source_zoom(self.engine.store.config().zoom_levels, geo.parse_tile(tile)[0]) is None:
            raise LookupError
        return self.engine.tile(tile, size, drawn=True, **look, **some)

    def image(self, draw, some: dict) -> None:
        tag = f'"{self.engine.etag(**some)}"'
        cache = {"ETag": tag, "Cache_Control": "public, max-age=0, must-revalidate"}
        if self.headers.get("If-None-Match") == tag:
            self.answer(304, **cache)
            return
        try:
            data = draw()
        except LookupError:
            self.answer(404)
            return
        self.answer(204, **cache) if data is None else self.answer(200, data, "image/png", **cache)

    def do_POST(self) -> None:  # noqa: N802
        url = urlparse(self.path)
        parts = url.path.strip("/").split("/")
        try:
            if parts == ["upload"] and self.flags.get("upload"):
                self.upload()
            elif len(parts) == 2 and parts[0] == "fetch" and self.flags.get("fetch"):
                self.fetch(parts[1], parse_qs(url.query))
            elif parts == ["strava", "webhook"] and self.flags.get("webhook"):
                self.event()
            else:
                self.answer(404)
        except Exception as e:  # what fails inside is the server's fault, and the next request is served
            self.log_error("%s", e)
            self.answer(500, b"failed")

    def body(self) -> bytes | None:
        """None, answered, where it is too large."""
        size = int(self.headers.get("Content-Length", 0))
        if size > BODY:
            self.answer(413)
            return None
        return self.rfile.read(size)

    def fetch(self, source: str, q: dict) -> None:
        look = q.get("lookback", ["30"])[0]
        if not self.allowed():
            self.answer(401, b"bad token")
        elif not look.isdigit():
            self.answer(400, b"lookback is a number of days")
        elif source not in self.sources:
            self.answer(404, f"unknown or unconfigured source: {source}".encode())
        else:
            n = self.engine.fetch(self.sources[source], date.today(), int(look))
            self.answer(200, f"ingested {n} activities".encode())

    def event(self) -> None:
        if (body := self.body()) is None:
            return
        try:
            told = json.loads(body)
            kind, owner, activity = told["object_type"], told.get("owner_id"), told.get("object_id")
        except (ValueError, KeyError, TypeError, AttributeError):
            self.answer(400)
            return
        if kind != "activity":
            self.answer(200, b"nothing to do")
            return
        found = self.detail(owner, activity)
        text = found if isinstance(found, str) else json.dumps(found)
        got = self.engine.webhook(self.engine.spark.createDataFrame([(text,)], "body string"))
        if got["imported"]:
            self.answer(200, b"added!")
        else:
            self.answer(204 if got["skipped"] else 500)

    def upload(self) -> None:
        if not self.allowed():
            self.answer(401)
        elif (body := self.body()) is not None:
            try:
                found = uploads(self.headers.get("Content-Type", ""), body)
            except ValueError:
                self.answer(400)
                return
            if not found:
                self.answer(400, b"no file")
                return
            from pyspark.sql import functions as F

            from wayfold.sources import files

            df = self.engine.spark.createDataFrame([(n, bytearray(c)) for n, c in found], "path string, content binary")
            if not df.where(files.sniff(F.col("path"))[0].isNotNull()).isEmpty():
                got = self.engine.upload(df)
                self.answer(200 if got["imported"] else 422, json.dumps(got).encode(), "application/json")
            else:
                self.answer(415)


def server(engine, host: str = "127.0.0.1", port: int = 0, sources: dict[str, Callable] | None = None, detail: Callable | None = None, **flags) -> ThreadingHTTPServer:
    """Bound, not yet serving. The bearer token of uploads and fetches is WAYFOLD_UPLOAD_TOKEN of the environment, the webhook's verify token WAYFOLD_WEBHOOK_TOKEN."""
    if flags.get("webhook") and detail is None:
        raise ValueError("a webhook needs a client for the details of activities")
    own = {"engine": engine, "flags": flags, "token": os.environ.get("WAYFOLD_UPLOAD_TOKEN"), "secret": os.environ.get("WAYFOLD_WEBHOOK_TOKEN"), "sources": sources or {}, "detail": staticmethod(detail) if detail else None}
    return ThreadingHTTPServer((host, port), type("BoundHandler", (Handler,), own))
