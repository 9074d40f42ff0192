"""The log over HTTP: a handler for the standard library's server, and a client transport.

PUT creates, POST appends, GET reads (live=long-poll or sse stays on), HEAD tells the
tail, DELETE ends. A stream's id is the path.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from tidelog import errors
from tidelog.functions import events as sse
from tidelog.functions import media, payload, requests
from tidelog.streaming.client import Chunk


def _kind(content_type: str) -> str:
    return content_type.split(";")[0].strip().lower()


def raw(message: str | bytes) -> bytes:
    return message.encode("utf-8", "surrogateescape") if isinstance(message, str) else message


def body_of(content_type: str, messages: list[str | bytes]) -> bytes:
    parts = [raw(x) for x in messages]
    return b"[" + b",".join(parts) + b"]" if _kind(content_type) == media.JSON else b"".join(parts)


def chunked(source, most: int) -> bytes:
    """A body in chunked transfer coding; refused as soon as it is over the limit."""
    out = bytearray()
    while True:
        line = source.readline(1 << 16)
        try:
            size = int(line.split(b";")[0].strip(), 16)
        except ValueError:
            raise errors.BadRequest("chunk size") from None
        if size < 0:
            raise errors.BadRequest("chunk size")
        if not size:
            while source.readline(1 << 16).strip():  # trailers
                pass
            return bytes(out)
        if len(out) + size > most:
            raise errors.PayloadTooLarge(str(len(out) + size))
        out += source.read(size)
        source.readline(1 << 16)


def parse_ttl(header: str | None) -> int | None:
    if header is None:
        return None
    if not header.isascii() or not header.isdigit() or (len(header) > 1 and header[0] == "0"):
        raise errors.BadRequest("Stream-TTL")
    return int(header) or None


def parse_expires(header: str | None) -> datetime | None:
    if header is None:
        return None
    import re

    if not re.fullmatch(r"\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)", header):
        raise errors.BadRequest("Stream-Expires-At")
    try:
        return datetime.fromisoformat(header.upper().replace("Z", "+00:00")).astimezone(timezone.utc).replace(tzinfo=None)
    except ValueError:
        raise errors.BadRequest("Stream-Expires-At") from None


def parse_read(query: str) -> tuple[str | None, str, str | None]:
    """offset, live mode and cursor of a query; raises what is wrong with them."""
    q = urllib.parse.parse_qs(query, keep_blank_values=True)
    offset, live = q.get("offset", []), q.get("live", [])
    if len(offset) > 1 or len(live) > 1 or (offset and (not offset[0] or any(c in offset[0] for c in ", \t\n\r"))):
        raise errors.BadRequest("offset or live")
    if live and live[0] not in ("", *requests.LIVE) or live and live[0] and not offset:
        raise errors.BadRequest("live")
    return (offset[0] if offset else None), (live[0] if live else ""), q.get("cursor", [None])[0]


def serve(transport, port: int = 0, max_append: int = requests.MAX_APPEND, long_poll: float = requests.LONG_POLL_S, close_after: float = requests.EVENTS_CLOSE_S) -> ThreadingHTTPServer:
    """A server over a transport; serve_forever() runs it."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *a) -> None:
            pass

        def _answer(self, status: int, body: bytes = b"", **headers) -> None:
            self.send_response(status)
            for k, v in headers.items():
                if v is not None:
                    self.send_header(k.replace("_", "-"), str(v))
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(body)

        def _handle(self) -> None:
            url = urllib.parse.urlsplit(self.path)
            self.stream_id = urllib.parse.unquote(url.path)
            try:
                body = self._body()
                operation = requests.ROUTES.get(self.command)
                if operation is None:
                    raise errors.BadRequest(self.command)
                getattr(self, f"_{operation}")(url.query, body)
            except errors.LogError as e:
                self._answer(e.status, json.dumps({"code": e.code, "message": str(e)}).encode(), Content_Type=media.JSON)

        def _body(self) -> bytes:
            """The request's body. One over the limit is refused before anything is stored."""
            self.close_connection = True  # unless all of it is read
            if "chunked" in (self.headers.get("Transfer-Encoding") or "").lower():
                body = chunked(self.rfile, max_append)
            else:
                size = self.headers.get("Content-Length") or "0"
                if not size.isdigit():
                    raise errors.BadRequest("Content-Length")
                if int(size) > max_append:
                    raise errors.PayloadTooLarge(size)
                body = self.rfile.read(int(size))
            self.close_connection = (self.headers.get("Connection") or "").lower() == "close"
            return body

        do_PUT = do_POST = do_GET = do_HEAD = do_DELETE = do_PATCH = _handle

        def _create(self, query: str, body: bytes) -> None:
            ttl, expires = self.headers.get("Stream-TTL"), self.headers.get("Stream-Expires-At")
            if ttl is not None and expires is not None:
                raise errors.BadRequest("Stream-TTL and Stream-Expires-At")
            kind = self.headers.get("Content-Type") or media.DEFAULT
            made = transport.create(self.stream_id, content_type=kind, ttl_seconds=parse_ttl(ttl), expires_at=parse_expires(expires), body=body or None)
            place = f"http://{self.headers.get('Host') or '%s:%s' % self.server.server_address[:2]}{urllib.parse.quote(self.stream_id)}" if made else None
            self._answer(201 if made else 200, Location=place, Stream_Next_Offset=transport.head(self.stream_id)["next_offset"], Content_Type=kind)

        def _append(self, query: str, body: bytes) -> None:
            kind = self.headers.get("Content-Type")
            head = transport.head(self.stream_id)
            if not kind:
                raise errors.BadRequest("no content type")
            if _kind(kind) != _kind(head["content_type"]):
                raise errors.Conflict("content type")
            self._answer(204, Stream_Next_Offset=transport.append(self.stream_id, body, kind, self.headers.get("Stream-Seq")))

        def _read(self, query: str, body: bytes) -> None:
            offset, live, cursor = parse_read(query)
            kind = transport.head(self.stream_id)["content_type"]
            if live == "sse":
                return self._events(offset, cursor, kind)
            got = transport.long_poll(self.stream_id, offset, long_poll) if live else transport.read(self.stream_id, offset)
            headers = {"Stream_Next_Offset": got.next_offset, "Stream_Up_To_Date": "true" if got.up_to_date else None, "Stream_Cursor": cursor}
            if live and not got.messages:
                return self._answer(204, **headers)
            cache = "no-store" if live else "public, max-age=60"
            self._answer(200, body_of(kind, got.messages), Content_Type=kind, ETag=f"{self.stream_id}:{offset or ''}:{got.next_offset}", Cache_Control=cache, **headers)

        def _events(self, offset: str, cursor: str | None, kind: str) -> None:
            chunks = transport.events(self.stream_id, offset, close_after)
            first = next(chunks, None)  # what is wrong is told by the status
            self.close_connection = True
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream")
            self.send_header("Cache-Control", "no-cache")
            self.send_header("Connection", "close")
            self.end_headers()
            for got in ([first] if first else []):
                self._frame(got, cursor, kind)
            for got in chunks:
                self._frame(got, cursor, kind)

        def _frame(self, got: Chunk, cursor: str | None, kind: str) -> None:
            out = ""
            if got.messages:
                data = body_of(kind, got.messages).decode("utf-8", "replace")  # events are UTF-8
                lines = [data] if _kind(kind) == media.JSON else data.split("\n")
                out = "event: data\n" + "".join(f"data: {x}\n" for x in lines) + "\n"
            control = {"streamNextOffset": got.next_offset} | ({"streamCursor": cursor} if cursor else {})
            self.wfile.write((out + f"event: control\ndata: {json.dumps(control)}\n\n").encode())
            self.wfile.flush()

        def _head(self, query: str, body: bytes) -> None:
            h = transport.head(self.stream_id)
            expires = h["expires_at"].strftime("%Y-%m-%dT%H:%M:%SZ") if h["expires_at"] else None
            self._answer(200, Content_Type=h["content_type"], Stream_Next_Offset=h["next_offset"], Stream_TTL=h["ttl_seconds"] or None, Stream_Expires_At=expires, Cache_Control="no-store")

        def _delete(self, query: str, body: bytes) -> None:
            transport.delete(self.stream_id)
            self._answer(204)

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


class HttpTransport:
    """headers: a mapping, or a function that gives one for each request."""

    def __init__(self, base: str, headers=None, timeout: float = 60.0):
        self.base, self.headers, self.timeout = base.rstrip("/"), headers or {}, timeout

    def _call(self, method: str, stream_id: str, query: dict | str | None = None, body: str | bytes | None = None, headers: dict | None = None, stream: bool = False):
        url = self.base + urllib.parse.quote(stream_id) + ("?" + (query if isinstance(query, str) else urllib.parse.urlencode(query)) if query else "")
        own = self.headers() if callable(self.headers) else self.headers
        sent = {k: v for k, v in {**own, **(headers or {})}.items() if v is not None}
        request = urllib.request.Request(url, raw(body) if body is not None else None, sent, method=method)
        try:
            answer = urllib.request.urlopen(request, timeout=self.timeout)
            return answer if stream else (answer.status, answer.headers, answer.read())
        except urllib.error.HTTPError as e:
            raise errors.from_transport(errors.client_code(e.code), e.code, e.read().decode(errors="replace")) from None
        except urllib.error.URLError as e:
            raise ConnectionError(str(e.reason)) from None

    @staticmethod
    def _chunk(status: int, headers, body: bytes, offset: str | None) -> Chunk:
        """JSON arrays give their elements as they are written; other bodies are one message."""
        kind = headers.get("Content-Type") or ""
        if status == 204 or not body:
            items: list = []
        elif _kind(kind) == media.JSON:
            items = payload.sliced(body.decode("utf-8", "surrogateescape"))
            if items is None:
                raise errors.TransportError("bad_answer", status, "not a JSON array")
        else:
            items = [body.decode("utf-8", "surrogateescape") if _kind(kind).startswith("text/") else body]
        return Chunk(items, headers.get("Stream-Next-Offset") or offset or "", status == 204 or headers.get("Stream-Up-To-Date") == "true", headers.get("Stream-Cursor"))

    def create(self, stream_id: str, content_type=None, ttl_seconds=None, expires_at=None, body=None) -> bool:
        expires = expires_at.strftime("%Y-%m-%dT%H:%M:%SZ") if expires_at else None
        return self._call("PUT", stream_id, body=body or "", headers={"Content-Type": content_type or media.DEFAULT, "Stream-TTL": str(ttl_seconds) if ttl_seconds else None, "Stream-Expires-At": expires})[0] == 201

    def append(self, stream_id: str, body: str | bytes, content_type=None, seq=None) -> str:
        return self._call("POST", stream_id, body=body, headers={"Content-Type": content_type, "Stream-Seq": seq})[1]["Stream-Next-Offset"]

    def read(self, stream_id: str, offset: str | None = None) -> Chunk:
        return self._chunk(*self._call("GET", stream_id, {"offset": offset} if offset else None), offset)

    def long_poll(self, stream_id: str, offset: str, timeout: float | None = None) -> Chunk:
        return self._chunk(*self._call("GET", stream_id, {"offset": offset or "-1", "live": "long-poll"}), offset)

    def events(self, stream_id: str, offset: str, close_after: float | None = None):
        with self._call("GET", stream_id, {"offset": offset or "-1", "live": "sse"}, stream=True) as answer:
            data: list = []
            for kind, text in sse.frames(x.decode() for x in answer):
                if kind == "data":
                    data = [text] if (items := payload.sliced(text)) is None else items
                else:
                    control = json.loads(text)
                    yield Chunk(data, control["streamNextOffset"], True, control.get("streamCursor"))
                    data = []

    def head(self, stream_id: str) -> dict:
        _, h, _ = self._call("HEAD", stream_id)
        return {"content_type": h["Content-Type"], "next_offset": h["Stream-Next-Offset"], "ttl_seconds": int(h["Stream-TTL"]) if h["Stream-TTL"] else None, "expires_at": parse_expires(h["Stream-Expires-At"])}

    def delete(self, stream_id: str) -> None:
        self._call("DELETE", stream_id)
