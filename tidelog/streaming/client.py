"""Clients: writers, and readers that catch up and then stay live.

They work over a transport: LocalTransport (a store) or http.HttpTransport.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

from tidelog import errors
from tidelog.functions import requests

AUTO, LONG_POLL, EVENTS = "auto", "long-poll", "sse"


@dataclass
class Chunk:
    """What one read gives: messages (text of JSON and text streams, bytes of others), the offset after them, and whether that is the tail."""

    messages: list[str | bytes]
    next_offset: str
    up_to_date: bool
    cursor: str | None = None

    def decoded(self) -> list:
        return [json.loads(x) for x in self.messages]


class LocalTransport:
    def __init__(self, store, chunk: int = requests.CHUNK, poll: float = 0.5):
        self.store, self.chunk, self.poll = store, chunk, poll

    def create(self, stream_id: str, content_type=None, ttl_seconds=None, expires_at=None, body: str | bytes | None = None) -> bool:
        return self.store.create(stream_id, content_type, ttl_seconds, expires_at, body)

    def append(self, stream_id: str, body: str | bytes, content_type=None, seq=None) -> str:
        return self.store.append_one(stream_id, body, content_type, seq)

    def read(self, stream_id: str, offset: str | None = None) -> Chunk:
        got = self.store.read(stream_id, offset, self.chunk)
        return Chunk([d for _, d in got["messages"]], got["next_offset"], got["up_to_date"])

    def long_poll(self, stream_id: str, offset: str, timeout: float = requests.LONG_POLL_S) -> Chunk:
        """Data after the offset, or after the timeout none and the same offset: what is appended meanwhile is not skipped."""
        if not offset:
            raise errors.BadRequest("a live read needs an offset")
        end = time.monotonic() + timeout
        while True:
            got = self.read(stream_id, offset)
            if got.messages or time.monotonic() >= end:
                return got
            time.sleep(min(self.poll, max(0.0, end - time.monotonic())))

    def events(self, stream_id: str, offset: str, close_after: float = requests.EVENTS_CLOSE_S) -> Iterator[Chunk]:
        kind = self.head(stream_id)["content_type"].split(";")[0].strip().lower()
        if kind != "application/json" and not kind.startswith("text/"):
            raise errors.BadRequest("events carry JSON or text")
        end = time.monotonic() + close_after
        while time.monotonic() < end:
            got = self.long_poll(stream_id, offset, min(requests.EVENTS_POLL_S, max(0.0, end - time.monotonic())))
            offset = got.next_offset
            yield got

    def head(self, stream_id: str) -> dict:
        return self.store.head(stream_id)

    def delete(self, stream_id: str) -> None:
        self.store.delete(stream_id)


class Transport(Protocol):
    """What a client needs of a transport."""

    def create(self, stream_id: str, content_type: str | None = None, ttl_seconds: int | None = None, expires_at=None, body: str | bytes | None = None) -> bool: ...

    def append(self, stream_id: str, body: str | bytes, content_type: str | None = None, seq: str | None = None) -> str: ...

    def read(self, stream_id: str, offset: str | None = None) -> Chunk: ...

    def long_poll(self, stream_id: str, offset: str, timeout: float = requests.LONG_POLL_S) -> Chunk: ...

    def events(self, stream_id: str, offset: str, close_after: float = requests.EVENTS_CLOSE_S) -> Iterator[Chunk]: ...

    def head(self, stream_id: str) -> dict: ...

    def delete(self, stream_id: str) -> None: ...


class Writer:
    """Asks for the content type once and sends with it."""

    def __init__(self, transport: Transport, stream_id: str):
        head = transport.head(stream_id)
        self.transport, self.stream_id, self.content_type, self.offset = transport, stream_id, head["content_type"], head["next_offset"]

    def send(self, body: str | bytes, seq: str | None = None) -> str:
        self.offset = self.transport.append(self.stream_id, body, self.content_type, seq)
        return self.offset

    def send_json(self, value, seq: str | None = None) -> str:
        return self.send(json.dumps(value, separators=(",", ":")), seq)


class Reader:
    """Catches up from an offset; once at the tail, goes on live in its mode."""

    def __init__(self, transport, stream_id: str, offset: str = "", mode: str = AUTO, timeout: float = requests.LONG_POLL_S):
        self.transport, self.stream_id, self.offset, self.timeout = transport, stream_id, offset, timeout
        self.mode = mode if mode in (LONG_POLL, EVENTS) else LONG_POLL
        self.live = self.closed = False
        self._events = None

    def read(self) -> Chunk:
        if self.closed:
            raise errors.Closed("the reader is closed")
        if not self.live:
            got = self.transport.read(self.stream_id, self.offset)
            self.live = got.up_to_date
        elif self.mode == LONG_POLL:
            got = self.transport.long_poll(self.stream_id, self.offset, self.timeout)
        else:
            self._events = self._events or iter(self.transport.events(self.stream_id, self.offset))
            got = next(self._events, None)
            if got is None:
                self._events = None
                got = Chunk([], self.offset, True)
        self.offset = got.next_offset
        return got

    def seek(self, offset: str) -> None:
        self.offset, self.live, self._events = offset, False, None

    def seek_tail(self) -> None:
        self.offset, self.live, self._events = self.transport.head(self.stream_id)["next_offset"], True, None

    def messages(self, until_tail: bool = False) -> Iterator[str | bytes]:
        """One message after another; errors that won't pass end it. until_tail: stops where it would wait."""
        while not self.closed:
            got = self.read()
            yield from got.messages
            if until_tail and self.live:
                return

    def close(self) -> None:
        self.closed, self._events = True, None


class Client:
    def __init__(self, transport):
        self.transport = transport

    def create(self, stream_id: str, **config) -> bool:
        return self.transport.create(stream_id, **config)

    def head(self, stream_id: str) -> dict:
        return self.transport.head(stream_id)

    def delete(self, stream_id: str) -> None:
        self.transport.delete(stream_id)

    def writer(self, stream_id: str) -> Writer:
        return Writer(self.transport, stream_id)

    def reader(self, stream_id: str, **options) -> Reader:
        return Reader(self.transport, stream_id, **options)
