"""Around a transport: retries with growing waits, logging, chaining, and recording for tests.

A transport is any object with the methods of METHODS; a middleware takes one and gives one.
"""

from __future__ import annotations

import logging
import queue
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog import errors

METHODS = ("create", "append", "read", "long_poll", "events", "head", "delete")


@dataclass
class Backoff:
    """The k-th wait is first * factor^k seconds, up to most."""

    retries: int = 3
    first: float = 0.1
    most: float = 10.0
    factor: float = 2.0

    def wait(self, k: int) -> float:
        return min(self.first * self.factor**k, self.most)

    def wait_ms(self, k: Column) -> Column:
        """wait as a column, in whole milliseconds."""
        return F.least(F.lit(1000 * self.first) * F.pow(F.lit(self.factor), k), F.lit(1000 * self.most)).cast("long")


class Wrapped:
    """A transport whose calls go through call(name, next, args)."""

    def __init__(self, inner, call: Callable):
        self.inner, self._call = inner, call

    def __getattr__(self, name: str):
        value = getattr(self.inner, name)
        if name not in METHODS:
            return value
        return lambda *a, **k: self._call(name, lambda: value(*a, **k), (a, k))


def retrying(backoff: Backoff | None = None, retryable: Callable[[Exception], bool] | None = None, sleep: Callable[[float], None] = time.sleep):
    """Calls again after errors that may pass: server errors and too many requests."""
    b = backoff or Backoff()
    may_pass = retryable or (lambda e: isinstance(e, errors.LogError) and errors.retryable(e.status) or isinstance(e, ConnectionError))

    def call(name, go, _):
        for k in range(b.retries + 1):
            try:
                return go()
            except Exception as e:
                if k == b.retries or not may_pass(e):
                    raise
                sleep(b.wait(k))

    return lambda inner: Wrapped(inner, call)


def logged(log: logging.Logger | None = None):
    log = log or logging.getLogger("tidelog.transport")

    def call(name, go, args):
        began = time.monotonic()
        try:
            out = go()
        except Exception as e:
            log.warning("%s %s failed after %.3f s: %s", name, args[0][:1], time.monotonic() - began, e)
            raise
        log.info("%s %s took %.3f s", name, args[0][:1], time.monotonic() - began)
        return out

    return lambda inner: Wrapped(inner, call)


def chain(*middlewares):
    """chain(a, b, c)(t) is a(b(c(t))): the first is outermost."""

    def wrap(transport):
        for m in reversed(middlewares):
            transport = m(transport)
        return transport

    return wrap


class Recorder(Wrapped):
    """Remembers the calls that pass."""

    def __init__(self, inner):
        self.calls: list[tuple[str, tuple]] = []

        def call(name, go, args):
            self.calls.append((name, args))
            return go()

        super().__init__(inner, call)

    def reset(self) -> None:
        self.calls.clear()

    def count(self, name: str | None = None) -> int:
        return sum(name in (None, n) for n, _ in self.calls)


class Stub:
    """A transport whose methods answer with what it is given: a value, an exception (raised), or a function of the arguments; a list is gone through, its last item stays."""

    def __init__(self, **answers):
        unknown = set(answers) - set(METHODS)
        if unknown:
            raise TypeError(f"no methods of a transport: {sorted(unknown)}")
        self.answers = answers

    def __getattr__(self, name: str):
        if name not in METHODS:
            raise AttributeError(name)

        def call(*args, **kwargs):
            if name not in self.answers:
                raise errors.NotImplementedYet(name)
            answer = self.answers[name]
            if isinstance(answer, list):
                answer = answer.pop(0) if len(answer) > 1 else answer[0]
            if isinstance(answer, Exception):
                raise answer
            return answer(*args, **kwargs) if callable(answer) else answer

        return call


class StubEvents:
    """An event stream for tests: what is put in comes out, an exception is raised, close() ends it."""

    def __init__(self, *chunks):
        self._queue: queue.Queue = queue.Queue()
        self.closed = False
        for c in chunks:
            self.put(c)

    def put(self, chunk) -> None:
        self._queue.put(chunk)

    def close(self) -> None:
        self.closed = True
        self._queue.put(None)

    def __call__(self, stream_id: str, offset: str, close_after: float | None = None):
        return iter(self)

    def __iter__(self):
        while (item := self._queue.get()) is not None:
            if isinstance(item, Exception):
                raise item
            yield item
