"""Errors: their codes, statuses and exceptions."""

from __future__ import annotations

#: Status of each code.
STATUS = {"bad_request": 400, "not_found": 404, "conflict": 409, "gone": 410, "payload_too_large": 413, "too_many_requests": 429, "internal": 500, "not_implemented": 501}
#: Code of each status that a client tells apart.
CLIENT_CODE = {400: "BAD_REQUEST", 401: "UNAUTHORIZED", 403: "FORBIDDEN", 404: "NOT_FOUND", 409: "CONFLICT", 410: "GONE", 429: "RATE_LIMITED"}


class LogError(Exception):
    code = "internal"

    def __init__(self, message: str = "", status: int | None = None):
        super().__init__(message or self.code)
        self.status = status or STATUS[self.code]


class BadRequest(LogError):
    code = "bad_request"


class NotFound(LogError):
    code = "not_found"


class Conflict(LogError):
    code = "conflict"


class Gone(LogError):
    code = "gone"


class PayloadTooLarge(LogError):
    code = "payload_too_large"


class TooManyRequests(LogError):
    code = "too_many_requests"


class Internal(LogError):
    code = "internal"


class NotImplementedYet(LogError):
    code = "not_implemented"


class Closed(LogError):
    """A reader was used after close()."""


class TransportError(LogError):
    """An answer that stands for none of the errors above."""

    def __init__(self, code: str, status: int, message: str = ""):
        super().__init__(message or code, status)
        self.code = code


KINDS = {c.code: c for c in (BadRequest, NotFound, Conflict, Gone, PayloadTooLarge, TooManyRequests, Internal, NotImplementedYet)}


def status_of(code: str) -> int:
    return STATUS.get(code, 500)


def code_of(status: int) -> str:
    return next((k for k, v in STATUS.items() if v == status), "internal")


def client_code(status: int) -> str:
    return CLIENT_CODE.get(status, "UNKNOWN")


def from_transport(code: str, status: int = 0, message: str = "") -> LogError:
    """The exception for a transport's code, in either case; codes without one of their own stay transport errors."""
    kind = {k: KINDS[k] for k in ("bad_request", "not_found", "conflict", "gone")}.get(code.lower())
    return kind(message) if kind else TransportError(code, status or 500, message)


def raise_for(code: str, message: str = "") -> None:
    if code != "ok":
        raise KINDS.get(code, Internal)(message)


def retryable(status: int) -> bool:
    return status >= 500 or status == 429
