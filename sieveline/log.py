"""Logging with the request's id, secrets hidden, as lines or JSON."""

from __future__ import annotations

import contextlib
import contextvars
import json
import logging
import sys
import uuid
from collections.abc import Iterator

from .config import LoggingSettings, redacted

_request: contextvars.ContextVar[str | None] = contextvars.ContextVar("request_id", default=None)


def logger(name: str) -> logging.Logger:
    return logging.getLogger(f"sieveline.{name}")


@contextlib.contextmanager
def request(given: str | None = None) -> Iterator[str]:
    """Binds an id, a new one if none is given, to what is logged inside."""
    token = _request.set(given or uuid.uuid4().hex[:12])
    try:
        yield _request.get()
    finally:
        _request.reset(token)


class _Format(logging.Formatter):
    def __init__(self, as_json: bool):
        super().__init__()
        self.as_json = as_json

    def format(self, record: logging.LogRecord) -> str:
        fields = redacted(getattr(record, "fields", None) or {})
        if record.exc_info:
            fields["error"] = self.formatException(record.exc_info)
        line = {"time": self.formatTime(record), "level": record.levelname.lower(), "logger": record.name, "event": record.getMessage()}
        if _request.get():
            line["request_id"] = _request.get()
        if self.as_json:
            return json.dumps(line | fields, ensure_ascii=False, default=str)
        return " ".join([line["time"], f"{line['level']:<8}", line["logger"], line["event"], *(f"{k}={v}" for k, v in ({"request_id": line.get("request_id")} | fields).items() if v is not None)])


class _Stderr(logging.StreamHandler):
    """Writes to what sys.stderr is at the time."""

    @property
    def stream(self):
        return sys.stderr

    @stream.setter
    def stream(self, _):
        pass


def configure(settings: LoggingSettings) -> None:
    root = logging.getLogger("sieveline")
    root.handlers.clear()
    handler = _Stderr()
    handler.setFormatter(_Format(settings.json))
    root.addHandler(handler)
    root.setLevel(settings.level.upper())
    root.propagate = False
