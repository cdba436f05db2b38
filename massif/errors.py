"""Errors by code. Each code is an exception class, so callers catch the one they can handle."""

from __future__ import annotations


class EngineError(Exception):
    """Any error of this engine; `code` names its kind."""

    code = "Internal"


class InvalidInput(EngineError, ValueError):
    code = "InvalidInput"


class NotFound(EngineError, FileNotFoundError):
    code = "NotFound"


class AlreadyExists(EngineError):
    code = "AlreadyExists"


class Unsupported(EngineError, ValueError):
    code = "Unsupported"


class CorruptData(EngineError):
    code = "CorruptData"


class Io(EngineError, OSError):
    code = "Io"


class ResourceExhausted(EngineError):
    code = "ResourceExhausted"


class Cancelled(EngineError):
    code = "Cancelled"


CODES = {c.code: c for c in (InvalidInput, NotFound, AlreadyExists, Unsupported, CorruptData, Io, ResourceExhausted, Cancelled, EngineError)}


def propagate(error: Exception, doing: str) -> EngineError:
    """The same kind of error with what was being done in front; errors from elsewhere are Internal, or Io from the system."""
    kind = type(error) if isinstance(error, EngineError) else Io if isinstance(error, OSError) else EngineError
    out = kind(f"{doing}: {error}")
    out.__cause__ = error
    return out
