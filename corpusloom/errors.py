"""What can go wrong, as a closed set of codes that command line and server share."""

from __future__ import annotations

import errno
import os

#: The codes of errors that a client may act on.
CODES = (
    "CONFIG_NOT_FOUND", "CONFIG_INVALID", "FILE_NOT_IN_CORPUS", "TARGET_NOT_FOUND",
    "COMPILE_CONFIG_MISSING", "INVALID_INPUT", "OPERATIONAL_ERROR", "INTERNAL_ERROR",
)


class EngineError(ValueError):
    """An error whose message may be shown as it is; hint: what to do about it."""

    def __init__(self, code: str, message: str, hint: str | None = None):
        if code not in CODES:
            raise KeyError(code)
        super().__init__(message)
        self.code, self.hint = code, hint


def describe(error: BaseException, root: str | None = None) -> dict[str, str]:
    """code, message and perhaps hint of any error.

    An operating system's error counts as OPERATIONAL_ERROR if it names a path below `root`, which is shown relative to it.
    All else is INTERNAL_ERROR, without its text: that may hold paths or data that the client never named.
    """
    if isinstance(error, EngineError):
        return {"code": error.code, "message": str(error)} | ({"hint": error.hint} if error.hint else {})
    if isinstance(error, OSError) and error.errno in errno.errorcode and isinstance(error.filename, str) and root is not None:
        inner = os.path.relpath(error.filename, root)
        if inner.split(os.sep)[0] != os.pardir:
            return {"code": "OPERATIONAL_ERROR", "message": f"{errno.errorcode[error.errno]}: {os.strerror(error.errno)}, '{inner}'"}
    return {"code": "INTERNAL_ERROR", "message": "an unexpected internal error occurred"}


def said(problem: dict[str, str]) -> str:
    """Message and hint in one line; a hint that the message holds already is not repeated."""
    hint = problem.get("hint", "")
    return problem["message"] if hint in problem["message"] else f"{problem['message']} {hint}"
