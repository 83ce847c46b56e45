"""Errors that carry an SQLSTATE."""

from __future__ import annotations

RUNTIME, UNSUPPORTED, BAD_BATCH = "58000", "0A000", "22023"


class SqlError(Exception):
    def __init__(self, message: str, sqlstate: str = RUNTIME):
        super().__init__(message)
        self.sqlstate = sqlstate


def unsupported(what: str) -> SqlError:
    return SqlError(what, UNSUPPORTED)
