"""Coded errors raised by the engine."""

from __future__ import annotations


class AssayError(Exception):
    """An expected failure, identified by a stable machine-readable ``code``."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code
        self.message = message
