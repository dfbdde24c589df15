"""The one error of the engine."""

from __future__ import annotations


class EngineError(Exception):
    """code: 1 resources, 2 bad request, 3 bad source, 4 failed operation; line and column (from 1) of a source error."""

    def __init__(self, code: int, message: str, line: int | None = None, column: int | None = None):
        super().__init__(code, message, line, column)
        self.code, self.message, self.line, self.column = code, message, line, column

    def __str__(self) -> str:
        return self.message if self.line is None else f"{self.message} (line {self.line}, column {self.column})"
