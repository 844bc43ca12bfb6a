"""Failures that callers can tell apart by a code."""

from __future__ import annotations

CODES = (
    "NOT_FOUND", "AMBIGUOUS_PATH", "AMBIGUOUS_HEADING", "HEADING_NOT_FOUND", "BLOCK_NOT_FOUND", "AMBIGUOUS_BLOCK", "PATH_OUTSIDE_VAULT", "INVALID_PATH", "ALREADY_EXISTS",
    "HASH_MISMATCH", "INVALID_RANGE", "TOO_LARGE", "INVALID_ARGUMENT", "READ_ONLY", "INDEX_BUILDING", "LINK_OFFSET_INVALID", "LINK_OVERLAP", "PARTIAL_MOVE",
)


class NoteError(Exception):
    """An error with a machine-readable code, and alternatives where there are some."""

    def __init__(self, code: str, message: str, alternatives: list[str] | None = None):
        assert code in CODES, code
        super().__init__(f"{code}: {message}" + (f"; there are: {', '.join(alternatives)}" if alternatives else ""))
        self.code, self.alternatives = code, alternatives or []
