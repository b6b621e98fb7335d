"""Error type shared by every operator.

Each failure carries a stable ``code`` (the codes a pipeline author sees) and
free-form details such as ``column`` or ``line``.  Checks that need data are
run as Spark aggregates; checks that need only the schema run on the driver
before any job starts.
"""

from __future__ import annotations

from collections import Counter


class TableError(Exception):
    """A table operation failed with a stable error code."""

    def __init__(self, code: str, message: str, **details):
        super().__init__(message)
        self.code = code
        self.details = details
        for key, value in details.items():
            setattr(self, key, value)

    def __repr__(self) -> str:  # pragma: no cover - debugging aid
        return f"TableError({self.code!r}, {str(self)!r}, {self.details!r})"


def require_columns(columns, wanted) -> None:
    available = set(columns)
    lacking = [name for name in wanted if name not in available]
    if lacking:
        raise TableError("COLUMN_NOT_FOUND", f"The table has no column {lacking[0]}.", column=lacking[0])


def require_distinct(names, code: str, what: str) -> None:
    """``names`` may not hold one of them twice."""
    for name, times in Counter(names).items():
        if times > 1:
            raise TableError(code, f"{what} {name} is given {times} times.", column=name)
