"""Run parameters shared by the plans."""

from __future__ import annotations

from dataclasses import dataclass


#: rows of one key that a task can rank and pair in seconds
HOT_ROWS = 200_000


@dataclass(frozen=True)
class Period:
    """Half-open time interval ``[start, end)`` given as ISO text."""

    start: str
    end: str

    def holds(self, at: str) -> str:
        """SQL text: true / false for a dated row, null for an undated one."""
        return f"({at} >= timestamp_ntz'{self.start}' and {at} < timestamp_ntz'{self.end}')"

    def outside(self, at: str) -> str:
        return f"({at} < timestamp_ntz'{self.start}' or {at} >= timestamp_ntz'{self.end}')"


@dataclass(frozen=True)
class MatchConfig:
    period: Period
    export_window: Period | None = None
    base_currency: str = "USD"
    #: an engine rate older than this many days before the event is an error
    stale_days: int = 3
    #: a key with at least this many rows leaves the plain window / join route
    hot_rows: int = HOT_ROWS
    #: a dimension is broadcast only when its checked row count stays below this
    broadcast_rows: int = 1_000_000
