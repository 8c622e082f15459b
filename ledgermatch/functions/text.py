"""Values as Spark SQL text."""

from __future__ import annotations


def literal(value: object) -> str:
    """A value as SQL: text quoted and escaped, anything else as it prints."""
    if not isinstance(value, str):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
