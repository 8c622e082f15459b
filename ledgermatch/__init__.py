"""Spark-native matching of two ledgers and attribution of their differences."""

from ledgermatch.config import MatchConfig, Period

__all__ = ["MatchConfig", "Period"]
