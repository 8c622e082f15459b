"""Checks that are counted by the job which writes a table, and a gate that stops a run when one of them fails.

A check of single rows, or a figure of a whole table, needs no scan of its own: an ``Observation`` counts while the rows pass by
on their way into the files.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgermatch.functions.text import literal
from ledgermatch.operators.quality import ERROR, Column

COLUMNS = "table_name string, check string, severity string, failures bigint, status string"


class ChecksFailed(RuntimeError):
    """A run was stopped; ``failures`` holds (table, check, number of failures)."""

    def __init__(self, failures: Sequence[tuple[str, str, int]]):
        self.failures = list(failures)
        super().__init__("; ".join(f"{table}: {check} ({n})" for table, check, n in failures))


@dataclass(frozen=True)
class Rule:
    """``counts`` is an aggregate as SQL text: the number of failures in the table."""

    name: str
    counts: str
    severity: str = ERROR


def row_rule(name: str, fails: str, severity: str = ERROR) -> Rule:
    """A rule of single rows; ``fails`` is the condition that bad rows meet."""
    return Rule(name, f"count_if({fails})", severity)


def column_rules(rules: Mapping[str, Column]) -> list[Rule]:
    """Not-null and closed-list rules of columns, named ``column rule``."""
    out = []
    for name, rule in rules.items():
        if rule.not_null:
            only = f" and ({rule.where})" if rule.where else ""
            out.append(row_rule(f"{name} not_null", f"`{name}` is null{only}"))
        if rule.accepted is not None:
            closed = ", ".join(literal(v) for v in rule.accepted)
            out.append(row_rule(f"{name} accepted_values", f"`{name}` not in ({closed})"))
    return out


@dataclass
class Watch:
    """The rules of one table, counted once by whatever action reads ``on(df)`` first."""

    table: str
    rules: Sequence[Rule]
    observation: Observation = field(default_factory=Observation)

    def on(self, df: DataFrame) -> DataFrame:
        """Put this last, right before the write: its tasks are counted once each, also when an executor is lost."""
        counted = [F.expr(f"cast({rule.counts} as bigint)").alias(f"f{i}") for i, rule in enumerate(self.rules)]
        return df.observe(self.observation, F.count(F.lit(1)).alias("rows"), *counted)

    def results(self) -> list[tuple[str, str, str, int, str]]:
        """(table, check, severity, failures, status) per rule, after the write; a table that was never planned has no failures."""
        seen = self.observation.get
        found = [(rule, seen.get(f"f{i}") or 0) for i, rule in enumerate(self.rules)]
        return [(self.table, r.name, r.severity, n, "pass" if n == 0 else r.severity) for r, n in found]


def gate(watches: Iterable[Watch]) -> list[tuple[str, str, str, int, str]]:
    """The results of all watches; raises ``ChecksFailed`` if one of severity ``error`` failed."""
    results = [row for watch in watches for row in watch.results()]
    stop_on_errors(results)
    return results


def stop_on_errors(results: Iterable[tuple[str, str, str, int, str]]) -> None:
    broken = [(table, check, n) for table, check, severity, n, _ in results if n and severity == ERROR]
    if broken:
        raise ChecksFailed(broken)


def report(spark: SparkSession, results: Sequence[tuple[str, str, str, int, str]]) -> DataFrame:
    """The results as a frame, one row per rule."""
    return spark.createDataFrame(list(results), COLUMNS)


def count_now(spark: SparkSession, tables: Mapping[str, tuple[DataFrame, Sequence[Rule]]]) -> DataFrame:
    """All rules of every table in one pass over each, for tables that are not about to be written."""
    results = []
    for name, (df, rules) in tables.items():
        watch = Watch(name, rules)
        watch.on(df).write.format("noop").mode("overwrite").save()
        results += watch.results()
    return report(spark, results)
