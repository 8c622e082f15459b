"""Data-quality checks: each is a frame of failing rows, empty when all is well."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.config import Period
from ledgermatch.functions.text import literal
from ledgermatch.operators.rules import MATCHED_CAUSES, SETTLED, text_list

ERROR, WARN = "error", "warn"


@dataclass(frozen=True)
class Check:
    name: str
    failing: DataFrame
    severity: str = ERROR


@dataclass(frozen=True)
class Column:
    """Rules of one column; ``where`` limits the not-null rule to some rows."""

    not_null: bool = False
    where: str | None = None
    accepted: Sequence[str | int] | None = None


def run_checks(checks: Sequence[Check]) -> DataFrame:
    """One row per check: (check, severity, failures, status)."""
    parts = [
        c.failing.agg(F.expr("count(*) as failures")).selectExpr(
            f"{literal(c.name)} as check", f"{literal(c.severity)} as severity", "failures",
            f"if(failures = 0, 'pass', '{c.severity}') as status",
        )
        for c in checks
    ]
    return reduce(DataFrame.unionAll, parts)


def column_checks(df: DataFrame, table: str, rules: Mapping[str, Column]) -> DataFrame:
    """Not-null and accepted-value failures of all columns, counted in one pass over the table."""
    counted = []
    for name, rule in rules.items():
        if rule.not_null:
            only = f" and ({rule.where})" if rule.where else ""
            counted.append((name, "not_null", f"`{name}` is null{only}"))
        if rule.accepted is not None:
            closed = ", ".join(literal(v) for v in rule.accepted)
            counted.append((name, "accepted_values", f"`{name}` not in ({closed})"))
    totals = df.agg(*[F.expr(f"count_if({fails}) as f{i}") for i, (_, _, fails) in enumerate(counted)])
    rows = ", ".join(f"struct('{name}' as column_name, '{kind}' as check, f{i} as failures)"
                     for i, (name, kind, _) in enumerate(counted))
    return totals.selectExpr(f"{literal(table)} as table_name", f"inline(array({rows}))")


def not_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with more than one row; keys with a null part are not compared."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.expr("count(*) as n")).filter("n > 1")


def matched_with_difference(pairs: DataFrame) -> DataFrame:
    return pairs.filter(f"cause in ({text_list(MATCHED_CAUSES)}) and not (diff_usd <=> 0)")


def fanned_out(pairs: DataFrame) -> DataFrame:
    """Engine rows that stand in more than one pair."""
    return not_unique(pairs.select("txn_id"), ["txn_id"])


def outside_window(df: DataFrame, at: str, window: Period) -> DataFrame:
    return df.filter(window.outside(at))


def net_differs(df: DataFrame, gross: str, fees: Sequence[str], net: str) -> DataFrame:
    """Rows whose net is not gross less fees; the difference is in ``gap``."""
    gap = " - ".join([gross, *fees, net])
    return df.selectExpr("*", f"{gap} as gap").filter("not (gap <=> 0)")


def not_one_side(df: DataFrame, debit: str, credit: str) -> DataFrame:
    """Rows with both or none of a debit / credit pair filled."""
    return df.filter(f"({debit} is null) = ({credit} is null)")


def conversion_differs(df: DataFrame, expected: str, usd: str, tolerance: str) -> DataFrame:
    """Rows whose base-currency amount is further than the tolerance from the recomputed one."""
    rows = df.selectExpr("*", f"round({expected}, 2) as expected_usd")
    return rows.filter(f"abs({usd} - expected_usd) > {tolerance}")


def reversals_without_sale(ledger: DataFrame) -> DataFrame:
    """Refunds and chargebacks whose order has no settled sale."""
    sales = ledger.filter(f"operation_type = 'SALE' and status = '{SETTLED}'").select("order_id").distinct()
    return ledger.filter("operation_type <> 'SALE'").join(sales, "order_id", "left_anti")


def refunds_without_payment(
    rows: DataFrame, *, reference: str, ref: str, refund: str, payment: str
) -> DataFrame:
    """Refund rows whose reference is no payment of the same export.

    ``refund`` and ``payment`` are conditions; ``reference`` points from a refund to a payment's ``ref``.
    """
    paid = rows.filter(payment).selectExpr(f"{ref} as paid_ref").distinct()
    return rows.filter(refund).join(paid, F.expr(f"{reference} = paid_ref"), "left_anti")


def sales_without_one_fee_line(rows: DataFrame, keys: Sequence[str], kind: str, sale: str, fee: str) -> DataFrame:
    """Keys whose numbers of sales and fee lines differ, in both directions, counted in one pass."""
    counted = rows.filter(f"{kind} in ('{sale}', '{fee}')").groupBy(*keys).agg(
        F.expr(f"count_if({kind} = '{sale}') as n_charge"), F.expr(f"count_if({kind} = '{fee}') as n_fee")
    )
    return counted.filter("n_charge <> n_fee")


def times_differ(provider: DataFrame, engine: DataFrame) -> DataFrame:
    """Settled engine rows whose provider row of the same id has another time than the capture."""
    settled = engine.filter(f"status = '{SETTLED}'").select("psp_reference", "captured_at_utc").distinct()
    same = provider.join(settled, F.expr("provider_ref = psp_reference"))
    return same.filter("provider_at <> captured_at_utc").select("provider_ref", "provider_at", "captured_at_utc")


def residual_left(totals: DataFrame) -> DataFrame:
    return totals.filter("not (residual <=> 0)")


def shares_off(summary: DataFrame, tolerance: str = "0.05") -> DataFrame:
    """One row when the shares do not add up to 100."""
    return summary.agg(F.expr("sum(share_pct) as total_share")).filter(f"not ifnull(abs(total_share - 100) <= {tolerance}, false)")


def restatement_breaks(restated: DataFrame, revenue: DataFrame) -> DataFrame:
    """Providers whose restated revenue does not tie to the rows behind it.

    Restated = booked + corrections, and restated less reported = the rows where the engine stands.
    """
    engine_right = (
        restated.filter("corrected_from = 'engine'")
        .groupBy("psp")
        .agg(F.expr("cast(sum(engine_usd - provider_usd) as decimal(38,2)) as engine_right_gap"))
    )
    joined = revenue.filter("psp <> 'total'").join(engine_right, "psp", "left")
    return joined.filter(
        "not (corrected_usd <=> engine_usd + correction_usd) or not (corrected_minus_provider <=> ifnull(engine_right_gap, 0))"
    )


def revenue_breaks(totals: DataFrame, revenue: DataFrame) -> DataFrame:
    """Providers whose totals differ from revenue computed without any pairing."""
    other = revenue.withColumnsRenamed({"engine_usd": "ledger_engine_usd", "provider_usd": "ledger_provider_usd"})
    joined = totals.filter("psp <> 'total'").join(other, "psp", "full")
    differ = "not (engine_usd <=> ledger_engine_usd) or not (provider_usd <=> ledger_provider_usd)"
    return joined.filter(differ).select(
        "psp", "engine_usd", "ledger_engine_usd", "provider_usd", "ledger_provider_usd"
    )
