"""Fees charged by the providers against the contracts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.functions.money import MONEY, PERCENT, TOTAL, percent_of
from ledgermatch.operators.asof import attach_interval

#: a fee further than this from the contract is off it
TOLERANCE = "0.01"


@dataclass(frozen=True)
class FeeSource:
    """Fee-bearing rows of one provider; amounts stay in the currency they were charged in.

    ``gross`` and ``fee`` are SQL text over ``rows``. ``account`` and ``currency`` are SQL text too,
    a column that is grouped by or a constant. ``declined`` marks attempts that failed and still cost a fee.
    ``at`` dates a row; the contract in force on that day applies.
    """

    psp: str
    rows: DataFrame
    gross: str
    fee: str
    account: str = "cast(null as string)"
    currency: str = "'USD'"
    by: tuple[str, ...] = ()
    declined: str | None = None
    at: str = "to_date(provider_at)"


def check_fees(sources: Sequence[FeeSource], schedule: DataFrame) -> DataFrame:
    """One row per provider, account and currency; contract columns are null without a contract.

    Every row is compared with the contract that was in force on its day. ``contract_pct`` shows the one in force at the last row.
    A provider that is not grouped has a row even if it charged nothing.
    """
    rows = reduce(DataFrame.unionByName, [_rows(source) for source in sources])
    charged = attach_interval(rows, schedule, ["psp", "account"], "at", "valid_from", ["percent_fee"]).selectExpr(
        "*", "round(gross * (percent_fee * 0.01), 2) as due"
    )
    lines = charged.groupBy("psp", "account", "currency").agg(
        F.expr("count_if(not declined) as row_count"),
        F.expr("sum(if(declined, null, gross)) as gross"),
        F.expr("sum(if(declined, null, fee)) as fee_actual"),
        F.expr("max_by(percent_fee, if(percent_fee is null, null, at)) as contract_pct"),
        F.expr("sum(if(declined, null, due)) as fee_contract"),
        # null and not zero without a contract: nothing was compared
        F.expr(
            f"if(max(percent_fee) is null, null, count_if(not declined and abs(fee - due) > {TOLERANCE}))"
            " as rows_off_contract"
        ),
        F.expr("if(max(may_decline), sum(if(declined, fee, null)), 0) as fee_on_declined"),
    )
    fee = "cast(fee_actual as decimal(38,2))"
    return lines.selectExpr(
        "psp", "account", "currency", "row_count", f"cast(gross as {TOTAL}) as gross",
        f"{fee} as fee_actual", f"{percent_of('fee_actual', 'gross')} as fee_actual_pct",
        f"cast(contract_pct as {PERCENT}) as contract_pct", f"cast(fee_contract as {TOTAL}) as fee_contract",
        f"cast({fee} - fee_contract as {TOTAL}) as fee_gap", "rows_off_contract",
        f"cast(fee_on_declined as {TOTAL}) as fee_on_declined",
    ).orderBy("psp", F.asc_nulls_last("account"), F.asc_nulls_last("currency"))


def _rows(source: FeeSource) -> DataFrame:
    """The fee-bearing rows of all providers look alike, so that one join prices all of them."""
    may_decline = "true" if source.declined else "false"
    rows = source.rows.selectExpr(
        f"'{source.psp}' as psp", f"{source.account} as account", f"{source.currency} as currency", f"{source.at} as at",
        f"cast({source.gross} as {MONEY}) as gross", f"cast({source.fee} as {MONEY}) as fee",
        f"{source.declined or 'false'} as declined", f"{may_decline} as may_decline",
    )
    if source.by:
        return rows
    nothing = [f"cast(null as {kind}) as {name}" for name, kind in rows.dtypes if name in ("at", "gross", "fee", "declined")]
    return rows.unionByName(
        rows.sparkSession.range(1).selectExpr(
            f"'{source.psp}' as psp", f"{source.account} as account", f"{source.currency} as currency",
            f"{may_decline} as may_decline", *nothing,
        )
    )
