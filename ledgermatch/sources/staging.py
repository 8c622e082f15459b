"""Raw text to typed rows: one row per export line, nothing dropped, times in UTC, amounts signed.

Each function types one layout; ``staged`` also ranks the copies of a row. A text that does not fit
its type raises in ANSI mode. ``try_types`` turns that into null plus a list, to put such rows aside.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from ledgermatch.config import HOT_ROWS
from ledgermatch.functions import money, times
from ledgermatch.functions.money import MONEY, PERCENT, RATE, cast
from ledgermatch.operators.dedup import dup_rank

NTZ = "timestamp_ntz"


def _typed(raw: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    return raw.selectExpr(*[f"{sql} as `{name}`" for name, sql in columns.items()])


def _same(*names: str) -> dict[str, str]:
    return {n: f"`{n}`" for n in names}


def try_types(raw: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast the columns, null where the text does not fit, and list the misfits in ``bad_columns``."""
    bad = ", ".join(f"if(`{c}` is not null and try_cast(`{c}` as {t}) is null, '{c}', null)" for c, t in types.items())
    kept = [f"try_cast(`{c}` as {types[c]}) as `{c}`" if c in types else f"`{c}`" for c in raw.columns]
    return raw.selectExpr(*kept, f"filter(array({bad}), c -> c is not null) as bad_columns")


def engine_log(raw: DataFrame) -> DataFrame:
    usd = cast("amount_usd", MONEY)
    return _typed(
        raw,
        {
            **_same(
                "txn_id", "order_id", "operation_type", "status", "psp", "psp_reference", "sku", "country", "currency"
            ),
            "amount_local": cast("amount_local", MONEY),
            "fx_rate_applied": cast("fx_rate_applied", RATE),
            "fx_date_applied": cast("fx_date_applied", "date"),
            "amount_usd": usd,
            "signed_amount_usd": money.signed(usd, "operation_type = 'SALE'"),
            "created_at_utc": cast("created_at_utc", NTZ),
            "captured_at_utc": cast("captured_at_utc", NTZ),
        },
    )


def adyen_accounting(raw: DataFrame) -> DataFrame:
    """One row per event; local times carry their zone in a column."""
    local = cast("`Creation Date`", NTZ)
    debit, credit = cast("`Gross Debit`", MONEY), cast("`Gross Credit`", MONEY)
    commission, markup = cast("Commission", MONEY), cast("Markup", MONEY)
    return _typed(
        raw,
        {
            "company_account": "`Company Account`",
            "merchant_account": "`Merchant Account`",
            "psp_reference": "`Psp Reference`",
            "merchant_reference": "`Merchant Reference`",
            "record_type": "`Record Type`",
            "event_at_utc": times.to_utc(local, "TimeZone"),
            "event_at_local": local,
            "time_zone": "TimeZone",
            "currency": "`Gross Currency`",
            "gross_debit": debit,
            "gross_credit": credit,
            "commission": commission,
            "markup": markup,
            "net_currency": "`Net Currency`",
            "net_debit": cast("`Net Debit`", MONEY),
            "net_credit": cast("`Net Credit`", MONEY),
            "batch_number": cast("`Batch Number`", "int"),
            "signed_gross": money.credit_less_debit(credit, debit),
            "fee": money.fee_total(commission, markup),
        },
    )


def dlocal_transactions(raw: DataFrame) -> DataFrame:
    """Minor units to amounts, the rate turned to base currency per local unit, refunds negative."""
    exponent = cast("currency_exponent", "int")
    local = money.from_minor_units(cast("local_amount", "decimal(18,2)"), exponent)
    usd, rate, paid = cast("usd_amount", MONEY), cast("fx_rate", RATE), "transaction_type <> 'REFUND'"
    return _typed(
        raw,
        {
            **_same("transaction_id", "invoice_id", "transaction_type", "status"),
            "txn_at_utc": cast("created_at_utc", NTZ),
            **_same("country", "currency"),
            "currency_exponent": exponent,
            "local_amount_minor": cast("local_amount", "bigint"),
            "amount_local": local,
            "fx_rate_local_per_usd": rate,
            "usd_rate": money.invert_rate(rate),
            "amount_usd": usd,
            "fee_usd": cast("fee_usd", MONEY),
            "signed_amount_local": money.signed(local, paid),
            "signed_amount_usd": money.signed(usd, paid),
        },
    )


def _activity(raw: DataFrame, date_format: str, number: Callable[[str], str]) -> DataFrame:
    return _typed(
        raw,
        {
            "transaction_id": "`Transaction ID`",
            "reference_txn_id": "`Reference Txn ID`",
            "invoice_id": "`Invoice ID`",
            "txn_type": "`Type`",
            "status": "`Status`",
            "currency": "`Currency`",
            **{c.lower(): cast(number(c), MONEY) for c in ("Gross", "Fee", "Net")},
            "txn_at_utc": times.wall_clock("`Date`", "`Time`", date_format),
            "time_zone": "`Time Zone`",
            "customer_name": "`Name`",
        },
    )


def paypal_us_activity(raw: DataFrame) -> DataFrame:
    return _activity(raw, "MM/dd/yyyy", lambda c: c)


def paypal_eu_activity(raw: DataFrame) -> DataFrame:
    return _activity(raw, "dd/MM/yyyy", money.decimal_comma)


def google_play_earnings(stacked: DataFrame) -> DataFrame:
    """Monthly files stacked with their names in ``source_file``; times are Los Angeles time."""
    local = times.wall_clock("`Transaction Date`", "`Transaction Time`", "MMM d, yyyy")
    return _typed(
        stacked,
        {
            "source_file": "source_file",
            "txn_type": "`Transaction Type`",
            "product_id": "`Product ID`",
            "buyer_country": "`Buyer Country`",
            "buyer_currency": "`Buyer Currency`",
            "amount_buyer": cast("`Amount (Buyer Currency)`", MONEY),
            "conversion_rate": cast("`Currency Conversion Rate`", RATE),
            "merchant_currency": "`Merchant Currency`",
            "amount_usd": cast("`Amount (Merchant Currency)`", MONEY),
            "txn_at_local": local,
            "txn_at_utc": times.to_utc(local, "'America/Los_Angeles'"),
        },
    )


def fx_rates(raw: DataFrame) -> DataFrame:
    return _typed(
        raw,
        {
            "currency": "currency",
            "rate_date": cast("rate_date", "date"),
            "usd_rate": cast("usd_rate", RATE),
            "published_at": "published_at",
        },
    )


def fee_schedule(raw: DataFrame) -> DataFrame:
    return _typed(
        raw,
        {
            **_same("psp", "account"),
            "valid_from": cast("valid_from", "date"),
            "percent_fee": cast("percent_fee", PERCENT),
            "fixed_fee": cast("fixed_fee", MONEY),
            "fixed_fee_currency": "fixed_fee_currency",
        },
    )


TYPED = {
    "engine_log": engine_log,
    "adyen_accounting": adyen_accounting,
    "dlocal_transactions": dlocal_transactions,
    "paypal_us_activity": paypal_us_activity,
    "paypal_eu_activity": paypal_eu_activity,
    "google_play_earnings": google_play_earnings,
    "fx_rates": fx_rates,
    "fee_schedule": fee_schedule,
}
#: copies of a row share these; the second list orders them
COPY_KEYS = {
    "adyen_accounting": (["psp_reference", "record_type"], ["event_at_utc"]),
    "dlocal_transactions": (["transaction_id"], []),
    "paypal_us_activity": (["transaction_id"], []),
    "paypal_eu_activity": (["transaction_id"], []),
    "google_play_earnings": (["txn_at_utc", "product_id", "txn_type"], ["amount_usd"]),
    "fx_rates": (["currency", "rate_date"], ["usd_rate"]),
}


def staged(layout: str, raw: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The typed table of a layout with the rank of each copy, where the layout has copies."""
    typed = TYPED[layout](raw)
    if layout not in COPY_KEYS:
        return typed
    keys, order = COPY_KEYS[layout]
    return dup_rank(typed, keys, order, hot_rows=hot_rows)
