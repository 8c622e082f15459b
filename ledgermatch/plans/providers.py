"""Typed provider exports as the provider rows the profiles read."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgermatch.functions.money import MONEY, cast
from ledgermatch.plans import profiles as P

PROFILES = {
    "paypal_us": P.id_base("paypal_us"),
    "paypal_eu": P.id_fx("paypal_eu"),
    "dlocal": P.id_own("dlocal"),
    "adyen": P.journal("adyen"),
    "google_play": P.keyless("google_play"),
}
LAYOUT_OF = {
    "paypal_us": "paypal_us_activity",
    "paypal_eu": "paypal_eu_activity",
    "dlocal": "dlocal_transactions",
    "adyen": "adyen_accounting",
    "google_play": "google_play_earnings",
}
_ACTIVITY = {
    "provider_ref": "transaction_id",
    "provider_order": "invoice_id",
    "provider_type": "txn_type",
    "provider_status": "status",
    "provider_at": "txn_at_utc",
    "provider_currency": "currency",
    "provider_amount": "gross",
    # printed as a negative amount
    "provider_fee": cast("-fee", MONEY),
}
_COLUMNS = {
    "paypal_us": {**_ACTIVITY, "own_usd": "gross"},
    "paypal_eu": _ACTIVITY,
    "dlocal": {
        "provider_ref": "transaction_id",
        "provider_order": "invoice_id",
        "provider_type": "transaction_type",
        "provider_status": "status",
        "provider_at": "txn_at_utc",
        "provider_currency": "currency",
        "provider_amount": "signed_amount_local",
        "own_usd": "signed_amount_usd",
        "own_rate": "usd_rate",
        "provider_fee_usd": "fee_usd",
    },
    "adyen": {
        "provider_ref": "psp_reference",
        "provider_order": "merchant_reference",
        "provider_type": "record_type",
        "provider_status": "record_type",
        "provider_at": "event_at_utc",
        "provider_currency": "currency",
        "provider_amount": "signed_gross",
        "provider_fee": "fee",
        "account": "merchant_account",
    },
    "google_play": {
        "provider_type": "txn_type",
        "provider_status": "txn_type",
        "provider_at": "txn_at_utc",
        "provider_currency": "buyer_currency",
        "provider_amount": "amount_buyer",
        "own_usd": "amount_usd",
        "own_rate": "conversion_rate",
        "product_id": "product_id",
        "source_file": "source_file",
        "buyer_country": "buyer_country",
    },
}


def provider_rows(psp: str, typed: DataFrame) -> DataFrame:
    given = _COLUMNS[psp]
    return typed.selectExpr(*[f"{given.get(c, f'cast(null as {t})')} as {c}" for c, t in P.PROVIDER_COLUMNS.items()])
