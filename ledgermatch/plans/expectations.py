"""Checks on the tables of a run. The closed lists the files are known to hold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ledgermatch.config import MatchConfig
from ledgermatch.operators import quality as Q
from ledgermatch.operators.observe import Rule, column_rules, row_rule
from ledgermatch.operators.rules import ENGINE, MATCHED_CAUSES, PROVIDER, WINNERS, text_list
from ledgermatch.sources.staging import COPY_KEYS

_OPERATIONS = ["SALE", "REFUND", "CHARGEBACK"]
_STATUSES = ["settled", "declined", "pending"]
_PSPS = ["adyen", "paypal_us", "paypal_eu", "dlocal", "google_play"]
_PRODUCTS = ["sub_monthly", "sub_quarterly", "sub_annual", "coach_addon"]
_CURRENCIES = ["EUR", "USD", "BRL", "GBP", "MXN", "CLP", "COP", "ARS"]
_FOREIGN = ["EUR", "GBP", "BRL", "MXN", "CLP", "COP", "ARS"]
_EVENTS = ["Authorised", "Settled", "Refused", "Refunded", "Chargeback"]


def _filled(*names: str) -> dict[str, Q.Column]:
    return {n: Q.Column(not_null=True) for n in names}


def _one_of(values: list, not_null: bool = True) -> Q.Column:
    return Q.Column(not_null=not_null, accepted=values)


def _where(condition: str) -> Q.Column:
    return Q.Column(not_null=True, where=condition)


_SETTLED_EVENT = "record_type = 'Settled'"

COLUMNS: dict[str, dict[str, Q.Column]] = {
    "engine_log": {
        **_filled(
            "txn_id", "order_id", "country", "amount_local", "fx_rate_applied", "fx_date_applied", "amount_usd",
            "signed_amount_usd", "created_at_utc",
        ),
        "operation_type": _one_of(_OPERATIONS),
        "status": _one_of(_STATUSES),
        "psp": _one_of(_PSPS),
        "psp_reference": _where("psp <> 'google_play'"),
        "sku": _one_of(_PRODUCTS),
        "currency": _one_of(_CURRENCIES),
        "captured_at_utc": _where("status = 'settled'"),
    },
    "paypal_us_activity": {
        **_filled("transaction_id", "invoice_id", "gross", "fee", "net", "txn_at_utc"),
        "reference_txn_id": _where("txn_type = 'Refund'"),
        "txn_type": _one_of(["Website Payment", "Refund"]),
        "status": _one_of(["Completed", "Denied", "Refunded"]),
        "currency": _one_of(["USD"]),
        "time_zone": _one_of(["GMT"], not_null=False),
        "dup_rank": _one_of([1, 2]),
    },
    "paypal_eu_activity": {
        **_filled("transaction_id", "invoice_id", "gross", "fee", "net", "txn_at_utc"),
        "reference_txn_id": _where("txn_type in ('Refund', 'Payment Reversal')"),
        "txn_type": _one_of(["Website Payment", "Refund", "Payment Reversal"]),
        "status": _one_of(["Completed", "Denied", "Refunded", "Reversed"]),
        "currency": _one_of(["EUR", "GBP"]),
        "time_zone": _one_of(["GMT"], not_null=False),
        "dup_rank": _one_of([1]),
    },
    "dlocal_transactions": {
        **_filled(
            "transaction_id", "invoice_id", "txn_at_utc", "country", "local_amount_minor", "amount_local",
            "fx_rate_local_per_usd", "usd_rate", "amount_usd", "fee_usd", "signed_amount_local", "signed_amount_usd",
        ),
        "transaction_type": _one_of(["PAYMENT", "REFUND"]),
        "status": _one_of(["PAID", "REJECTED", "IN_MEDIATION", "REFUNDED"]),
        "currency": _one_of(["ARS", "BRL", "CLP", "COP", "MXN"]),
        "currency_exponent": _one_of([0, 2]),
        "dup_rank": _one_of([1, 2]),
    },
    "adyen_accounting": {
        **_filled(
            "company_account", "merchant_account", "psp_reference", "merchant_reference", "event_at_utc",
            "signed_gross", "batch_number", "dup_rank",
        ),
        "record_type": _one_of(_EVENTS),
        "time_zone": _one_of(["Europe/Amsterdam"], not_null=False),
        "currency": _one_of(["EUR", "GBP", "USD"]),
        "gross_debit": _where("record_type in ('Refunded', 'Chargeback')"),
        "gross_credit": _where("record_type in ('Authorised', 'Settled', 'Refused')"),
        **{c: _where(_SETTLED_EVENT) for c in ("commission", "markup", "net_credit")},
    },
    "google_play_earnings": {
        **_filled(
            "source_file", "amount_buyer", "conversion_rate", "amount_usd", "txn_at_local", "txn_at_utc", "dup_rank"
        ),
        "txn_type": _one_of(["Charge", "Google fee", "Charge refund"]),
        "product_id": _one_of(_PRODUCTS),
        "buyer_country": _one_of(["US", "DE", "GB", "BR", "MX"]),
        "buyer_currency": _one_of(["USD", "EUR", "GBP", "BRL", "MXN"]),
        "merchant_currency": _one_of(["USD"]),
    },
    "fx_rates": {
        **_filled("rate_date", "usd_rate"),
        "currency": _one_of(_FOREIGN),
        "dup_rank": _one_of([1, 2]),
    },
    "fee_schedule": {**_filled("account", "percent_fee"), "psp": _one_of(["adyen", "google_play"])},
}

UNIQUE = {
    "engine_log": [["txn_id"], ["psp_reference"]],
    "paypal_eu_activity": [["transaction_id"]],
    "fee_schedule": [["account"]],
    **{layout: [[*keys, "dup_rank"]] for layout, (keys, _) in COPY_KEYS.items() if layout != "paypal_eu_activity"},
}


_AT = {"adyen_accounting": "event_at_utc"}
_EXPORTS = ("adyen_accounting", "dlocal_transactions", "google_play_earnings", "paypal_eu_activity", "paypal_us_activity")


def staging_rules(name: str, config: MatchConfig) -> list[Rule]:
    """Rules of the single rows of a staged table, counted while it is written."""
    rules = column_rules(COLUMNS[name])
    if name in _EXPORTS and config.export_window:
        rules.append(row_rule("inside export window", config.export_window.outside(_AT.get(name, "txn_at_utc")), Q.WARN))
    own = {
        "adyen_accounting": [
            row_rule("one side of gross filled", "(gross_debit is null) = (gross_credit is null)"),
            row_rule("net is gross less fee", f"{_SETTLED_EVENT} and not (gross_credit - commission - markup <=> net_credit)", Q.WARN),
        ],
        "dlocal_transactions": [
            row_rule("usd is local over rate", "abs(amount_usd - round(amount_local / fx_rate_local_per_usd, 2)) > 0.005", Q.WARN)
        ],
        "google_play_earnings": [
            row_rule("usd is buyer amount times rate", "abs(amount_usd - round(amount_buyer * conversion_rate, 2)) > 0.01", Q.WARN)
        ],
    }
    return rules + own.get(name, [])


def staging_checks(staged: Mapping[str, DataFrame]) -> list[Q.Check]:
    """Keys and references of the staged tables, which need a shuffle of their own."""
    checks = [
        Q.Check(f"{name} unique on {', '.join(keys)}", Q.not_unique(df, keys))
        for name, df in staged.items()
        for keys in UNIQUE.get(name, [])
    ]
    adyen, google, engine = staged["adyen_accounting"], staged["google_play_earnings"], staged["engine_log"]
    payment = "txn_type = 'Website Payment' and status = 'Completed'"
    refund = {"paypal_us_activity": "'Refund'", "paypal_eu_activity": "'Refund', 'Payment Reversal'"}
    us = staged["paypal_us_activity"].withColumnsRenamed({"transaction_id": "provider_ref", "txn_at_utc": "provider_at"})
    return [
        *checks,
        Q.Check("adyen one row per reference and type", Q.not_unique(adyen, COPY_KEYS["adyen_accounting"][0])),
        Q.Check("one rate per day and currency", Q.not_unique(staged["fx_rates"], ["rate_date", "currency"]), Q.WARN),
        Q.Check(
            "google charge has one fee line",
            Q.sales_without_one_fee_line(google, ["txn_at_utc", "product_id"], "txn_type", "Charge", "Google fee"),
            Q.WARN,
        ),
        Q.Check("reversal has a settled sale", Q.reversals_without_sale(engine)),
        *[
            Q.Check(
                f"{name} refund has a payment",
                Q.refunds_without_payment(
                    staged[name], reference="reference_txn_id", ref="transaction_id",
                    refund=f"txn_type in ({kinds})", payment=payment,
                ),
                Q.WARN,
            )
            for name, kinds in refund.items()
        ],
        Q.Check(
            "paypal time is engine capture time", Q.times_differ(us, engine.filter("psp = 'paypal_us'")), Q.WARN
        ),
    ]


_MONEY = ("engine_usd", "provider_usd", "diff_usd")
MATCHED_EQUAL = row_rule(
    "matched has zero difference", f"cause in ({text_list(MATCHED_CAUSES)}) and not (diff_usd <=> 0)"
)


def pair_rules(psp: str) -> list[Rule]:
    """Rules of the pairs of one provider."""
    known = {"psp": _one_of([psp]), **_filled(*_MONEY), "cause": _one_of(list(WINNERS))}
    return [*column_rules(known), MATCHED_EQUAL]


def pair_checks(pairs: Mapping[str, DataFrame]) -> list[Q.Check]:
    """An engine row stands in one pair where the key is composed."""
    composed = [psp for psp in ("adyen", "google_play") if psp in pairs]
    return [Q.Check(f"{psp} one pair per engine row", Q.fanned_out(pairs[psp])) for psp in composed]


#: money of both sides that the differences do not account for, over the whole table
RESIDUAL = "ifnull(sum(provider_usd), 0) - ifnull(sum(engine_usd), 0) - ifnull(sum(diff_usd), 0)"


def all_pairs_rules(psps: Sequence[str] = _PSPS) -> list[Rule]:
    known = {"psp": _one_of(list(psps)), **_filled("cause", *_MONEY), "cause_bucket": _one_of(["matched", "explained", "unexplained"])}
    return [
        *column_rules(known),
        Rule("residual is zero", f"int({RESIDUAL} <> 0)"),
        row_rule("every cause known", "cause_bucket = 'unexplained'", Q.WARN),
    ]


def restated_rules() -> list[Rule]:
    return column_rules(
        {
            **_filled("psp", "cause", "engine_usd", "provider_usd", "corrected_usd", "correction_usd"),
            "corrected_from": _one_of([ENGINE, PROVIDER]),
        }
    )


#: Not-null columns of the small marts; their rows are unique by the second list.
MARTS = {
    "summary_by_cause": (["psp", "cause", "row_count", "abs_usd", "signed_usd"], ["psp", "cause"]),
    "summary_by_psp": (["psp"], ["psp"]),
    "totals": (["psp"], ["psp"]),
    "restated_revenue": (["psp"], ["psp"]),
    "fees": (["psp"], ["psp", "account", "currency"]),
}


def mart_rules(name: str) -> list[Rule]:
    rules = column_rules(_filled(*MARTS[name][0])) if name in MARTS else []
    if name == "totals":
        rules.append(row_rule("residual_by_psp is zero", "not (residual <=> 0)"))
    if name == "summary_by_cause":
        rules.append(Rule("shares sum to 100", "int(count(*) > 0 and not ifnull(abs(sum(share_pct) - 100) <= 0.05, false))"))
    return rules


def mart_checks(marts: Mapping[str, DataFrame], revenue: DataFrame) -> list[Q.Check]:
    unique = [Q.Check(f"{name} unique on {', '.join(keys)}", Q.not_unique(marts[name], keys)) for name, (_, keys) in MARTS.items()]
    return [
        *unique,
        Q.Check("totals equal ledger revenue", Q.revenue_breaks(marts["totals"], revenue)),
        Q.Check("restatement ties", Q.restatement_breaks(marts["restated"], marts["restated_revenue"])),
    ]
