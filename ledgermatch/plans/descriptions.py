"""What the tables of a run and their columns hold; kept beside the files as catalog comments."""

from __future__ import annotations

_PAIR = {
    "psp": "Provider.",
    "txn_id": "Ledger transaction; null if only the provider has the row.",
    "order_id": "Order of the ledger row.",
    "operation_type": "Sale, refund or chargeback, as booked.",
    "currency": "Currency of the amounts.",
    "engine_usd": "Ledger money in base currency, signed; zero unless settled in the period, and for a surplus copy.",
    "provider_usd": "Provider money in base currency, signed; null if no rate is known.",
    "diff_usd": "Provider money less ledger money.",
    "cause": "The first rule that holds for the pair.",
}

TABLES: dict[str, str] = {
    "raw": "A file as it was delivered, every column text.",
    "staged": "A typed file; dup_rank counts the copies of a line.",
    "pairs": "Ledger rows and provider rows of one provider, paired, with the cause of every difference.",
    "all_pairs": "The pairs of all providers with common columns and the bucket of each cause.",
    "restated": "Each pair with the figure that stands.",
    "summary_by_cause": "Differences by provider and cause.",
    "summary_by_psp": "Differences by provider, with a total row.",
    "totals": "Money on both sides, its difference by bucket, and the residual, which must be zero.",
    "restated_revenue": "Revenue as booked, as restated and as reported, with a total row.",
    "fees": "Fees charged against the contracts in force.",
    "revenue_share": "Sales, reversals and net revenue by provider, from the ledger alone.",
    "provider_net": "Sales, reversals and net money by provider, from the exports alone.",
    "fee_percent": "Effective fee percent by account.",
    "capture_delay": "Seconds between creation and capture by provider.",
    "checks": "Every check of the run with its failures.",
    "columns": "Rows, nulls and distinct values of every raw column.",
    "values": "Values of columns with closed lists and how often they occur.",
    "duplicates": "Keys that occur more than once.",
}

COLUMNS: dict[str, dict[str, str]] = {
    "staged": {
        "dup_rank": "1 for the first copy of a line, 2 for the second, and so on.",
        "txn_at_utc": "Time of the event in UTC.",
        "event_at_utc": "Time of the event in UTC.",
        "signed_amount_usd": "Amount in base currency, negative for money that goes back.",
        "usd_rate": "Base currency per unit of the currency.",
    },
    "pairs": _PAIR,
    "all_pairs": {**_PAIR, "provider_ref": "The provider's id, or time and product where it gives none.", "cause_bucket": "matched, explained or unexplained."},
    "restated": {
        **_PAIR,
        "corrected_from": "The side whose figure stands.",
        "corrected_usd": "The figure that stands.",
        "correction_usd": "The figure that stands less the ledger's.",
    },
    "summary_by_cause": {
        "row_count": "Pairs.", "abs_usd": "Sum of absolute differences.", "signed_usd": "Sum of differences.",
        "share_pct": "Part of all absolute differences, in percent.", "share_in_psp_pct": "Part of the provider's absolute differences, in percent.",
    },
    "totals": {"residual": "What the buckets leave of the difference of both sides.", "unpriced_rows": "Pairs whose money has no rate."},
    "fees": {
        "contract_pct": "Contract in force at the last row; null without a contract.", "fee_gap": "Charged less due.",
        "rows_off_contract": "Rows more than a cent off.", "fee_on_declined": "Fees on attempts that failed.",
    },
    "checks": {"failures": "Failing rows or keys.", "status": "pass, warn or error."},
}
