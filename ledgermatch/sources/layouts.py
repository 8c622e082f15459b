"""Layouts of the raw files: column headings, separators and encodings.

Fixed values: the headings are those the providers print.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ledgermatch.sources.readers import FileTag, read_banner_csv, read_text_csv


@dataclass(frozen=True)
class Layout:
    columns: tuple[str, ...]
    sep: str = ","
    encoding: str = "utf-8"
    #: the first line is a report banner
    banner: bool = False


_ACTIVITY = (
    "Date", "Time", "Time Zone", "Name", "Transaction ID", "Reference Txn ID", "Type", "Status",
    "Currency", "Gross", "Fee", "Net", "Invoice ID",
)

LAYOUTS = {
    "engine_log": Layout(
        (
            "txn_id", "order_id", "operation_type", "status", "psp", "psp_reference", "sku", "country", "currency",
            "amount_local", "fx_rate_applied", "fx_date_applied", "amount_usd", "created_at_utc", "captured_at_utc",
        )
    ),
    "adyen_accounting": Layout(
        (
            "Company Account", "Merchant Account", "Psp Reference", "Merchant Reference", "Record Type",
            "Creation Date", "TimeZone", "Gross Currency", "Gross Debit", "Gross Credit", "Commission", "Markup",
            "Net Currency", "Net Debit", "Net Credit", "Batch Number",
        )
    ),
    "dlocal_transactions": Layout(
        (
            "transaction_id", "invoice_id", "transaction_type", "status", "created_at_utc", "country", "currency",
            "currency_exponent", "local_amount", "fx_rate", "usd_amount", "fee_usd",
        )
    ),
    "paypal_us_activity": Layout(_ACTIVITY),
    "paypal_eu_activity": Layout(_ACTIVITY, sep=";", encoding="cp1252"),
    "google_play_earnings": Layout(
        (
            "Transaction Date", "Transaction Time", "Transaction Type", "Product ID", "Buyer Country",
            "Buyer Currency", "Amount (Buyer Currency)", "Currency Conversion Rate", "Merchant Currency",
            "Amount (Merchant Currency)",
        ),
        banner=True,
    ),
    "fx_rates": Layout(("rate_date", "currency", "usd_rate", "published_at")),
    "fee_schedule": Layout(("psp", "account", "valid_from", "percent_fee", "fixed_fee", "fixed_fee_currency")),
}


def read_raw(spark: SparkSession, layout: str, path: str | list[str]) -> DataFrame:
    """A raw file by the name of its layout, untouched and all text."""
    kind = LAYOUTS[layout]
    if kind.banner:
        return read_banner_csv(spark, path, kind.columns, sep=kind.sep)
    return read_text_csv(spark, path, kind.columns, sep=kind.sep, encoding=kind.encoding)


def read_folder(
    spark: SparkSession, layout: str, folder: str | list[str], tag: FileTag | None = None, banner: str | None = None
) -> DataFrame:
    """All files of a layout below a folder in one scan, each row tagged with its file.

    However many files there are, the plan has one reader; headers and banners go by file. ``banner`` is a pattern for
    the banner line; without one it is the first line of each file.
    """
    kind, tag = LAYOUTS[layout], tag or FileTag()
    if kind.banner:
        return read_banner_csv(spark, folder, kind.columns, sep=kind.sep, banner=banner, tag=tag)
    return read_text_csv(spark, folder, kind.columns, sep=kind.sep, encoding=kind.encoding, tag=tag)


def register(tables: dict[str, DataFrame], prefix: str = "") -> None:
    """Make tables available to SQL under their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{prefix}{name}")


