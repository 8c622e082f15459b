"""The whole run: raw files to pairs, marts, profiles, checks and exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermatch.config import MatchConfig
from ledgermatch.functions import times
from ledgermatch.operators import profiling, quality, stats
from ledgermatch.operators.asof import rate_book
from ledgermatch.operators.observe import Rule, Watch, report, stop_on_errors
from ledgermatch.plans import expectations, marts, reports
from ledgermatch.plans import profiles as P
from ledgermatch.plans.descriptions import COLUMNS, TABLES
from ledgermatch.plans.fees import FeeSource, check_fees
from ledgermatch.plans.providers import LAYOUT_OF, PROFILES, provider_rows
from ledgermatch.sources import sinks
from ledgermatch.sources.layouts import read_raw
from ledgermatch.sources.readers import stack_files
from ledgermatch.sources.staging import COPY_KEYS, TYPED, staged

# The columns whose values are counted, and the keys looked for twice, by raw table.
VALUE_COLUMNS = {
    "engine_log": ["operation_type", "status", "psp", "sku", "currency", "country"],
    "adyen_accounting": ["Record Type", "Merchant Account", "Gross Currency", "Net Currency", "Batch Number"],
    "dlocal_transactions": ["transaction_type", "status", "country", "currency", "currency_exponent"],
    "paypal_us_activity": ["Type", "Status", "Currency"],
    "paypal_eu_activity": ["Type", "Status", "Currency"],
    "google_play_earnings": ["Transaction Type", "Product ID", "Buyer Country", "Buyer Currency", "Merchant Currency"],
    "fx_rates": ["currency"],
    "fee_schedule": ["psp", "account", "percent_fee"],
}
#: What counts as a sale in each export.
SALE_ROWS = {
    "paypal_us": "provider_type = 'Website Payment'",
    "paypal_eu": "provider_type = 'Website Payment'",
    "dlocal": "provider_status = 'PAID'",
    "adyen": "provider_type = 'Settled'",
    "google_play": "provider_type = 'Charge'",
}
REPEATED = {
    "dlocal_transactions": ["transaction_id"],
    "paypal_us_activity": ["Transaction ID"],
    "fx_rates": ["rate_date", "currency"],
}


@dataclass(frozen=True)
class Run:
    raw: dict[str, DataFrame]
    staged: dict[str, DataFrame]
    pairs: dict[str, DataFrame]
    all_pairs: DataFrame
    marts: dict[str, DataFrame]
    reports: dict[str, DataFrame]
    analysis: dict[str, DataFrame]
    checks: DataFrame
    column_checks: DataFrame


def read_all(spark: SparkSession, files: Mapping[str, str | Mapping[str, str]]) -> dict[str, DataFrame]:
    """Raw tables by layout. A layout given as {file tag: path} is stacked with its tags."""
    raw = {}
    for layout, path in files.items():
        if isinstance(path, str):
            raw[layout] = read_raw(spark, layout, path)
        else:
            raw[layout] = stack_files({tag: read_raw(spark, layout, one) for tag, one in path.items()})
    return raw


def fee_sources(typed: Mapping[str, DataFrame], google_pairs: DataFrame, config: MatchConfig, google_account: str):
    held = config.period.holds("provider_at")
    rows = {psp: provider_rows(psp, typed[LAYOUT_OF[psp]]).filter(held) for psp in PROFILES if psp != "google_play"}
    paid = "provider_type = 'Website Payment' and provider_status = 'Completed'"
    return [
        FeeSource(
            "adyen", rows["adyen"].filter("provider_type = 'Settled'"), "provider_amount", "provider_fee",
            "account", "provider_currency", ("account", "currency"),
        ),
        FeeSource(
            "google_play", google_pairs.filter("provider_type = 'Charge' and provider_in_period"),
            "provider_usd", "provider_fee_usd", f"'{google_account}'",
        ),
        FeeSource("paypal_us", rows["paypal_us"].filter(paid), "provider_amount", "provider_fee"),
        FeeSource(
            "paypal_eu", rows["paypal_eu"].filter(paid), "provider_amount", "provider_fee",
            currency="provider_currency", by=("currency",),
        ),
        FeeSource(
            "dlocal", rows["dlocal"].filter("provider_status in ('PAID', 'REJECTED')"), "own_usd", "provider_fee_usd",
            declined="provider_status = 'REJECTED'",
        ),
    ]


class _Publisher:
    """Writes tables below a folder; each is watched while it is written and gets its descriptions in the catalog."""

    def __init__(self, spark: SparkSession, out: str, database: str | None):
        self.spark, self.out, self.database = spark, out, database
        self.results: list[tuple[str, str, str, int, str]] = []
        if database:
            spark.sql(f"create database if not exists {database}")

    def write(
        self, layer: str, name: str, df: DataFrame, rules: Sequence[Rule] = (), kind: str | None = None, by: tuple[str, ...] = ()
    ) -> DataFrame:
        path = f"{self.out}/{layer}/{name}"
        watch = Watch(name, rules)
        written = sinks.write_table(watch.on(df) if rules else df, path, by)
        if rules:
            self.results += watch.results()
        if self.database:
            kind = kind or name
            told = {c: text for c, text in COLUMNS.get(kind, {}).items() if c in written.columns}
            sinks.register(written, f"{self.database}.{layer}_{name}", path, TABLES.get(kind, ""), told, by)
        return written

    def check(self, checks: Sequence[quality.Check]) -> None:
        """Checks that need a shuffle of their own; the driver receives one row a check."""
        self.results += [("", r.check, r.severity, r.failures, r.status) for r in quality.run_checks(checks).collect()]

    def gate(self, stop: bool) -> None:
        if stop:
            stop_on_errors(self.results)

    def report(self) -> DataFrame:
        rows = report(self.spark, self.results)
        return rows.selectExpr("trim(table_name || ' ' || check) as check", "severity", "failures", "status")

    def column_report(self) -> DataFrame:
        """Not-null and closed-list failures of the staged columns."""
        rows = report(self.spark, [r for r in self.results if r[0] in TYPED])
        parted = rows.selectExpr("table_name", "split(check, ' ') as parts", "failures")
        return parted.filter("parts[1] in ('not_null', 'accepted_values') and size(parts) = 2").selectExpr(
            "table_name", "parts[0] as column_name", "parts[1] as check", "failures"
        )


def run(
    spark: SparkSession,
    files: Mapping[str, str | Mapping[str, str]],
    out: str,
    config: MatchConfig,
    *,
    google_account: str,
    prefer_rate: str | None = None,
    database: str | None = None,
    stop: bool = True,
) -> Run:
    """Build everything under ``out``, a folder all executors share.

    Pairs are matched once and written; every mart, check and export reads the written pairs.
    ``prefer_rate`` picks among several rates of a day by a column in place of the lowest rate.

    Rules of rows and of whole tables are counted by the job that writes a table. After the staged tables, after the pairs and
    at the end a failed check of severity ``error`` stops the run with ``ChecksFailed``, before anything is built on bad rows;
    with ``stop=False`` it is only reported. ``database`` names where the written tables are entered with their descriptions.
    """
    to = _Publisher(spark, out, database)
    # text files are parsed once; the engine log is laid out by provider, so a slice reads its own files
    by = {"engine_log": ("psp",)}
    raw = {layout: to.write("raw", layout, df, kind="raw", by=by.get(layout, ())) for layout, df in read_all(spark, files).items()}
    typed = {
        layout: to.write(
            "staged", layout, staged(layout, df, config.hot_rows), expectations.staging_rules(layout, config), "staged", by.get(layout, ())
        )
        for layout, df in raw.items()
    }
    to.check(expectations.staging_checks(typed))
    to.gate(stop)

    book = rate_book(typed["fx_rates"].drop("dup_rank"), prefer=prefer_rate, broadcast_rows=config.broadcast_rows)
    ledgers = {
        psp: (typed["engine_log"], provider_rows(psp, typed[LAYOUT_OF[psp]]), profile)
        for psp, profile in PROFILES.items()
    }
    pairs = {
        psp: to.write("pairs", psp, df, expectations.pair_rules(psp), "pairs")
        for psp, df in P.match_all(ledgers, config, book).items()
    }
    all_pairs = to.write("marts", "all_pairs", marts.all_pairs(pairs.values()), expectations.all_pairs_rules())
    to.check(expectations.pair_checks(pairs))
    to.gate(stop)

    restated = to.write("marts", "restated", marts.restate(all_pairs), expectations.restated_rules())
    fees = check_fees(fee_sources(typed, pairs["google_play"], config, google_account), typed["fee_schedule"])
    small = {
        "summary_by_cause": marts.by_cause(all_pairs),
        "summary_by_psp": marts.by_psp(all_pairs),
        "totals": marts.totals(all_pairs),
        "restated_revenue": marts.restated_revenue(restated),
        "fees": fees,
    }
    built = {name: _in_order(to.write("marts", name, df, expectations.mart_rules(name)), name) for name, df in small.items()}
    built["restated"] = restated
    shown = {name: to.write("reports", name, df) for name, df in _reports(typed, ledgers, config, book).items()}
    analysis = {
        "columns": profiling.column_stats(raw),
        "values": profiling.value_counts({name: (raw[name], columns) for name, columns in VALUE_COLUMNS.items()}),
        "duplicates": profiling.repeated_keys({name: (raw[name], keys) for name, keys in REPEATED.items()}),
    }
    analysis = {name: to.write("analysis", name, df) for name, df in analysis.items()}
    to.check(expectations.mart_checks(built, reports.ledger_revenue(ledgers, config, book)))
    checks = to.write("marts", "checks", to.report())
    sinks.export_all(built, f"{out}/csv/marts")
    sinks.export_all(analysis, f"{out}/csv/analysis")
    sinks.export_all(shown, f"{out}/tsv/reports", sep="\t")
    book.close()
    to.gate(stop)
    return Run(raw, typed, pairs, all_pairs, built, shown, analysis, checks, to.column_report())


#: Order of the small marts; a total row stands last.
_ORDER = {
    "summary_by_cause": ("psp", "abs_usd desc", "cause"),
    "summary_by_psp": ("psp = 'total'", "abs_usd desc"),
    "totals": ("psp = 'total'", "psp"),
    "restated_revenue": ("psp = 'total'", "psp"),
    "fees": ("psp", "account nulls last", "currency nulls last"),
}


def _in_order(written: DataFrame, name: str) -> DataFrame:
    """Rows of a written table in the order of their mart: a few rows, so a sort costs nothing."""
    keys = []
    for term in _ORDER[name]:
        column, _, how = term.partition(" ") if "=" not in term else (term, "", "")
        keys.append({"desc": F.expr(column).desc(), "nulls last": F.expr(column).asc_nulls_last()}.get(how, F.expr(column).asc()))
    return written.orderBy(*keys)


def _reports(typed: Mapping[str, DataFrame], ledgers: P.Ledgers, config: MatchConfig, book) -> dict[str, DataFrame]:
    """One-sided reports, from the ledger or the exports alone."""
    engine = typed["engine_log"]
    net = [reports.provider_net(rows, profile, config, book, SALE_ROWS[psp]) for psp, (_, rows, profile) in ledgers.items()]
    adyen = ledgers["adyen"][1].filter(f"provider_type = 'Settled' and {config.period.holds('provider_at')}")
    sales = engine.filter("status = 'settled' and operation_type = 'SALE'")
    delay = times.seconds_between("created_at_utc", "captured_at_utc")
    return {
        "revenue_share": reports.revenue_share(engine, config),
        "provider_net": reduce(DataFrame.unionByName, net),
        "fee_percent": reports.fee_percent(adyen, "provider_amount", "provider_fee", "2.5", "account", "provider_currency"),
        "capture_delay": stats.spread_of(sales.selectExpr("psp", f"{delay} as delay"), ["psp"], "delay"),
    }
