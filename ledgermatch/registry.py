"""Every operator as a query over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermatch.fixtures import PROFILES, Recipe
from ledgermatch.functions import money, times
from ledgermatch.operators import observe, ordinal, profiling, quality, sketches, skew, stats
from ledgermatch.operators.asof import attach_interval, attach_rate, rate_book, spread_interval
from ledgermatch.operators.dedup import dup_rank, first_rate
from ledgermatch.plans import descriptions, expectations, marts, profiles, reports
from ledgermatch.plans.fees import FeeSource, check_fees
from ledgermatch.sources import layouts, readers, sinks, staging

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


@lru_cache(maxsize=4)
def recipe(spark: SparkSession, sf_dir: str) -> Recipe:
    """Plans and checked sizes of one data folder; no rows are kept but the small rate table."""
    return Recipe(spark, sf_dir)


def query(build: Callable[[Recipe], DataFrame]) -> Query:
    QUERIES[build.__name__] = lambda spark, sf_dir: build(recipe(spark, sf_dir))
    return QUERIES[build.__name__]


# rates, ranks and signs ------------------------------------------------------------------------


@query
def fx_asof_valuation(r: Recipe) -> DataFrame:
    rows = attach_rate(r.provider("id_fx"), r.book, "provider_currency", "to_date(provider_at)")
    return rows.selectExpr(
        "provider_ref", "provider_at", "provider_currency", "provider_amount", "fx_date", "fx_rate",
        f"{money.valued('provider_amount', 'fx_rate')} as amount_usd",
    )


@query
def fx_asof_base_bypass(r: Recipe) -> DataFrame:
    events = r.provider("journal").filter("provider_type <> 'Authorised'")
    rows = attach_rate(events, r.book, "provider_currency", "to_date(provider_at)", base="USD")
    return rows.selectExpr(
        "provider_ref", "provider_type", "provider_at", "provider_currency", "provider_amount", "provider_fee",
        "fx_date", "fx_rate", f"{money.valued('provider_amount', 'fx_rate')} as amount_usd",
        f"{money.valued('provider_fee', 'fx_rate')} as fee_usd",
    )


@query
def dup_rank_(r: Recipe) -> DataFrame:
    rows = r.provider("id_base").select("provider_ref", "provider_at", "provider_status", "provider_amount")
    return dup_rank(rows, ["provider_ref"], hot_rows=r.config.hot_rows)


QUERIES["dup_rank"] = QUERIES.pop("dup_rank_")


@query
def signed_amounts(r: Recipe) -> DataFrame:
    """The sign from the operation type on one side, from debit and credit columns on the other."""
    engine = r.engine("journal").selectExpr(
        "txn_id as ref", "operation_type as kind", "amount_usd as amount",
        f"{money.signed('amount_usd', 'operation_type = ' + repr(profiles.SALE))} as signed", f"{money.ZERO} as fee",
    )
    columns = r.provider("journal").filter("provider_type <> 'Authorised'").selectExpr(
        "provider_ref", "provider_type", "abs(provider_amount) as amount",
        "if(provider_amount >= 0, provider_amount, null) as credit",
        "if(provider_amount < 0, -provider_amount, null) as debit",
        "if(provider_fee <> 0, provider_fee, null) as commission", "cast(null as decimal(18,2)) as markup",
    )
    return engine.unionAll(
        columns.selectExpr(
            "provider_ref", "provider_type", "amount", money.credit_less_debit("credit", "debit"),
            money.fee_total("commission", "markup"),
        )
    )


# raw text to typed rows ------------------------------------------------------------------------


@query
def staged_decimal_comma(r: Recipe) -> DataFrame:
    rows = staging.staged("paypal_eu_activity", r.raw_text("paypal_eu_activity"), r.config.hot_rows)
    return rows.select(
        "transaction_id", "invoice_id", "txn_type", "status", "currency", "gross", "fee", "net", "txn_at_utc", "dup_rank"
    )


@query
def staged_minor_units(r: Recipe) -> DataFrame:
    rows = staging.staged("dlocal_transactions", r.raw_text("dlocal_transactions"), r.config.hot_rows)
    return rows.select(
        "transaction_id", "txn_at_utc", "currency_exponent", "local_amount_minor", "amount_local", "usd_rate",
        "amount_usd", "signed_amount_local", "signed_amount_usd", "dup_rank",
    )


@query
def staged_zone_column(r: Recipe) -> DataFrame:
    rows = staging.staged("adyen_accounting", r.raw_text("adyen_accounting"), r.config.hot_rows)
    return rows.select(
        "psp_reference", "record_type", "event_at_utc", "event_at_local", "time_zone", "gross_debit", "gross_credit",
        "signed_gross", "fee", "batch_number", "dup_rank",
    )


@query
def staged_fixed_zone(r: Recipe) -> DataFrame:
    rows = staging.staged("google_play_earnings", r.raw_text("google_play_earnings"), r.config.hot_rows)
    return rows.select(
        "source_file", "txn_type", "product_id", "amount_buyer", "conversion_rate", "amount_usd", "txn_at_local",
        "txn_at_utc", "dup_rank",
    )


# pairs and marts -------------------------------------------------------------------------------


def _pairs_query(name: str) -> Query:
    return lambda spark, sf_dir: recipe(spark, sf_dir).pairs(name)


QUERIES.update({f"pairs_{name}": _pairs_query(name) for name in PROFILES})


def _all_pairs(r: Recipe) -> DataFrame:
    return marts.all_pairs(r.all_pairs().values())


def _restated(r: Recipe) -> DataFrame:
    return marts.restate(_all_pairs(r))


@query
def causes_id_fx(r: Recipe) -> DataFrame:
    return marts.by_cause_money(r.pairs("id_fx"), "cause")


@query
def causes_by_psp(r: Recipe) -> DataFrame:
    return marts.by_cause_money(_all_pairs(r), "psp", "cause")


@query
def pairs_all(r: Recipe) -> DataFrame:
    return _all_pairs(r)


@query
def summary_by_cause(r: Recipe) -> DataFrame:
    return marts.by_cause(_all_pairs(r))


@query
def summary_by_psp(r: Recipe) -> DataFrame:
    return marts.by_psp(_all_pairs(r))


@query
def totals_identity(r: Recipe) -> DataFrame:
    return marts.totals(_all_pairs(r))


@query
def restatement(r: Recipe) -> DataFrame:
    return _restated(r)


@query
def restated_revenue(r: Recipe) -> DataFrame:
    return marts.restated_revenue(_restated(r))


@query
def fee_check(r: Recipe) -> DataFrame:
    sale = r.profile("keyless").keyless[0]
    held = r.config.period.holds("provider_at")
    paid = f"provider_type = 'Website Payment' and provider_status = 'Completed' and {held}"
    own = r.provider("id_own").filter(f"provider_status in ('Completed', 'Denied') and {held}")
    return check_fees(
        [
            FeeSource("id_base", r.provider("id_base").filter(paid), "own_usd", "provider_fee"),
            FeeSource(
                "id_fx", r.provider("id_fx").filter(paid), "provider_amount", "provider_fee",
                currency="provider_currency", by=("currency",),
            ),
            FeeSource("id_own", own, "own_usd", "provider_fee_usd", declined="provider_status = 'Denied'"),
            FeeSource(
                "journal", r.provider("journal").filter(f"provider_type = 'Settled' and {held}"),
                "provider_amount", "provider_fee", "account", "provider_currency", ("account", "currency"),
            ),
            FeeSource(
                "keyless", r.pairs("keyless").filter(f"provider_type = '{sale}' and provider_in_period"),
                "provider_usd", "provider_fee_usd", "'account_main'",
            ),
        ],
        r.schedule,
    )


@query
def fee_percent_by_account(r: Recipe) -> DataFrame:
    settled = r.provider("journal").filter(f"provider_type = 'Settled' and {r.config.period.holds('provider_at')}")
    return reports.fee_percent(settled, "provider_amount", "provider_fee", "2.5", "account", "provider_currency")


# profiles and statistics -----------------------------------------------------------------------


def _table(r: Recipe, name: str) -> DataFrame:
    return r.spark.read.parquet(f"{r.sf_dir}/{name}.parquet")


@query
def profile_columns(r: Recipe) -> DataFrame:
    tables = {name: _table(r, name) for name in ("orders", "lineitem", "customer", "events")}
    # two engines estimate differently, so the estimate is checked and not compared
    return profiling.column_stats(tables).selectExpr(
        "* except (distinct_approx)", "abs(distinct_approx - distinct_exact) <= 0.25 * distinct_exact as approx_ok"
    )


@query
def profile_values(r: Recipe) -> DataFrame:
    return profiling.value_counts(
        {
            "orders": (_table(r, "orders"), ["o_orderstatus", "o_orderpriority"]),
            "lineitem": (_table(r, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]),
            "events": (_table(r, "events"), ["event_type"]),
            "customer": (_table(r, "customer"), ["c_mktsegment", "c_nationkey"]),
            "documents": (_table(r, "documents"), ["lang", "source"]),
        }
    )


@query
def profile_duplicates(r: Recipe) -> DataFrame:
    return profiling.repeated_keys(
        {
            "id_base": (r.provider("id_base"), ["provider_ref"]),
            "rates": (r.rates, ["rate_date", "currency"]),
            "lineitem": (_table(r, "lineitem"), ["l_orderkey", "l_linenumber"]),
            "documents": (_table(r, "documents"), ["text"]),
        }
    )


@query
def describe_table(r: Recipe) -> DataFrame:
    described = profiling.describe_columns(_table(r, "orders"))
    shown = "array_join(transform(top_values, t -> t.value || '=' || t.n), ', ') as top_values"
    return described.selectExpr(
        "column_name", "data_type", "nulls", "distinct_values", shown, "samples[0] as smallest", "samples[1] as largest"
    )


@query
def capture_delay_stats(r: Recipe) -> DataFrame:
    sales = r.engine_all().filter("status = 'settled' and operation_type = 'SALE'")
    delay = times.seconds_between("created_at_utc", "captured_at_utc")
    return stats.spread_of(sales.selectExpr("psp", f"{delay} as delay"), ["psp"], "delay")


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    figures = [c for c in df.columns if c not in keys and c != "count"]
    return df.selectExpr(*keys, *(["count"] if "count" in df.columns else []), *[f"round({c}, 4) as {c}" for c in figures])


@query
def describe_by_group(r: Recipe) -> DataFrame:
    rows = _table(r, "orders").selectExpr("o_orderpriority", "o_totalprice as price")
    return _rounded(stats.describe(rows, ["o_orderpriority"], "price"), "o_orderpriority")


@query
def sales_by_psp(r: Recipe) -> DataFrame:
    held = r.config.period.holds("captured_at_utc")
    sales = r.engine_all().filter(f"status = 'settled' and operation_type = 'SALE' and {held}")
    return _rounded(stats.describe(sales.select("psp", "amount_usd"), ["psp"], "amount_usd"), "psp")


@query
def quantiles_overall(r: Recipe) -> DataFrame:
    rows = _table(r, "lineitem").select("l_extendedprice")
    return _rounded(stats.quantiles(rows, [], "l_extendedprice", {"p01": 0.01, "p50": 0.5, "p99": 0.99}))


@query
def revenue_share(r: Recipe) -> DataFrame:
    return reports.revenue_share(r.engine_all(), r.config)


_SALE_ROWS = {
    "id_base": "provider_type = 'Website Payment'",
    "id_fx": "provider_type = 'Website Payment'",
    "id_own": "provider_status = 'Completed'",
    "journal": "provider_type = 'Settled'",
    "keyless": "provider_type = 'Charge'",
}


@query
def provider_net(r: Recipe) -> DataFrame:
    parts = [
        reports.provider_net(r.provider(name), r.profile(name), r.config, r.book, sale)
        for name, sale in _SALE_ROWS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


# data quality ----------------------------------------------------------------------------------


def _ledgers(r: Recipe) -> dict:
    return {name: (r.engine(name), r.provider(name), r.profile(name)) for name in PROFILES}


@query
def ledger_revenue(r: Recipe) -> DataFrame:
    return reports.ledger_revenue(_ledgers(r), r.config, r.book)


@query
def dq_not_null(r: Recipe) -> DataFrame:
    always = quality.Column(not_null=True)
    columns = {c: always for c in ("txn_id", "order_id", "currency", "amount_usd", "fx_rate_applied", "psp_reference")}
    columns["captured_at_utc"] = quality.Column(not_null=True, where="operation_type = 'SALE' and psp <> 'id_base'")
    return quality.column_checks(r.engine_all(), "engine", columns)


@query
def dq_accepted(r: Recipe) -> DataFrame:
    statuses = {"provider_status": quality.Column(accepted=["Completed", "Denied"])}
    lines = {
        "l_returnflag": quality.Column(accepted=["A", "N"]),
        "l_linenumber": quality.Column(accepted=[1, 2, 3]),
        "l_linestatus": quality.Column(not_null=True, accepted=["F", "O"]),
    }
    return quality.column_checks(r.provider("id_base"), "id_base", statuses).unionByName(
        quality.column_checks(_table(r, "lineitem"), "lineitem", lines)
    )


@query
def dq_unique(r: Recipe) -> DataFrame:
    copies = quality.not_unique(r.provider("id_base"), ["provider_ref"])
    ids = quality.not_unique(r.engine("id_base"), ["psp_reference"])
    return copies.selectExpr("'provider_ref' as key", "provider_ref as value", "n").unionAll(
        ids.selectExpr("'psp_reference'", "psp_reference", "n")
    )


@query
def dq_fanout(r: Recipe) -> DataFrame:
    parts = [quality.fanned_out(pairs).selectExpr(f"'{name}' as psp", "txn_id", "n") for name, pairs in r.all_pairs().items()]
    return reduce(DataFrame.unionByName, parts)


@query
def dq_orphan_reversals(r: Recipe) -> DataFrame:
    """Engine refunds without a settled sale, provider refunds whose sale the export does not show."""
    engine = quality.reversals_without_sale(r.engine("journal")).selectExpr("'engine' as side", "txn_id as ref")
    events = r.provider("journal")
    provider = quality.refunds_without_payment(
        events, reference="provider_ref", ref="provider_ref",
        refund="provider_type = 'Refunded'", payment="provider_type = 'Settled'",
    )
    return engine.unionAll(provider.selectExpr("'provider'", "provider_ref"))


@query
def dq_fee_lines(r: Recipe) -> DataFrame:
    sale, _, fee = r.profile("keyless").keyless
    keys = ["provider_at", "product_id"]
    return quality.sales_without_one_fee_line(r.provider("keyless"), keys, "provider_type", sale, fee)


@query
def dq_window(r: Recipe) -> DataFrame:
    late = quality.outside_window(r.provider("journal"), "provider_at", r.config.export_window)
    return late.select("provider_ref", "provider_type", "provider_at")


@query
def dq_arithmetic(r: Recipe) -> DataFrame:
    """Own conversions away from the reference rate, and settled rows whose net is not gross less fee."""
    own = attach_rate(r.provider("id_own"), r.book, "provider_currency", "to_date(provider_at)")
    converted = quality.conversion_differs(own, "provider_amount * fx_rate", "own_usd", "0.005")
    settled = r.provider("journal").filter("provider_type = 'Settled'").selectExpr(
        "*", "cast(provider_amount - round(provider_amount * 0.025, 2) as decimal(18,2)) as net"
    )
    nets = quality.net_differs(settled, "provider_amount", ["provider_fee"], "net")
    kept = "cast({} as decimal(18,2)) as figure"
    return converted.selectExpr("'usd' as rule", "provider_ref", kept.format("expected_usd")).unionAll(
        nets.selectExpr("'net'", "provider_ref", kept.format("gap"))
    )


@query
def dq_times(r: Recipe) -> DataFrame:
    return quality.times_differ(r.provider("id_base"), r.engine("id_base"))


@query
def dq_tie_out(r: Recipe) -> DataFrame:
    """The accounting identities and the structural checks, one row per check.

    Six checks read the pairs, so they are written once and not matched six times.
    """
    pairs = skew.checkpoint(_all_pairs(r))
    totals, restated = marts.totals(pairs), marts.restate(pairs)
    ranked = dup_rank(r.provider("id_base").select("provider_ref", "provider_at"), ["provider_ref"], hot_rows=r.config.hot_rows)
    sides = r.provider("journal").selectExpr(
        "if(provider_amount >= 0, provider_amount, null) as credit", "if(provider_amount < 0, provider_amount, null) as debit"
    )
    revenue = reports.ledger_revenue(_ledgers(r), r.config, r.book)
    return quality.run_checks(
        [
            quality.Check("matched_has_zero_diff", quality.matched_with_difference(pairs)),
            quality.Check("residual_is_zero", quality.residual_left(totals)),
            quality.Check("shares_sum_to_100", quality.shares_off(marts.by_cause(pairs))),
            quality.Check("totals_match_ledgers", quality.revenue_breaks(totals, revenue)),
            quality.Check(
                "restatement_ties", quality.restatement_breaks(restated, marts.restated_revenue(restated))
            ),
            quality.Check("rank_is_unique", quality.not_unique(ranked, ["provider_ref", "dup_rank"])),
            quality.Check("one_rate_per_day", quality.not_unique(r.rates, ["currency", "rate_date"]), quality.WARN),
            quality.Check("one_side_of_gross", quality.not_one_side(sides, "debit", "credit")),
            quality.Check("copies_in_export", quality.not_unique(r.provider("id_fx"), ["provider_ref"]), quality.WARN),
        ]
    )


# a run's own checks, tables and order -----------------------------------------------------------


@query
def dq_observed(r: Recipe) -> DataFrame:
    """Column rules, pair rules and a figure of the whole table, each table passed once."""
    always = quality.Column(not_null=True)
    engine = {c: always for c in ("txn_id", "order_id", "currency", "amount_usd", "fx_rate_applied", "psp_reference")}
    engine["operation_type"] = quality.Column(not_null=True, accepted=["SALE"])
    export = {"provider_status": quality.Column(accepted=["Completed", "Denied"]), "own_usd": always}
    return observe.count_now(
        r.spark,
        {
            "engine": (r.engine_all(), observe.column_rules(engine)),
            "id_own": (r.provider("id_own"), observe.column_rules(export)),
            "pairs": (_all_pairs(r), expectations.all_pairs_rules(PROFILES)),
            "unpriced": (_unpriced(r), expectations.all_pairs_rules(PROFILES)),
        },
    )


def _unpriced(r: Recipe) -> DataFrame:
    """Pairs of the foreign-currency export when one currency has no rates."""
    book = rate_book(r.rates.filter("currency <> 'BRL'"), broadcast_rows=r.config.broadcast_rows)
    sides = r.engine("id_fx"), r.provider("id_fx"), r.profile("id_fx")
    return marts.all_pairs([profiles.match(*sides, r.config, book, r.heavy("id_fx")["id_fx"])])


@query
def dq_unpriced(r: Recipe) -> DataFrame:
    return marts.by_cause_money(_unpriced(r), "cause_bucket", "cause")


@query
def totals_unpriced(r: Recipe) -> DataFrame:
    return marts.totals(_unpriced(r))


@query
def contract_in_force(r: Recipe) -> DataFrame:
    """The contract of every journal row, by the merge that needs no day grid and no broadcast."""
    rows = r.provider("journal").filter("provider_type = 'Settled'").selectExpr("'journal' as psp", "account", "provider_ref", "to_date(provider_at) as on_day")
    return spread_interval(rows, r.schedule, ["psp", "account"], "on_day", "valid_from", ["percent_fee"])


@query
def order_status_in_force(r: Recipe) -> DataFrame:
    """Line items with the customer's last order on or before the ship day: many keys, many starts, one interval each."""
    orders = _table(r, "orders").selectExpr("o_custkey as cust", "to_date(o_orderdate) as since", "o_orderkey as last_order", "o_orderpriority as priority")
    lines = _table(r, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_suppkey as cust", "to_date(l_shipdate) as shipped")
    return attach_interval(lines, orders, ["cust"], "shipped", "since", ["last_order", "priority"], broadcast_rows=1000)


def _catalog(r: Recipe, tables: tuple[str, ...]) -> list[str]:
    """The given files as catalog tables; files and rows stay where they are."""
    r.spark.sql("create database if not exists ledgermatch_files")
    names = [f"ledgermatch_files.{t}" for t in tables]
    for table, name in zip(tables, names, strict=True):
        path = f"{r.sf_dir}/{table}.parquet"
        sinks.register(r.spark.read.parquet(path), name, path, f"The table {table}, as given.", {_FIRST[table]: "Key of the table."})
    return names


_FIRST = {"orders": "o_orderkey", "lineitem": "l_orderkey", "customer": "c_custkey", "events": "event_id", "documents": "doc_id", "labels": "doc_id"}


@query
def catalog_listing(r: Recipe) -> DataFrame:
    listed = sinks.catalog_listing(r.spark, _catalog(r, tuple(_FIRST)))
    return listed.selectExpr("table_name", "kind", "place", "column_name", "table_comment", "column_comment", "row_count", "bytes > 0 as has_size")


@query
def described_marts(r: Recipe) -> DataFrame:
    """Marts written, entered in the catalog with their descriptions, and read back from there."""
    folder = f"{skew.shared_folder(r.spark)}/marts-{uuid.uuid4().hex}"
    r.spark.sql("create database if not exists ledgermatch_marts")
    pairs = skew.checkpoint(_all_pairs(r))
    restated = marts.restate(pairs)
    for name, df in {"totals": marts.totals(pairs), "summary_by_cause": marts.by_cause(pairs), "restated": restated}.items():
        written = sinks.write_table(df, f"{folder}/{name}")
        told = {c: text for c, text in descriptions.COLUMNS[name].items() if c in written.columns}
        sinks.register(written, f"ledgermatch_marts.{name}", f"{folder}/{name}", descriptions.TABLES[name], told)
    listed = sinks.catalog_listing(r.spark, [f"ledgermatch_marts.{n}" for n in ("totals", "summary_by_cause", "restated")])
    return listed.selectExpr("table_name", "column_name", "place", "row_count", "table_comment is not null as described", "column_comment is not null as column_described")


@query
def pairs_ordered(r: Recipe) -> DataFrame:
    """Every pair with its place when the largest differences come first."""
    pairs = _all_pairs(r).select("psp", "txn_id", "provider_ref", "provider_at", "provider_type", "cause", "diff_usd")
    order = "psp, magnitude desc, txn_id nulls last, provider_ref nulls last, provider_at nulls last, provider_type nulls last, cause, diff_usd"
    return ordinal.ordinal(pairs.selectExpr("*", "abs(diff_usd) as magnitude"), order, "place").drop("magnitude")


@query
def summary_by_psp_ordered(r: Recipe) -> DataFrame:
    rows = marts.by_psp(_all_pairs(r)).selectExpr("*", "psp = 'total' as is_total")
    return ordinal.ordinal(rows, "is_total, abs_usd desc, psp", "place", unique=True).drop("is_total")


@query
def sampled_rows(r: Recipe) -> DataFrame:
    return ordinal.sample_rows(_table(r, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), 100, ["o_orderkey"])


# profiles that grow -------------------------------------------------------------------------------


@query
def profile_incremental(r: Recipe) -> DataFrame:
    """Sketches kept by month; merged they say what one sketch of the whole table says, within the error of a sketch."""
    orders = _table(r, "orders")
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]
    by_month = sketches.column_sketches(orders, "date_format(o_orderdate, 'yyyy-MM')", columns)
    kept = sinks.write_table(by_month, f"{skew.shared_folder(r.spark)}/sketches-{uuid.uuid4().hex}")
    merged = sketches.merged_profile(kept)
    whole = sketches.merged_profile(sketches.column_sketches(orders, "'all'", columns)).withColumnRenamed("distinct_approx", "whole")
    exact = profiling.count_values(orders, columns).groupBy("column_name").agg(F.expr("count(value) as distinct_exact"))
    rows = merged.join(whole.select("column_name", "whole"), "column_name").join(exact, "column_name")
    return rows.selectExpr(
        "column_name", "row_count", "nulls", "distinct_exact", "abs(distinct_approx - whole) <= 0.05 * distinct_exact as near_whole",
        "abs(distinct_approx - distinct_exact) <= 0.05 * distinct_exact as within_bound",
    )


_FREQUENT = {"lineitem": ["l_partkey", "l_shipdate"], "orders": ["o_custkey", "o_orderpriority"], "events": ["event_type"], "documents": ["text", "source"]}


@query
def profile_top_values(r: Recipe) -> DataFrame:
    parts = [
        sketches.top_values(_table(r, table), column, 10).selectExpr(
            f"'{table}' as table_name", f"'{column}' as column_name", "sha2(cast(cast(value as string) as binary), 256) as value", "n"
        )
        for table, columns in _FREQUENT.items()
        for column in columns
        if not (table == "lineitem" and column == "l_shipdate")
    ]
    return reduce(DataFrame.unionAll, parts)


# files and laid-out ledgers -----------------------------------------------------------------------


@query
def stacked_files(r: Recipe) -> DataFrame:
    """Monthly exports with a banner, written as text and read back in one scan, each row tagged with its month."""
    kind = layouts.LAYOUTS["google_play_earnings"]
    month = "date_format(to_date(`Transaction Date`, 'MMM d, yyyy'), 'yyyyMM') as month"
    cells = ", ".join(f"`{c}`" for c in kind.columns)
    lines = r.raw_text("google_play_earnings").selectExpr(month, f"to_csv(struct({cells}), map('escape', '\"')) as line")
    header = ",".join(kind.columns).replace("'", "\\'")
    tops = lines.select("month").distinct().selectExpr("month", f"explode(array('Earnings report, all products', '{header}')) as line")
    folder = f"{skew.shared_folder(r.spark)}/exports-{uuid.uuid4().hex}"
    lines.unionByName(tops).repartition("month").write.partitionBy("month").text(folder)
    tag = readers.FileTag("source_file", r"/month=([0-9]+)/")
    rows = layouts.read_folder(r.spark, "google_play_earnings", folder, tag, banner="^Earnings report")
    typed = staging.google_play_earnings(rows)
    return typed.select("source_file", "txn_type", "product_id", "amount_buyer", "conversion_rate", "amount_usd", "txn_at_utc")


@query
def pairs_laid_out(r: Recipe) -> DataFrame:
    """Pairs from two sides that were written in buckets by their pair key: nothing but their own files is read, nothing is shuffled."""
    return profiles.paired(*laid_out(r, "id_base"), r.profile("id_base"), r.config, r.heavy("id_base")["id_base"])


def laid_out(r: Recipe, name: str, buckets: int = 16) -> list[DataFrame]:
    r.spark.sql("create database if not exists ledgermatch_sides")
    sides = profiles.prepared(r.engine(name), r.provider(name), r.profile(name), r.config, r.book, r.heavy(name)[name])
    keys = profiles.spread_keys(r.profile(name).keys)
    folder = f"{skew.shared_folder(r.spark)}/sides-{uuid.uuid4().hex}"
    tables = []
    for side, df in zip(("engine", "provider"), sides, strict=True):
        table = f"ledgermatch_sides.{name}_{side}"
        r.spark.sql(f"drop table if exists {table}")
        tables.append(sinks.write_buckets(df, table, f"{folder}/{side}", keys, buckets))
    return tables


# rules that have to fail ---------------------------------------------------------------------------


def _rates_twice(r: Recipe) -> DataFrame:
    """Rates of which some days have a second one, published earlier or later than the first."""
    rates = r.rates.selectExpr("rate_date", "currency", "usd_rate", "2 as published", "datediff(rate_date, date'1990-01-01') as n")
    second = rates.filter("n % 5 = 0").selectExpr(
        "rate_date", "currency", f"cast(usd_rate + if(n % 2 = 0, 0.01, -0.01) as {money.RATE})", "if(n % 3 = 0, 1, 3)", "n"
    )
    return rates.unionAll(second)


@query
def fx_first_rate(r: Recipe) -> DataFrame:
    """Of two rates of a day, the lowest and the one published first."""
    rates = _rates_twice(r)
    lowest = first_rate(rates).withColumnRenamed("usd_rate", "lowest")
    return lowest.join(first_rate(rates, prefer="published").withColumnRenamed("usd_rate", "published_first"), ["currency", "rate_date"])


@query
def dq_planted(r: Recipe) -> DataFrame:
    """Structural checks on rows with planted defects: keys that repeat, both sides filled, wrong conversions."""
    k = "cast(substring(provider_ref, 2) as bigint)"
    journal = r.provider("journal").selectExpr(
        "*", f"if(provider_amount >= 0 and {k} % 281 <> 0, provider_amount, null) as credit",
        f"if(provider_amount < 0 or {k} % 283 = 0, abs(provider_amount), null) as debit",
    )
    own = r.provider("id_own").filter("own_rate is not null").selectExpr(
        "provider_amount", f"cast(1 / own_rate as {money.RATE}) as local_per_usd",
        f"cast(provider_amount / cast(1 / own_rate as {money.RATE}) + if({k} % 293 = 0, 0.02, 0) as {money.MONEY}) as usd",
    )
    return quality.run_checks(
        [
            quality.Check("one_row_per_reference_and_type", quality.not_unique(r.provider("journal").unionByName(r.provider("journal").filter(f"{k} % 277 = 0")), ["provider_ref", "provider_type"])),
            quality.Check("one_rate_per_day", quality.not_unique(_rates_twice(r), ["currency", "rate_date"]), quality.WARN),
            quality.Check("one_side_of_gross", quality.not_one_side(journal, "debit", "credit")),
            quality.Check("usd_is_local_over_rate", quality.conversion_differs(own, "provider_amount / local_per_usd", "usd", "0.005"), quality.WARN),
        ]
    )
