"""The whole run on a small month of raw files with one of each difference."""

from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from june import June

from ledgermatch import MatchConfig, Period
from ledgermatch.operators import observe
from ledgermatch.operators.observe import ChecksFailed
from ledgermatch.operators.rules import WINNERS
from ledgermatch.plans import full_run
from ledgermatch.sources import sinks

CONFIG = MatchConfig(Period("2026-06-01", "2026-07-01"), Period("2026-06-01", "2026-07-04"))


@pytest.fixture(scope="module")
def june():
    return June()


@pytest.fixture(scope="module")
def result(spark, june, tmp_path_factory):
    folder = tmp_path_factory.mktemp("june")
    files = june.write(folder)
    run = full_run.run(spark, files, str(folder / "out"), CONFIG, google_account="account_main", database="june_run")
    yield run, folder
    spark.sql("drop database june_run cascade")


def test_each_pair_has_its_cause_and_difference(june, result):
    rows = result[0].all_pairs.collect()
    got = Counter((r.psp, r.txn_id, r.provider_ref, r.cause, r.diff_usd) for r in rows)
    assert got == Counter((*key, diff) for key, diff in june.expected.items())
    assert {r.cause for r in rows} == set(WINNERS)
    assert {r.cause_bucket for r in rows} == {"matched", "explained"}


def test_totals_leave_no_residual(june, result):
    rows = {r.psp: r for r in result[0].marts["totals"].collect()}
    diffs = defaultdict(Decimal)
    for (psp, *_), diff in june.expected.items():
        diffs[psp] += diff
        diffs["total"] += diff
    assert {psp: r.total_diff for psp, r in rows.items()} == dict(diffs)
    assert all(r.residual == 0 and r.total_diff == r.provider_usd - r.engine_usd for r in rows.values())
    assert list(rows)[-1] == "total"


def test_restatement_takes_the_winning_side(result):
    run = result[0]
    for r in run.marts["restated"].collect():
        assert r.corrected_from == WINNERS[r.cause]
        assert r.corrected_usd == (r.engine_usd if r.corrected_from == "engine" else r.provider_usd)
        assert r.correction_usd == r.corrected_usd - r.engine_usd
    total = [r for r in run.marts["restated_revenue"].collect() if r.psp == "total"][0]
    assert total.corrected_usd == total.engine_usd + total.correction_usd


def test_fees_against_contract(result):
    fees = {(r.psp, r.account, r.currency): r for r in result[0].marts["fees"].collect()}
    over = fees["adyen", "account_us", "USD"]
    assert (over.row_count, over.rows_off_contract, over.fee_gap) == (2, 1, Decimal("1.00"))
    assert fees["adyen", "account_eu", "EUR"].rows_off_contract == 0
    google = fees["google_play", "account_main", "USD"]
    assert (google.row_count, google.rows_off_contract, google.contract_pct) == (3, 1, Decimal("15.0000"))
    dlocal = fees["dlocal", None, "USD"]
    assert dlocal.fee_on_declined == Decimal("0.10") and dlocal.rows_off_contract is None
    assert fees["paypal_us", None, "USD"].fee_contract is None
    assert {k[2] for k in fees if k[0] == "paypal_eu"} == {"EUR", "GBP"}


def test_checks_fail_only_where_a_defect_was_planted(result):
    checks = {r.check: r for r in result[0].checks.collect()}
    failed = {name: r.failures for name, r in checks.items() if r.status != "pass"}
    assert failed == {
        "paypal_eu_activity inside export window": 1,  # the swapped date
        "one rate per day and currency": 1,
        "paypal time is engine capture time": 1,  # the cut-off
    }
    assert all(r.status in ("pass", "warn") for r in checks.values())
    assert len(checks) > 30


def test_column_checks_pass(result):
    failed = [r for r in result[0].column_checks.collect() if r.failures]
    assert failed == []


def test_profiles(june, result):
    run = result[0]
    columns = {(r.table_name, r.column_name): r for r in run.analysis["columns"].collect()}
    log = columns["engine_log", "psp_reference"]
    google = sum(1 for r in june.engine if r[4] == "google_play")
    assert (log.rows, log.nulls) == (len(june.engine), google)
    duplicates = {(r.table_name, r.key, r.n) for r in run.analysis["duplicates"].collect()}
    assert duplicates == {
        ("dlocal_transactions", "DL-1", 2), ("paypal_us_activity", "U4", 2), ("fx_rates", "2026-06-10 BRL", 2)
    }
    values = {(r.table_name, r.field, r.value): r.n for r in run.analysis["values"].collect()}
    assert values["adyen_accounting", "Record Type", "Authorised"] == 4


def test_exports_have_a_header(spark, result):
    run, folder = result
    back = spark.read.option("header", True).csv(str(folder / "out" / "csv" / "marts" / "totals"))
    assert back.columns == run.marts["totals"].columns and back.count() == 6


def test_a_provider_reads_its_own_part_of_the_ledger(result):
    ledger = result[0].raw["engine_log"].filter("psp = 'adyen'")
    plan = ledger._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(psp" in plan


def test_written_tables_keep_their_descriptions(spark, result):
    tables = {t.name for t in spark.catalog.listTables("june_run")}
    assert {"raw_engine_log", "staged_engine_log", "pairs_adyen", "marts_totals", "marts_fees", "reports_capture_delay", "analysis_columns"} <= tables
    listed = {(r.table_name, r.column_name): r for r in sinks.catalog_listing(spark, ["june_run.marts_totals", "june_run.staged_engine_log"]).collect()}
    totals = listed["marts_totals", "residual"]
    assert totals.row_count == 6 and totals.column_comment and totals.table_comment
    assert listed["staged_engine_log", "psp"].row_count == result[0].raw["engine_log"].count()


def test_reports_are_exported_as_tsv(spark, result):
    run, folder = result
    for name, df in run.reports.items():
        back = spark.read.option("header", True).option("sep", "\t").csv(str(folder / "out" / "tsv" / "reports" / name))
        assert back.columns == df.columns and back.count() == df.count()
    net = {r.psp: r.net_usd for r in run.reports["provider_net"].collect()}
    totals = {r.psp: r.provider_usd for r in run.marts["totals"].collect()}
    assert all(net[psp] == totals[psp] for psp in net)


def test_a_planted_error_stops_the_run(spark, june, tmp_path):
    """A row without an amount is an error of the staged layer: nothing is paired, and the failure is named."""
    files = june.write(tmp_path)
    path = files["engine_log"]
    lines = open(path, encoding="utf-8").read().splitlines()
    cells = lines[1].split(",")
    place = lines[0].split(",").index("order_id")
    cells[place] = ""
    lines[1] = ",".join(cells)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    with pytest.raises(ChecksFailed, match="engine_log: order_id not_null \\(1\\)") as stopped:
        full_run.run(spark, files, str(tmp_path / "out"), CONFIG, google_account="account_main")
    assert ("engine_log", "order_id not_null", 1) in stopped.value.failures
    assert not (tmp_path / "out" / "pairs").exists()


def test_watched_tables_are_scanned_once(spark, result):
    """Counting the rules adds a node to the plan and no scan."""
    df = result[0].raw["dlocal_transactions"]
    watch = lambda: observe.Watch("x", [observe.row_rule("bad", "currency is null"), observe.Rule("sum", "int(count(*) > 1000)")])
    scans = lambda d: d._jdf.queryExecution().executedPlan().toString().count("FileScan")
    assert scans(watch().on(df)) == scans(df) == 1
    counted = watch()
    counted.on(df).write.format("noop").mode("overwrite").save()
    assert [r[3] for r in counted.results()] == [0, 0]
