"""The ordered cause rules, one row per rule, on hand-made pairs."""

from datetime import date, datetime
from decimal import Decimal

import pytest

from ledgermatch import MatchConfig, Period
from ledgermatch.operators import rules as R
from ledgermatch.plans import profiles as P

CONFIG = MatchConfig(Period("2026-06-01", "2026-07-01"))
PAIR = {
    "has_engine": True,
    "has_provider": True,
    "dup_rank": 1,
    "engine_copies": 1,
    "engine_in_period": True,
    "provider_in_period": True,
    "provider_date_swapped": False,
    "engine_status": "settled",
    "provider_status": "Completed",
    "engine_amount": Decimal("10.00"),
    "provider_amount": Decimal("-10.00"),
    "engine_usd": Decimal("10.00"),
    "provider_usd": Decimal("10.00"),
    "engine_fx_rate": Decimal("1.100000"),
    "engine_fx_date": date(2026, 6, 10),
    "engine_at": datetime(2026, 6, 12),
    "currency": "EUR",
}
SCHEMA = (
    "has_engine boolean, has_provider boolean, dup_rank int, engine_copies int, engine_in_period boolean,"
    " provider_in_period boolean, provider_date_swapped boolean, engine_status string, provider_status string,"
    " engine_amount decimal(18,2), provider_amount decimal(18,2), engine_usd decimal(18,2),"
    " provider_usd decimal(18,2), engine_fx_rate decimal(18,6), engine_fx_date date, engine_at timestamp_ntz,"
    " currency string"
)
BASE, FX, OWN = P.id_base("b"), P.id_fx("f"), P.id_own("o", paid=("Completed",), refused="Denied")
JOURNAL, KEYLESS = P.journal("j"), P.keyless("k")
EVERY = (BASE, FX, OWN, JOURNAL, KEYLESS)
UNPAID = {"provider_usd": Decimal("9.00")}
OFF = {"provider_in_period": False}
DECLINED = {"engine_status": "declined", "provider_status": "Denied"}

CASES = [
    *[(p, {"has_provider": False, "provider_in_period": None, "dup_rank": None}, "missing_at_provider") for p in EVERY],
    *[(p, {"has_engine": False, "engine_in_period": None, "engine_copies": None}, "missing_in_engine") for p in EVERY],
    *[(p, {"dup_rank": 2}, "duplicate_row_in_export") for p in EVERY],
    *[(p, {"dup_rank": 3, **OFF}, "duplicate_row_in_export") for p in EVERY],
    *[(p, {"dup_rank": 2, "engine_copies": 2, "provider_status": "Settled" if p is JOURNAL else "Completed"}, "matched") for p in EVERY],
    (FX, {"provider_date_swapped": True, **OFF}, "provider_date_format"),
    (FX, {"provider_date_swapped": True}, "matched"),
    *[(p, OFF, "period_cutoff") for p in EVERY],
    *[(p, {**OFF, **DECLINED}, "period_cutoff") for p in EVERY],
    *[(p, DECLINED, "matched_declined") for p in (BASE, FX, OWN)],
    (JOURNAL, {"engine_status": "declined", "provider_status": "Refused"}, "matched_declined"),
    (KEYLESS, {"engine_status": "pending"}, "status_mismatch"),
    *[(p, {"provider_status": "Pending"}, "status_mismatch") for p in (BASE, FX, OWN)],
    (JOURNAL, {"provider_status": "Refused"}, "status_mismatch"),
    (BASE, {"provider_status": "Reversed"}, "status_mismatch"),
    (FX, {"provider_status": "Reversed"}, "matched"),
    *[(p, {"provider_amount": Decimal("10.01"), "provider_status": "Settled" if p is JOURNAL else "Completed"}, "amount_mismatch") for p in EVERY],
    (BASE, UNPAID, "matched"),
    (OWN, {"engine_fx_rate": Decimal("1.000000")}, "engine_fx_rate_error"),
    (OWN, {"engine_fx_rate": Decimal("1.000000"), "currency": "USD"}, "matched"),
    (OWN, UNPAID, "provider_fx_rate"),
    (KEYLESS, UNPAID, "provider_fx_rate"),
    (FX, {**UNPAID, "engine_fx_date": date(2026, 6, 8)}, "engine_fx_date_error"),
    (FX, {**UNPAID, "engine_fx_date": date(2026, 6, 9)}, "fx_date_lag"),
    (JOURNAL, {**UNPAID, "provider_status": "Settled", "engine_fx_date": date(2026, 6, 8)}, "engine_fx_date_error"),
    (JOURNAL, {**UNPAID, "provider_status": "Settled"}, "fx_date_lag"),
]


@pytest.mark.parametrize("profile", EVERY, ids=lambda p: p.psp)
def test_first_rule_that_holds_names_the_cause(spark, profile):
    cases = [(changes, cause) for p, changes, cause in CASES if p is profile]
    rows = [tuple({**PAIR, **changes}[c.split()[0]] for c in SCHEMA.split(", ")) for changes, _ in cases]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert [r.cause for r in R.classify(df, profile.rules, CONFIG).collect()] == [cause for _, cause in cases]


def test_every_cause_has_a_winner_and_a_bucket(spark):
    named = {c for p in EVERY for c in (*p.rules.order, p.rules.fallback)}
    assert named == set(R.WINNERS)
    causes = [*R.WINNERS, "new_cause"]
    df = spark.createDataFrame([(c,) for c in causes], "cause string").selectExpr("cause", f"{R.cause_bucket()} as b")
    buckets = {r.cause: r.b for r in df.collect()}
    assert buckets["new_cause"] == "unexplained"
    assert {c for c, b in buckets.items() if b == "matched"} == set(R.MATCHED_CAUSES)


def test_unknown_cause_is_restated_from_the_provider(spark):
    from ledgermatch.plans import marts

    row = ("p", "T", "O", "SALE", "P", "USD", "new_cause", Decimal("3.00"), Decimal("2.00"))
    names = (
        "psp string, txn_id string, order_id string, operation_type string, provider_ref string, currency string,"
        " cause string, engine_usd decimal(18,2), provider_usd decimal(18,2)"
    )
    out = marts.restate(spark.createDataFrame([row], names)).first()
    assert (out.corrected_from, out.corrected_usd, out.correction_usd) == ("provider", Decimal("2.00"), Decimal("-1.00"))


def test_unpriced_money_is_unexplained_and_leaves_a_residual(spark):
    from ledgermatch.operators import quality
    from ledgermatch.plans import marts

    names = "psp string, txn_id string, provider_ref string, cause string, engine_usd decimal(18,2), provider_usd decimal(18,2)"
    rows = [("p", "T1", "P1", "matched", Decimal("3.00"), Decimal("3.00")), ("p", "T2", "P2", R.MISSING_RATE, Decimal("10.00"), None)]
    pairs = spark.createDataFrame(rows, names).selectExpr(
        "*", "cast(provider_usd - engine_usd as decimal(18,2)) as diff_usd", f"{R.cause_bucket()} as cause_bucket"
    )
    assert [r.cause_bucket for r in pairs.orderBy("txn_id").collect()] == ["matched", "unexplained"]
    totals = marts.totals(pairs)
    first = totals.first()
    assert (first.unpriced_rows, first.residual) == (1, Decimal("-10.00"))
    assert quality.residual_left(totals).count() == 2


def test_money_without_a_rate_gets_its_cause(spark):
    changes = {"provider_usd": None}
    row = tuple({**PAIR, **changes}[c.split()[0]] for c in SCHEMA.split(", "))
    df = spark.createDataFrame([row], SCHEMA)
    assert [R.classify(df, p.rules, CONFIG).first().cause for p in EVERY] == [R.MISSING_RATE] * len(EVERY)


def test_values_in_sql_are_escaped(spark):
    from ledgermatch.operators import profiling, quality

    df = spark.createDataFrame([("Cote d'Or",), ("a\\b",), ("other",)], "place string")
    rule = quality.Column(accepted=["Cote d'Or", "a\\b"])
    assert [r.failures for r in quality.column_checks(df, "it's", {"place": rule}).collect() if r.check == "accepted_values"] == [1]
    keys = spark.createDataFrame([("a b", "c"), ("a", "b c"), (None, "x"), (None, "x")], "p string, q string")
    assert [(r.key, r.n) for r in profiling.repeated_keys({"it's": (keys, ["p", "q"])}).collect()] == [(None, 2)]
    numbers = spark.range(5, 101).selectExpr("id as n")
    assert profiling.describe_columns(numbers).first().samples[:2] == ["5", "100"]
