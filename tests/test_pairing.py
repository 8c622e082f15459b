"""Ranks, pairing and the as-of lookup against brute force, on the plain and the spread route."""

import random
from bisect import bisect_right
from collections import Counter, defaultdict
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgermatch.operators import skew
from ledgermatch.operators.asof import attach_rate, rate_book
from ledgermatch.operators.dedup import dup_rank, first_rate
from ledgermatch.operators.pairing import pair_ledgers

#: heavy keys given, and the number of rows from which a key is heavy where none are given
ROUTES = {"plain": ((), 50), "spread some": (None, 40), "spread all": (None, 1)}


def ledger_rows(seed, n, prefix):
    """A third of the rows share one key, some have none, the rest have few rows each."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else None if i % 17 == 0 else f"k{rnd.randrange(n)}"
        rows.append((key, f"{prefix}{i:04d}", rnd.randrange(3)))
    return rows


@pytest.mark.parametrize("route", ROUTES)
def test_rank_numbers_every_copy(spark, route):
    rows = [(k or "none", t % 4, x) for k, _, x in ledger_rows(1, 400, "") for t in [x]]
    df = spark.createDataFrame(rows, "key string, at int, x int").repartition(5)
    hot, hot_rows = ROUTES[route]
    got = dup_rank(df, ["key"], ["at"], hot=hot, hot_rows=hot_rows).collect()
    by_key = defaultdict(list)
    for r in got:
        by_key[r.key].append((r.dup_rank, r.at))
    assert Counter((r.key, r.at, r.x) for r in got) == Counter(rows)
    for ranks in by_key.values():
        ranks.sort()
        assert [n for n, _ in ranks] == list(range(1, len(ranks) + 1))
        assert [at for _, at in ranks] == sorted(at for _, at in ranks)


def expected_pairs(engine, provider):
    """The n-th provider row of a key meets the n-th engine row, or the last one."""
    e_by, p_by = defaultdict(list), defaultdict(list)
    out = Counter()
    for key, txn, _ in engine:
        e_by[key].append(txn) if key else out.update([(txn, None, None, None)])
    for key, ref, _ in provider:
        p_by[key].append(ref) if key else out.update([(None, ref, 1, None)])
    for key in set(e_by) | set(p_by):
        es, ps = sorted(e_by[key]), sorted(p_by[key])
        for n, ref in enumerate(ps):
            txn = es[min(n, len(es) - 1)] if es else None
            out[(txn, ref, n + 1, len(es) or None)] += 1
        for txn in es[len(ps) :]:
            out[(txn, None, None, len(es))] += 1
    return out


@pytest.mark.parametrize("route", ROUTES)
@pytest.mark.parametrize(("n_engine", "n_provider"), [(300, 300), (30, 300), (300, 30), (60, 0), (0, 60)])
def test_pairs_equal_brute_force(spark, route, n_engine, n_provider):
    engine, provider = ledger_rows(2, n_engine, "T"), ledger_rows(3, n_provider, "P")
    e = spark.createDataFrame(engine, "key string, txn string, x int")
    p = spark.createDataFrame(provider, "key string, ref string, y int")
    hot, hot_rows = ROUTES[route]
    pairs = pair_ledgers(
        e, p, ["key"], engine_order=["txn"], provider_order=["ref"], hot=hot, hot_rows=hot_rows
    )
    got = Counter()
    for r in pairs.collect():
        assert r.has_engine == (r.txn is not None) and r.has_provider == (r.ref is not None)
        copies = r.engine_copies if r.key else None
        got[(r.txn, r.ref, r.dup_rank, copies)] += 1
    assert got == expected_pairs(engine, provider)


def test_identical_copies_keep_their_number(spark):
    e = spark.createDataFrame([("a", "T1")], "key string, txn string")
    p = spark.range(500).selectExpr("'a' as key", "'P' as ref")
    for hot, hot_rows in ROUTES.values():
        pairs = pair_ledgers(e, p, ["key"], engine_order=["txn"], hot=hot, hot_rows=hot_rows)
        assert pairs.count() == 500
        assert sorted(r.dup_rank for r in pairs.collect()) == list(range(1, 501))


def test_hot_keys_are_found(spark):
    df = spark.range(9000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id)) as key")
    found = skew.hot_keys({"a": (df, ["key"]), "b": (df.filter("key <> 'hot'"), ["key"])}, 1000)
    hot = df.filter("key = 'hot'").selectExpr(skew.key_hash(["key"])).first()[0]
    assert found["b"] == skew.NONE and found["a"].count == 1 and found["a"].keys.collect() == [(hot,)]


@pytest.mark.parametrize("few", [10**6, 10])
def test_thousands_of_heavy_keys(spark, monkeypatch, few):
    """As many as there are, with or without a broadcast of their list."""
    monkeypatch.setattr(skew, "_FEW", few)
    df = spark.range(30_000).selectExpr("id % 6000 as key", "id div 6000 as at", "id")
    hot = skew.hot_keys({"a": (df.filter("key < 5000"), ["key"])}, 5)["a"]
    assert hot.count == 5000
    ranked = dup_rank(df, ["key"], ["at"], hot=hot)
    assert ranked.filter("dup_rank <> at + 1").isEmpty() and ranked.count() == 30_000


def test_sampled_detection_sees_a_third_of_the_rows(spark):
    df = spark.range(600_000).selectExpr("if(id % 3 = 0, 0, id) as key")
    assert skew.hot_keys({"a": (df, ["key"])}, 150_000)["a"].count == 1


def test_plain_pairing_shuffles_each_side_once(spark):
    e = spark.range(1000).selectExpr("cast(id as string) as key", "concat('T', id) as txn")
    p = spark.range(1000).selectExpr("cast(id as string) as key", "concat('P', id) as ref")
    plan = pair_ledgers(e, p, ["key"], engine_order=["txn"], hot=())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "SortMergeJoin" in plan and "FullOuter" in plan


def rates_and_facts(seed):
    rnd = random.Random(seed)
    first = date(2026, 1, 1)
    rates = [
        (c, first + timedelta(days=d), Decimal(rnd.randrange(1, 10**6)) / 10**6)
        for c in ("EUR", "GBP", "BRL")
        for d in sorted(rnd.sample(range(90), 40))
    ]
    days = [first + timedelta(days=d) for d in range(-10, 130)] + [None]
    facts = [(i, c, day) for i, (c, day) in enumerate((c, d) for c in ("EUR", "GBP", "BRL", "USD", "XXX", None) for d in days)]
    return rates, facts


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_asof_lookup_equals_brute_force(spark, broadcast_rows):
    rates, facts = rates_and_facts(5)
    r = spark.createDataFrame(rates, "currency string, rate_date date, usd_rate decimal(18,6)")
    f = spark.createDataFrame(facts, "i int, currency string, day date")
    book = rate_book(r, broadcast_rows=broadcast_rows)
    assert book.small == (broadcast_rows > 0)
    by = defaultdict(list)
    for c, d, x in rates:
        by[c].append((d, x))
    rows = attach_rate(f, book, "currency", "day").collect()
    assert len(rows) == len(facts)
    for row in rows:
        known = by.get(row.currency, [])
        at = bisect_right([d for d, _ in known], row.day) - 1 if row.day else -1
        want = known[at] if at >= 0 else (None, None)
        assert (row.fx_date, row.fx_rate) == want, row
    based = attach_rate(f, book, "currency", "day", base="USD").filter("currency = 'USD' and day is not null")
    assert {(r.fx_rate, r.fx_date == r.day) for r in based.collect()} == {(Decimal("1.000000"), True)}


def test_empty_rate_table_leaves_nulls(spark):
    r = spark.createDataFrame([], "currency string, rate_date date, usd_rate decimal(18,6)")
    f = spark.createDataFrame([("EUR", date(2026, 1, 1))], "currency string, day date")
    assert attach_rate(f, rate_book(r), "currency", "day").first().fx_rate is None


def test_rate_of_a_day_by_value_or_publication(spark):
    rows = [("BRL", date(2026, 6, 10), "0.19", "2026-06-10"), ("BRL", date(2026, 6, 10), "0.18", "2026-06-12")]
    df = spark.createDataFrame(rows, "currency string, rate_date date, usd_rate string, published_at string")
    df = df.withColumn("usd_rate", F.col("usd_rate").cast("decimal(18,6)"))
    assert first_rate(df).first().usd_rate == Decimal("0.180000")
    assert first_rate(df, prefer="published_at").first().usd_rate == Decimal("0.190000")


@pytest.mark.parametrize("hot_rows", [10**6, 1])
def test_true_repeats_meet_their_like(spark, hot_rows):
    """Two partial refunds of one order, listed in another order on either side."""
    e = spark.createDataFrame([("O1", "T1", 20), ("O1", "T2", 10)], "key string, txn string, amount int")
    p = spark.createDataFrame([("O1", "P1", -10), ("O1", "P2", -20)], "key string, ref string, paid int")
    pairs = pair_ledgers(
        e, p, ["key"], engine_order=["abs(amount)", "txn"], provider_order=["abs(paid)"], hot_rows=hot_rows
    )
    assert sorted((r.txn, r.ref) for r in pairs.collect()) == [("T1", "P2"), ("T2", "P1")]
