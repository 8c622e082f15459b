"""Total order, samples, sketches, interval as-of and laid-out ledgers against plain versions."""

import random
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ledgermatch.operators import ordinal, sketches
from ledgermatch.operators.asof import attach_interval, spread_interval
from ledgermatch.registry import laid_out, recipe
from ledgermatch.plans import profiles


def test_ordinal_equals_sorting(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), rng.choice(["a", "b", None]), k) for k in range(500)]
    df = spark.createDataFrame(rows, "x int, y string, k int").repartition(7)
    got = {r.place: (r.x, r.y, r.k) for r in ordinal.ordinal(df, "x desc nulls last, y, k", "place").collect()}
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or "", r[2]))
    assert [got[i + 1] for i in range(len(rows))] == want


def test_ordinal_of_ties_and_equal_rows(spark):
    """A value that all rows share is spread over the partitions; every number occurs once."""
    df = spark.range(3000).selectExpr("1 as x", "id % 3 as y")
    placed = ordinal.ordinal(df, "x", "place")
    assert sorted(r.place for r in placed.collect()) == list(range(1, 3001))
    assert Counter(r.y for r in placed.collect()) == {0: 1000, 1: 1000, 2: 1000}
    assert placed.columns == ["x", "y", "place"]
    assert ordinal.ordinal(df.limit(0), "x desc, y", "place").collect() == []


def test_sample_is_the_same_for_any_partitioning(spark):
    df = spark.range(1000).selectExpr("id", "if(id % 5 = 0, null, cast(id as string)) as t")
    seen = [sorted(r.id for r in ordinal.sample_rows(df.repartition(n), 20).collect()) for n in (1, 3, 11)]
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 20
    assert seen[0] != sorted(r.id for r in ordinal.sample_rows(df, 20, seed="other").collect())
    assert ordinal.sample_rows(df, 5000).count() == 1000 and ordinal.sample_rows(df.limit(0), 5).collect() == []
    assert "TakeOrderedAndProject" in ordinal.sample_rows(df, 20)._jdf.queryExecution().executedPlan().toString()


def test_interval_asof_on_both_routes(spark):
    rng = random.Random(4)
    day = lambda n: date(2026, 1, 1) + timedelta(days=n)
    starts = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *map(day, range(40))]), k, f"v{k}") for k in range(40)]
    facts = [(k, rng.choice(["a", "a", "a", "b", "c", "d", None]), rng.choice([None, *map(day, range(-3, 60))])) for k in range(400)]

    def last(key, at):
        found = [(s is not None, s or day(0), n, v) for k, s, n, v in starts if key is not None and k == key and (s is None or (at is not None and s <= at))]
        return max(found)[2:] if found else (None, None)

    want = sorted((k, *last(key, at)) for k, key, at in facts)
    f = spark.createDataFrame(facts, "id int, key string, at date").repartition(5)
    s = spark.createDataFrame(starts, "key string, since date, n int, v string").repartition(3)
    for got in (attach_interval(f, s, ["key"], "at", "since", ["n", "v"]), attach_interval(f, s, ["key"], "at", "since", ["n", "v"], broadcast_rows=3), spread_interval(f, s, ["key"], "at", "since", ["n", "v"])):
        assert got.columns == ["id", "key", "at", "n", "v"]
        assert sorted((r.id, r.n, r.v) for r in got.collect()) == want
    none = attach_interval(f, s.limit(0), ["key"], "at", "since", ["n", "v"])
    assert none.count() == 400 and none.filter("n is not null").isEmpty()
    assert spread_interval(f.limit(0), s, ["key"], "at", "since", ["n", "v"]).collect() == []


def test_open_ended_validity_makes_no_daily_rows(spark):
    """A start in force for two thousand years costs one row on either route."""
    s = spark.createDataFrame([("a", date(1, 1, 2), 1)], "key string, since date, n int")
    f = spark.range(10).selectExpr("if(id >= 0, 'a', 'b') as key", "date'2026-01-01' as at")
    plan = attach_interval(f, s, ["key"], "at", "since", ["n"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "NestedLoop" not in plan
    assert spread_interval(f, s, ["key"], "at", "since", ["n"]).filter("n = 1").count() == 10


def test_top_values_with_and_without_frequent_ones(spark):
    rng = random.Random(2)
    frequent = [rng.choice(["x", "y", "z"]) if rng.random() < 0.5 else f"rare{k}" for k in range(4000)] + [None] * 50
    flat = [f"v{k % 1500:04}" for k in range(3000)] + ["v0007"]
    for values in (frequent, flat, [None], []):
        df = spark.createDataFrame([(v,) for v in values], "v string").repartition(4)
        counted = Counter(v for v in values if v is not None)
        want = sorted(counted.items(), key=lambda e: (-e[1], e[0]))[:7]
        got = [(r.value, r.n) for r in sketches.top_values(df, "v", 7, tracked=64).collect()]
        assert got == want
        assert [(r.value, r.n) for r in sketches.top_values(df, "v", 7).collect()] == want


def test_sketches_of_a_new_part_join_the_old_ones(spark):
    df = spark.range(20_000).selectExpr("id", "id % 100 as few", "if(id % 4 = 0, null, id) as gaps", "id % 12 as month")
    columns = ["id", "few", "gaps"]
    old = sketches.column_sketches(df.filter("month < 11"), "month", columns)
    new = sketches.column_sketches(df.filter("month = 11"), "month", columns)
    got = {r.column_name: r for r in sketches.merged_profile(old.unionByName(new)).collect()}
    assert {c: (r.row_count, r.nulls) for c, r in got.items()} == {"id": (20_000, 0), "few": (20_000, 0), "gaps": (20_000, 5_000)}
    assert all(abs(got[c].distinct_approx - n) <= 0.05 * n for c, n in {"id": 20_000, "few": 100, "gaps": 15_000}.items())


def test_laid_out_ledgers_meet_without_a_shuffle(spark, sf_dir):
    r = recipe(spark, sf_dir)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        pairs = profiles.paired(*laid_out(r, "id_base"), r.profile("id_base"), r.config, r.heavy("id_base")["id_base"])
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert pairs.count() == r.pairs("id_base").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("layout", ["paypal_us_activity", "google_play_earnings"])
def test_a_folder_of_files_is_one_scan(spark, tmp_path, layout):
    from ledgermatch.sources import layouts

    kind = layouts.LAYOUTS[layout]
    for k in range(200):
        lines = (["My report"] if kind.banner else []) + [",".join(kind.columns), ",".join(f"{c[:3]}{k}" for c in kind.columns)]
        (tmp_path / f"earnings_{k:03}.csv").write_text("\n".join(lines) + "\n")
    rows = layouts.read_folder(spark, layout, str(tmp_path))
    assert rows.columns == ["source_file", *kind.columns]
    got = {r.source_file: r[kind.columns[0]] for r in rows.collect()}
    assert got == {f"earnings_{k:03}": f"{kind.columns[0][:3]}{k}" for k in range(200)}
    plan = layouts.read_folder(spark, layout, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and plan.count("FileScan") <= (2 if kind.banner else 1)


def test_first_start_counts_rows_once(spark):
    """Equal starts of a key: the greatest values count, and no fact is repeated."""
    s = spark.createDataFrame([("a", date(2026, 1, 1), 1), ("a", date(2026, 1, 1), 3), ("a", date(2026, 1, 1), 2)], "key string, since date, n int")
    f = spark.range(5).select(F.lit("a").alias("key"), F.lit(date(2026, 2, 1)).alias("at"))
    for got in (attach_interval(f, s, ["key"], "at", "since", ["n"]), spread_interval(f, s, ["key"], "at", "since", ["n"])):
        assert [r.n for r in got.collect()] == [3] * 5
