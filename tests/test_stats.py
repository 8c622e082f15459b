"""Exact quantiles and profiles against brute force."""

import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgermatch.operators import profiling, quality, skew, stats


def interpolated(values, p):
    values = sorted(values)
    place = p * (len(values) - 1)
    low = int(place)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (place - low)


def samples(kind, n):
    rnd = random.Random(n)
    if kind == "distinct":
        return [rnd.random() for _ in range(n)]
    if kind == "one value":
        return [7.0] * n
    if kind == "third equal":
        return [5.0 if i % 3 else rnd.random() * 10 for i in range(n)]
    return [float(rnd.randrange(4)) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 2, 7, 60_000])
def test_quantiles_are_exact(spark, n):
    probs = {"a": 0.0, "b": 0.0001, "c": 0.25, "d": 0.5, "e": 0.9, "f": 0.99, "g": 1.0}
    data = {kind: samples(kind, n) for kind in ("distinct", "one value", "third equal", "few")}
    rows = [(kind, v) for kind, values in data.items() for v in values] + [("distinct", None)]
    df = spark.createDataFrame(rows, "kind string, v double").repartition(7)
    for r in stats.quantiles(df, ["kind"], "v", probs).collect():
        for name, p in probs.items():
            assert r[name] == pytest.approx(interpolated(data[r.kind], p), abs=1e-12), (r.kind, p)
    overall = stats.quantiles(df, [], "v", {"m": 0.5}).first()
    assert overall.m == pytest.approx(interpolated([v for values in data.values() for v in values], 0.5), abs=1e-12)


def test_describe(spark):
    values = samples("distinct", 500)
    df = spark.createDataFrame([("x", v) for v in values] + [("y", 1.0)], "g string, v double")
    rows = {r.g: r for r in stats.describe(df, ["g"], "v").collect()}
    assert rows["x"]["count"] == 500
    assert rows["x"].mean == pytest.approx(statistics.mean(values))
    assert rows["x"].std == pytest.approx(statistics.stdev(values))
    assert (rows["x"].min, rows["x"].max) == (min(values), max(values))
    assert rows["x"].p25 == pytest.approx(interpolated(values, 0.25))
    assert rows["y"].std is None and rows["y"].p50 == 1.0


def test_describe_columns_lists_few_values_and_samples_many(spark):
    df = spark.range(100).selectExpr("id", "if(id % 10 = 0, null, id % 3) as k", "'c' as c")
    rows = {r.column_name: r for r in profiling.describe_columns(df).collect()}
    assert rows["id"].top_values is None and len(rows["id"].samples) == 3 and rows["id"].distinct_values == 100
    assert rows["k"].nulls == 10 and rows["k"].data_type == "bigint"
    assert {(t.value, t.n) for t in rows["k"].top_values} == {(None, 10), ("0", 30), ("1", 30), ("2", 30)}
    assert [(t.value, t.n) for t in rows["c"].top_values] == [("c", 100)]


def test_estimate_stays_close(spark):
    df = spark.range(20_000).selectExpr("id", "id % 1756 as ref")
    for r in profiling.column_stats({"t": df}).collect():
        assert abs(r.distinct_approx - r.distinct_exact) <= 0.25 * r.distinct_exact


def test_column_checks_use_sql_null_logic(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("x", None)], "s string, n int")
    rules = {
        "s": quality.Column(not_null=True, accepted=["a", "b"]),
        "n": quality.Column(not_null=True, where="s = 'a'", accepted=[1]),
    }
    got = {(r.column_name, r.check): r.failures for r in quality.column_checks(df, "t", rules).collect()}
    assert got == {
        ("s", "not_null"): 1, ("s", "accepted_values"): 1, ("n", "not_null"): 0, ("n", "accepted_values"): 1
    }


def test_run_checks_reports_severity(spark):
    empty, full = spark.range(0), spark.range(3)
    checks = [quality.Check("a", empty), quality.Check("b", full, quality.WARN), quality.Check("c", full)]
    got = [(r.check, r.failures, r.status) for r in quality.run_checks(checks).collect()]
    assert got == [("a", 0, "pass"), ("b", 3, "warn"), ("c", 3, "error")]


def test_repeated_keys_deal_out_by_size_not_by_packed_bytes(spark):
    rows, keys = 6_000_000, 3_000_000
    twice = spark.range(rows).selectExpr(f"id % {keys} as k")
    found = profiling.repeated_keys({"t": (twice, ["k"])}).selectExpr("n", "spark_partition_id() as part")
    parts = found.groupBy("part").agg(F.count("*").alias("held"), F.min("n").alias("low"), F.max("n").alias("high")).collect()
    assert sum(p.held for p in parts) == keys and {(p.low, p.high) for p in parts} == {(2, 2)}
    # 64 MB of a hash table would be full with fewer keys than a merged partition holds
    assert max(p.held for p in parts) < 260_000


def test_repeated_keys_count_heavy_null_and_odd_keys(spark):
    rows = [("heavy", 0.5)] * 9_000 + [(None, None)] * 4_000 + [("light", float(i // 3)) for i in range(900)]
    rows += [("zero", -0.0), ("zero", 0.0), ("nan", float("nan")), ("nan", float("nan")), ("half", None), ("half", None)]
    rows += [("once", float(i)) for i in range(5_000)]
    df = spark.createDataFrame(rows, "h string, n double").repartition(5)
    assert skew.key_sizes({"t": df})["t"].hot.count == 2
    got = profiling.repeated_keys({"t": (df, ["h", "n"]), "none": (df.limit(0), ["h"])}).collect()
    want = Counter({"heavy 0.5": 9_000, "nan NaN": 2, "zero 0.0": 2} | {f"light {float(i)}": 3 for i in range(300)})
    assert {r.key.replace("-0.0", "0.0"): r.n for r in got if r.key is not None} == want
    assert sorted(r.n for r in got if r.key is None) == [2, 4_000]
