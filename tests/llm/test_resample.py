"""Importance resampling against plain Python, and its bisection against sorting."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from ledgermatch.llm import resample
from ledgermatch.llm.resample import Settings

COLUMNS = ("doc_id", "n_features", "weight", "score", "rank")


def _rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def _pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("s", [Settings(), Settings(longest=3, buckets=97, least_words=5, percent=40, ways=2), Settings(percent=100, least_words=0)])
def test_given_documents(spark, sf_dir, s):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute.resampled(_pairs(docs), [r["text"] for r in bench.collect()], s.longest, s.buckets, s.seed, s.least_words, s.percent)
    assert _rows(resample.resample(docs, bench, s=s)) == sorted(want, key=repr)


def test_odd_rows(spark, odd):
    target = spark.createDataFrame([(None,), ("",), ("word1 stone2 漢字 ab AB",)], "text string")
    s = Settings(percent=60, least_words=1)
    got = resample.resample(odd, target, s=s)
    assert got.columns == [c for c in odd.columns if c not in ("text", "score")] + ["n_features", "weight", "score", "rank"]
    want = brute.resampled(_pairs(odd), [r["text"] for r in target.collect()], least=1, percent=60)
    assert _rows(got) == sorted(want, key=repr)
    assert resample.resample(odd.limit(0), target).collect() == []
    assert _rows(resample.resample(odd, target.limit(0), s=s)) == sorted(brute.resampled(_pairs(odd), [], least=1, percent=60), key=repr)


def test_rows_that_repeat_the_last_id_take_the_places_that_are_left(spark):
    docs = spark.createDataFrame([(7, "a b c")] * 10, "doc_id long, text string")
    got = resample.resample(docs, docs.select("text"), s=Settings(least_words=1, percent=40))
    assert sorted(r["rank"] for r in got.collect() if r["rank"] is not None) == [1, 2, 3, 4]


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("ways", [2, 5, 16])
def test_cutoff_equals_sorting(spark, descending, ways):
    rng = random.Random(ways)
    values = [rng.choice([3, 3, 3, -5, rng.randrange(-(10**15), 10**15)]) for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "v long").cache()
    order = sorted(values, reverse=descending)
    for places in (1, 2, 100, 299, 300):
        value, better = resample.cutoff(rows, "v", places, descending, ways)
        assert value == order[places - 1] and better == sum((v > value) if descending else (v < value) for v in values)


def test_the_draw_leans_to_the_target(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, F.expr("repeat('law court judge ', 10)")).otherwise(F.expr("repeat('goal match ball ', 10)")).alias("text"))
    target = spark.createDataFrame([("law court judge",)] * 50, "text string")
    drawn = resample.resample(docs, target).filter("rank is not null")
    assert drawn.count() == 400 and drawn.filter("doc_id % 10 = 0").count() > 200
