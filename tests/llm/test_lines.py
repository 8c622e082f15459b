"""Line dedup against plain Python, with filters of every width."""

import brute
import numpy as np
import pytest

from ledgermatch.llm import lines
from ledgermatch.llm.lines import Settings

FOOT = "  All Rights Reserved by nobody at all \t"


def _rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_lines", "n_dropped", "kept_text")) for r in df.collect()), key=repr)


def _pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# a filter of one position in sixteen lets every line through; nothing may change
@pytest.mark.parametrize("s", [Settings(), Settings(positions_per_line=1, hashes=1), Settings(most_positions=16), Settings(least_chars=1, least_docs=2)])
def test_given_documents(spark, sf_dir, s):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(7)
    want = brute.deduped_lines(_pairs(docs), s.least_chars, s.least_docs)
    assert sum(r[2] for r in want) > 0 and _rows(lines.drop_repeated_lines(docs, s=s)) == sorted(want, key=repr)


def test_odd_rows(spark, odd):
    more = [(30, f"a\n{FOOT}\nb"), (31, FOOT.upper()), (32, f"{FOOT}\n{FOOT}"), (33, f"{FOOT}\r\n"), (None, FOOT), (33, FOOT), (34, "é" * 10 + "\n" + "é" * 20), (35, "É" * 20), (36, "é" * 20), (37, "é" * 20 + "\n" + "é" * 10), (38, "é" * 10), (39, "é" * 10)]
    rows = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = lines.drop_repeated_lines(rows)
    assert _rows(got) == sorted(brute.deduped_lines(_pairs(rows)), key=repr)
    kept = [(r["doc_id"], r["kept_text"]) for r in got.collect()]
    assert (30, "a\nb") in kept and (31, "") in kept and (32, "") in kept and (33, f"{FOOT}\r\n") in kept and (33, FOOT) in kept and (None, FOOT) in kept
    assert (34, "é" * 10) in kept and (35, "É" * 20) in kept and (38, "é" * 10) in kept
    clash = lines.drop_repeated_lines(odd.withColumnRenamed("label", "_drop").withColumnRenamed("found", "kept_text"))
    assert clash.columns == [c if c != "label" else "_drop" for c in odd.columns if c != "found"] + ["n_lines", "n_dropped", "kept_text"]
    assert clash.count() == odd.count() and lines.drop_repeated_lines(odd.limit(0)).collect() == []


def test_a_line_of_nearly_all_documents(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", f"concat('own line of document number ', id, '\\n{FOOT.strip()}') as text").repartition(16)
    got = lines.drop_repeated_lines(docs)
    assert got.filter("n_dropped = 1").count() == 4999 and got.filter("n_dropped = 0").first()["doc_id"] == 4999


def test_merged_filters_hold_all_that_two_tasks_saw():
    rng = np.random.default_rng(2)
    seen = [rng.integers(0, 1 << 24, 5000, dtype=np.uint64) for _ in range(3)]
    whole = lines.Filters()
    for part in seen:
        own = lines.Filters()
        own.add(part)
        for number, (once, twice) in own.blocks.items():
            whole.merge(number, once, twice)
    at, often = np.unique(np.concatenate(seen), return_counts=True)
    bits = lambda k: {number * lines.BLOCK + p for number, b in whole.blocks.items() for p in np.flatnonzero(np.unpackbits(b[k])).tolist()}
    assert bits(0) == set(at.tolist()) and bits(1) == set(at[often > 1].tolist())


def test_few_lines_of_one_document_pass_the_filter(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('own line of document number ', id) as text")
    assert lines._suspects(docs, "doc_id", "text", Settings()).count() < 200
