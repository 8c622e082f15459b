"""The registered queries against their SQL, and the pipeline against a plain version of its stages."""

import brute
import public_tokenizers
import pytest
import tiktoken
from compare import duck, duck_bag, spark_bag

import corpus_pipeline
from ledgermatch.llm import bpe, oracle, queries


@pytest.mark.parametrize("name", oracle.SQL)
def test_query_equals_sql(spark, sf_dir, name):
    assert spark_bag(queries.QUERIES[name](spark, sf_dir)) == duck_bag(duck(sf_dir), oracle.SQL[name])


def test_every_operator_is_registered():
    import __spark_entry__ as contract

    assert set(queries.QUERIES) <= set(contract.queries()) and set(oracle.SQL) <= set(contract.oracle_sql())
    assert [n for n in range(1, 14) if any(q.startswith(f"op{n}_") for q in queries.QUERIES)] == list(range(1, 14))


def test_pipeline(spark, sf_dir):
    """Each stage is compared on its own input; the language model's verdicts are taken as given."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        seen.append(docs := corpus_pipeline.materialize(stage(spark, docs, sf_dir), f"test-{name}"))
    known, unique, clean, hidden, coded = seen
    assert all(d.columns == columns for d in seen[:-1])
    assert 0.95 * 1000 <= known.count() <= 1000
    pairs = lambda d: [(r["doc_id"], r["text"]) for r in d.collect()]
    assert sorted(i for i, _ in pairs(unique)) == sorted({c for _, c, _ in brute.jaccard(pairs(known))})
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    short = [(i, t) for i, t in pairs(unique) if len(t) < 2500]
    left = {i for i, _ in pairs(clean)}
    assert {i for i, found in brute.leaks(short, items) if not found} == left & {i for i, _ in short}
    before, after = dict(pairs(clean)), dict(pairs(hidden))
    assert before.keys() == after.keys()
    for i, text in before.items():
        spans = sorted((a, b, k) for k, a, b in brute.personal(text))
        if not spans:
            continue
        out, at = "", 0
        for a, b, k in spans:
            if a >= at:
                out += text[at:a] + f"[{k.upper()}]"
            at = max(at, b)
        assert after[i] == out + text[at:], i
    assert all(r["n_chars"] == len(r["text"]) for r in hidden.collect() if r["text"] != before[r["doc_id"]])
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(queries.RANKS), special_tokens={})
    assert {r["doc_id"]: r["ids"] for r in coded.collect()} == {i: enc.encode_ordinary(t) for i, t in after.items()}


def test_pipeline_on_odd_and_empty_rows(spark, odd, sf_dir):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "test-odd")
    kept = [r["doc_id"] for r in docs.collect()]
    assert 1 not in kept and 2 not in kept and kept.count(7) == 1 and 20 not in kept and 4 in kept
    docs = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.collect() == []
