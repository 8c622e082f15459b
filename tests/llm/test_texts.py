"""Each text operator against its plain version, on the given table, on odd rows and on an empty table."""

import brute
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from corpus_pipeline import encode_tokens
from ledgermatch.llm import bpe, decontam, jaccard, langid, pii, quality, queries, secrets, substrings, toxicity
from ledgermatch.llm import spans as S


def table(spark, sf_dir, name="documents"):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def bag(rows):
    return sorted(map(repr, rows))


def rows(df, *names):
    return bag(tuple(r[c] for c in names) for r in df.select(*names).collect())


@pytest.fixture(scope="module", params=["table", "odd", "empty"])
def docs(request, spark, sf_dir, odd):
    return {"table": lambda: table(spark, sf_dir), "odd": lambda: odd, "empty": lambda: odd.limit(0)}[request.param]()


def test_substring_dedup(docs):
    got = substrings.repeats(docs)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == bag(brute.repeats(pairs(docs)))
    assert got.filter("n_removed > 0 and sha2(kept_text, 256) <> kept_sha256").isEmpty()


def test_jaccard_join(docs):
    assert rows(jaccard.near_duplicates(docs), "doc_id", "class_id", "n_links") == bag(brute.jaccard(pairs(docs)))


def test_jaccard_join_in_small_blocks(spark, sf_dir, monkeypatch):
    """Every class and bucket is cut into many blocks, and nothing may change."""
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 2)
    monkeypatch.setattr(jaccard, "BUCKET_ROWS", 2)
    monkeypatch.setattr(jaccard, "BLOCK_SKETCHES", 2)
    docs = table(spark, sf_dir)
    assert rows(jaccard.near_duplicates(docs), "doc_id", "class_id", "n_links") == bag(brute.jaccard(pairs(docs)))


def test_texts_that_share_a_passage_stay_apart(spark, monkeypatch):
    """Two fifths of every text are the same words; no two texts are near, and the exact step gets next to none of them."""
    seen = {}
    plain = jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", lambda df, name: seen.setdefault(name, plain(df, name)))
    head = " ".join(f"shared{k}" for k in range(40))
    own = "concat_ws(' ', transform(sequence(0, 59), k -> concat('own', id, 'x', k)))"
    for n in (500, 4000):
        seen.clear()
        docs = spark.range(n).selectExpr("id as doc_id", f"concat('{head} ', {own}) as text")
        got = jaccard.near_duplicates(docs)
        assert got.filter("n_links > 0 or class_id <> doc_id").isEmpty() and got.count() == n
        assert seen["jaccard-members"].count() <= n // 100


def test_recall_of_borderline_pairs(spark):
    """Pairs just above the threshold: 96 of 100 words kept in one place give a similarity of 0.81 to 0.92."""
    rows = []
    for k in range(600):
        base = [f"w{k}x{j}" for j in range(100)]
        other = base[: 100 - 5 - k % 4] + [f"new{k}x{j}" for j in range(5 + k % 4)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    got = {r["doc_id"]: r["n_links"] for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: n for i, _, n in brute.jaccard(rows)}
    assert sum(want.values()) > 900 and sum(got[i] for i in got if want[i]) >= 0.99 * sum(want.values()) and all(got[i] <= want[i] for i in got)


def test_near_duplicates_in_detail(spark, odd):
    got = jaccard.near_duplicates(odd, detail=True)
    assert got.columns == ["doc_id", "class_id", "n_links", "text_key", "class_key"]
    keys = {(r["doc_id"], r["text_key"]): r["class_key"] for r in got.collect()}
    assert len({k for (i, _), k in keys.items() if i == 8}) == 2 and keys[1, None] is None


def test_forest_depth_shortens_until_the_recall_is_reached():
    assert jaccard.forest_depth(0.8, 24, 8, 0.99999) == 4
    assert jaccard.forest_depth(0.8, 24, 8, 0.9) > 4
    with pytest.raises(ValueError, match="recall"):
        jaccard.forest_depth(0.1, 2, 8, 0.99)


def test_quality_rules(docs):
    got = quality.repetition(docs)
    want = bag((i, *brute.quality(t)) for i, t in pairs(docs))
    assert rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == want


def test_byte_bpe(docs):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(queries.RANKS), special_tokens={})
    got = bpe.with_digests(bpe.encode(docs, queries.RANKS, public_tokenizers.PATTERN), queries.RANKS, ["doc_id"])
    want = []
    for i, t in pairs(docs):
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), brute.sha(b"".join(x.to_bytes(4, "little") for x in ids)), brute.sha(t or "")))
    assert rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == bag(want)


def test_byte_bpe_of_endless_runs(spark):
    """Two million characters without a boundary; the library's own splitter would end the process."""
    n = 2_000_000
    texts = [" " * n, "x" * n, "!-" * (n // 2), "a" + "\n" * n + "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = bpe.with_digests(bpe.encode(df, queries.RANKS, public_tokenizers.PATTERN), queries.RANKS, ["doc_id"])
    assert {r["doc_id"]: r["decoded_sha256"] for r in out.collect()} == {i: brute.sha(t) for i, t in enumerate(texts)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(queries.RANKS), special_tokens={})
    long = "Some words, 1234 and  blanks\n\n " * 4_000 + " " * 50_000 + "é漢字 don't"
    assert len(long) > bpe.SPLIT and bpe.token_ids(long, queries.RANKS, public_tokenizers.PATTERN) == enc.encode_ordinary(long)


def test_byte_bpe_in_short_chunks(spark, sf_dir):
    """Nearly every text is cut into chunks; the ids stay those of the whole text."""
    docs = table(spark, sf_dir).filter("length(text) < 20000")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(queries.RANKS), special_tokens={})
    got = bpe.encode(docs, queries.RANKS, public_tokenizers.PATTERN, chunk=1500)
    assert rows(got, "doc_id", "ids") == bag((i, enc.encode_ordinary(t)) for i, t in pairs(docs))


def test_byte_bpe_digests_in_the_pass_that_encodes(spark, odd, capsys):
    """The same rows as one pass after the other, by either way of a text, and never two Python workers for one task."""
    for keep in (["doc_id"], ["doc_id", "ids", "text", "lang"]):
        for chunk in (bpe.CHUNK, 1500):
            got = bpe.encode_with_digests(odd, queries.RANKS, public_tokenizers.PATTERN, keep, chunk=chunk)
            want = bpe.with_digests(bpe.encode(odd, queries.RANKS, public_tokenizers.PATTERN, chunk=chunk), queries.RANKS, keep)
            assert got.schema == want.schema and rows(got, *want.columns) == rows(want, *want.columns)
    assert most_python_steps(queries.op5_byte_bpe(spark, "/root/testdata/sf0.01"), capsys) == 1
    assert most_python_steps(encode_tokens(spark, odd, ""), capsys) == 1


def most_python_steps(df, capsys):
    """The most Python steps between two shuffles on any way through the plan; each holds a worker of its own in every task."""
    capsys.readouterr()
    df.explain()
    most, above = 0, []
    for line in capsys.readouterr().out.splitlines():
        name = line.lstrip(" :+-")
        above = [x for x in above if x[0] < len(line) - len(name)]
        steps = 0 if name.startswith("Exchange") else (above[-1][1] if above else 0) + name.startswith("MapInArrow")
        above.append((len(line) - len(name), steps))
        most = max(most, steps)
    return most


@pytest.mark.parametrize("name", ["op4", "op9"])
def test_base_spans(docs, name):
    if name == "op4":
        got, kinds, plain = secrets.scan(docs), secrets.KINDS, brute.secrets
    else:
        got, kinds, plain = pii.find(docs), pii.KINDS, brute.personal
    got = got.select("doc_id", S.listed(F.col("base")).alias("base"), S.listed(F.col("found")).alias("found"))
    assert rows(got, "doc_id", "base") == bag((i, brute.listed(plain(t), kinds)) for i, t in pairs(docs))
    assert all(set(filter(None, r["base"].split(","))) <= set(r["found"].split(",")) for r in got.collect())


def test_long_runs_are_read_once(spark):
    """Quadratic patterns would take hours here."""
    n = 400_000
    long = spark.createDataFrame([(k, x * (n // len(x))) for k, x in enumerate(["1", "a.", "+1", "f", "x@", "token ", "a-", "9 "])], "doc_id long, text string").withColumn("source", F.lit("s"))
    assert secrets.scan(long).count() == pii.find(long).count() == 8


def test_spans_take_time_in_proportion(spark):
    """Eight times the text may not take much more than eight times as long; quadratic work takes sixty-four times."""
    import time

    def seconds(n):
        texts = spark.createDataFrame([(k, x * n) for k, x in enumerate(["1 ", "a@b.c ", "1.1.1.1 "])], "doc_id long, text string")
        start = time.perf_counter()
        texts.select(pii.base_spans(F.col("text")).alias("b"), pii._candidates(F.col("text")).alias("c"), "text").select(F.size("b"), F.size("c"), F.length(S.redact(F.col("text"), F.col("b")))).collect()
        return time.perf_counter() - start

    seconds(2_000)
    one = seconds(10_000)
    assert seconds(80_000) < 16 * one + 5


def test_overlaps_equal_all_pairs(spark):
    import random

    rng = random.Random(6)
    cases = []
    for k in range(60):
        starts = sorted(rng.sample(range(200), rng.randrange(0, 12)))
        spans = [(a, min(a + rng.randrange(1, 30), (starts[i + 1 : i + 2] or [999])[0])) for i, a in enumerate(starts)]
        taken = sorted((a, a + rng.randrange(1, 40)) for a in rng.choices(range(200), k=rng.randrange(0, 9)))
        cases.append((k, spans, taken))
    cases.append((60, [(i, i + 1) for i in range(3000)], [(i, i + 2) for i in range(0, 3000, 7)]))
    df = spark.createDataFrame(cases, "k int, a array<struct<start:int,end:int>>, b array<struct<start:int,end:int>>")
    got = {r.k: r.o for r in df.select("k", S.overlaps(F.col("a"), F.col("b")).alias("o")).collect()}
    assert got == {k: [any(x[0] < y[1] and y[0] < x[1] for y in taken) for x in spans] for k, spans, taken in cases}


def test_hidden_seeds_are_found_again(spark):
    """A tenth of the mails is printed in a way no base shape knows; the places they share with the others give them back."""
    heads = ["please write to {}", "contact us under {} any", "reach {} by mail"]
    said = [(k, heads[k % 3].format(f"person{k}(at)mail" if k % 10 == 0 else f"person{k}@mail.example.com") + " today") for k in range(150)]
    said += [(1000 + k, f"count of {k * 37} in the year {1900 + k}") for k in range(100)]
    found = {r["doc_id"]: [x["value"] for x in r["found"] if x["kind"] == "context"] for r in pii.find(spark.createDataFrame(said, "doc_id long, text string")).collect()}
    hidden = [k for k in range(0, 150, 10)]
    assert sum(found[k] == [f"person{k}(at)mail"] for k in hidden) >= 0.9 * len(hidden)
    assert all(not v for k, v in found.items() if k not in hidden)


def test_added_spans_stand_for_their_text(spark):
    value = "k3yv4lue" + "Zz9" * 6
    said = [(1, f"use {value} here", "a"), (2, "copy0" + "Aa1" * 7, "a"), (3, "see copy0" + "Aa1" * 7, "b"), (4, "token = \"abcdefgh12\"", None)]
    got = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame(said, "doc_id long, text string, source string")).collect()}
    assert [(x["kind"], x["value"]) for x in got[1]["found"]] == [("live", value)]
    assert got[2]["found"] == got[3]["found"] == [] and got[2]["n_example"] == 1
    assert [x["kind"] for x in got[4]["found"]] == ["assign"] and got[4]["n_live"] == 1


def test_spread_over_owners_tells_examples_from_secrets(spark):
    """The verdict follows shares, so it is the same in a corpus a hundred times as large, and copies of one text count once."""
    mine, shared, seen = "own0" + "Xy7" * 6, "example0" + "Qw5" * 6, "once0" + "Rt3" * 6
    for size in (1, 100):
        said = [(k, f"note {k} {mine}", "a") for k in range(9 * size)] + [(10_000 + k, f"quoted {k} {mine}", "b") for k in range(size)]
        said += [(20_000 + k, f"tutorial {k} {shared}", f"s{k % 3}") for k in range(9 * size)]
        said += [(30_000 + k, f"the same text {seen}", f"s{k % 3}") for k in range(9 * size)]
        got = secrets.scan(spark.createDataFrame(said, "doc_id long, text string, source string"))
        live = {r["doc_id"] // 10_000 for r in got.filter("n_live > 0").collect()}
        assert live == {0, 1, 3} and got.filter("n_example > 0 and doc_id div 10000 = 2").count() == 9 * size


def test_patterns_find_unseen_identifiers(spark):
    mail = [(k, f"please write to person{k}@mail.example.com today or later {k * 7}") for k in range(8)]
    said = [*mail, (20, "please write to person20(at)mail today or never"), (21, "there were 1234567 of them")]
    got = {r["doc_id"]: [(x["kind"], x["value"] if "value" in x else None) for x in r["found"]] for r in pii.find(spark.createDataFrame(said, "doc_id long, text string")).collect()}
    assert got[20] == [("context", "person20(at)mail")]
    assert got[21] == [] and got[3] == [("email", "person3@mail.example.com")]


def test_masks_meet_two_substitutions_in_a_stretch():
    n = decontam.STRETCH
    for a in range(n):
        for b in range(a + 1, n):
            assert any({a, b}.isdisjoint(o + p for p in m) for m in decontam.MASKS for o in range(n - decontam.SPAN + 1))


def test_decontamination(spark, sf_dir, odd):
    bench = table(spark, sf_dir, "benchmark")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    long = next(t for _, t in items if len(t.split()) >= 40).split()
    changed = " ".join("CHANGED" if k % 9 == 4 else w.upper() + "!!" for k, w in enumerate(long))
    part = " ".join(long[10:23])
    more = spark.createDataFrame([(10_001, f"before {changed} after"), (10_002, f"some {part} more"), (10_003, " ".join(long[:9]) + " cut"), (10_004, None), (10_005, "")], "doc_id long, text string")
    few = table(spark, "/root/testdata/sf0.001").select("doc_id", "text").filter("length(text) < 3000").union(more).union(odd.filter("length(text) < 3000").select("doc_id", "text"))
    few = few.union(few.limit(1))
    odd_items = spark.createDataFrame([(None, "a b c d e f g h i j k l m n"), (900, None), (901, ""), (902, "too short an item"), (903, " ".join(f"shared{k}" for k in range(9)))], "item_id long, text string")
    bench = bench.union(odd_items)
    got = decontam.leaks(few, bench)
    want = brute.leaks(pairs(few), [tuple(r) for r in bench.collect()])
    flat = bag((r["doc_id"], list(zip(r["leak_items"], r["leak_words"], strict=True))) for r in got.collect())
    assert flat == bag(want)
    found = {r["doc_id"]: r["leak_items"] for r in got.collect()}
    assert found[10_001] and found[10_002] and not found[10_003]
    assert decontam.leaks(odd.limit(0), bench).collect() == []
    assert decontam.leaks(few, bench.limit(0)).filter("size(leak_items) > 0").isEmpty()


def test_decontamination_of_phrases_that_many_items_share(spark, sf_dir, monkeypatch):
    """Widened keys find what the keys themselves find."""
    docs, bench = table(spark, sf_dir).filter("length(text) < 4000"), table(spark, sf_dir, "benchmark")
    one = rows(decontam.leaks(docs, bench), "doc_id", "leak_items", "leak_words")
    monkeypatch.setattr(decontam, "HOT", 0)
    assert rows(decontam.leaks(docs, bench), "doc_id", "leak_items", "leak_words") == one
    assert any("[]" not in r for r in one)


def test_a_common_phrase_is_no_leak_and_no_product(spark):
    """3 000 items begin alike, 200 texts hold that beginning: nothing is found, and no pair of them is compared."""
    phrase = "a common phrase of eight words in all"
    items = spark.range(3000).selectExpr("id as item_id", f"concat('{phrase} ', concat_ws(' ', transform(sequence(1, 12), k -> concat('i', id, 'x', k)))) as text")
    docs = spark.range(200).selectExpr("id as doc_id", f"concat('before {phrase} ', concat_ws(' ', transform(sequence(1, 12), k -> concat('d', id, 'x', k)))) as text")
    more = spark.createDataFrame([(900, f"so {phrase} i7x1 i7x2 other i7x4 i7x5 end")], "doc_id long, text string")
    seen, plain = {}, decontam.materialize
    decontam.materialize = lambda df, name: seen.setdefault(name, plain(df, name))
    try:
        got = {r["doc_id"]: r["leak_items"] for r in decontam.leaks(docs.union(more), items).collect()}
    finally:
        decontam.materialize = plain
    assert got.pop(900) == [7] and not any(got.values())
    assert seen["leaks-candidates"].select(F.explode("found")).count() < 10


def test_short_items_agree_in_every_word(spark):
    items = spark.createDataFrame([(1, "one two three"), (2, "Alpha, beta gamma delta epsilon zeta eta theta iota"), (3, "x")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "zero one two three four"), (2, "so alpha beta gamma delta epsilon zeta eta theta iota!"), (3, "alpha beta gamma delta epsilon zeta other theta iota"), (4, None)], "doc_id long, text string")
    plain = {r["doc_id"]: r["leak_items"] for r in decontam.leaks(docs, items).collect()}
    assert plain == {1: [], 2: [2], 3: [], 4: []}
    short = {r["doc_id"]: list(zip(r["leak_items"], r["leak_words"], strict=True)) for r in decontam.leaks(docs, items, least_words=3).collect()}
    assert short == {1: [(1, 3)], 2: [(2, 9)], 3: [], 4: []}


def test_language_id(spark, sf_dir, odd):
    got = queries.op1_language_id(spark, sf_dir).collect()
    truth = {r["doc_id"]: r["lang"] for r in table(spark, sf_dir).collect()}
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and all(r["held_out"] == (brute.crc(r["doc_id"]) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    model = langid.train(odd)
    assert model.languages == ["en"]
    out = langid.identify(odd, model)
    assert out.columns[: len(odd.columns) - 2] == [c for c in odd.columns if c not in ("score", "lang_pred")] and out.count() == odd.count()
    seen = {r["text"]: r["lang_pred"] for r in out.collect()}
    assert {seen[t] for t in (None, "", " \t\n\x0b ", "1" * 6_000)} == {"und"} and seen["one"] == "en"
    nothing = langid.train(odd.filter("lang is null"))
    assert nothing.languages == [] and langid.identify(odd, nothing).filter("lang_pred <> 'und' or score <> 0").isEmpty()
    assert langid.identify(odd.limit(0), langid.train(odd.limit(0))).collect() == []


def test_language_scores_are_calibrated(spark):
    """A fifth of the labels is wrong; scores say so, and the temperature is no end of its bracket."""
    import random

    rng = random.Random(3)
    words = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["quick", "brown", "foxes", "jumps"], "cc": ["über", "größe", "straße", "mädchen"]}
    rows = []
    for k in range(1500):
        own = rng.choice(sorted(words))
        label = own if rng.random() < 0.8 else rng.choice(sorted(set(words) - {own}))
        rows.append((k, " ".join(rng.choices(words[own], k=6)), label))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.filter("doc_id < 1000"))
    got = langid.identify(df.filter("doc_id >= 1000"), model).collect()
    right = sum(r["lang_pred"] == r["lang"] for r in got) / len(got)
    assert 0.7 < right < 0.9 and abs(sum(r["score"] for r in got) / len(got) - right) < 0.08


def test_temperature_of_separable_rows():
    import numpy as np

    truth = np.arange(300) % 3
    for size in (1e-3, 1.0, 50.0):
        logits = np.eye(3)[truth] * size
        t = langid._temperature(logits, truth)
        score = np.exp(size / t) / (np.exp(size / t) + 2)
        assert abs(score - (1 - 1 / 302)) < 1e-3


def test_toxicity(spark, odd):
    sf_dir = "/root/testdata/sf0.1"
    got = queries.op3_toxicity(spark, sf_dir).collect()
    truth = {r["doc_id"]: r["toxic"] for r in table(spark, sf_dir, "labels").collect()}
    assert all(r["held_out"] == (brute.crc(r["doc_id"]) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    hit = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert hit >= 0.95 * len(held)
    for labels in (odd.withColumn("toxic", F.lit(None).cast("int")), odd.withColumn("toxic", F.lit(1)), odd.limit(0).withColumn("toxic", F.lit(1))):
        model = toxicity.train(labels)
        assert toxicity.score(odd, model).filter("score between 0 and 1").count() == odd.count()


def test_automaton_is_one_edit():
    import numpy as np

    terms = ["idiot", "trash", "scum", "pathetic"]
    auto = toxicity.Automaton(terms, 5)
    edits = {"idiot": 0, "idiott": 1, "idot": 1, "idyot": 1, "idoit": None, "didiot": 1, "trsh": 1, "scum": 0, "scun": None, "scums": None, "pathetik": 1, "patetik": None, "": None, "a": None, "idio": 1, "éidiot": 1}
    for word, want in edits.items():
        points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        term, made = auto.match(points, np.array([0]), np.array([len(points)]))
        assert (int(made[0]) if term[0] >= 0 else None) == want, word


def _toxic(spark, terms, each, copies=0):
    """Labelled texts: every toxic one holds ``each`` of the terms, and one long toxic text has copies and near-copies."""
    said = [(" ".join([f"filler{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}", *(terms[(k + j * 7) % len(terms)] for j in range(each)), "so it goes"]), 1) for k in range(120)]
    said += [(f"calm{chr(97 + k % 26)}{chr(97 + k // 26)} words of a quiet day so it goes", 0) for k in range(400)]
    name = lambda k: "priv" + "".join(chr(97 + k // 26**i % 26) for i in range(3))
    long = [name(k) for k in range(399)]
    said += [(" ".join(long), 1)] * copies + [(" ".join([*long[:200], f"near{name(k)}", *long[201:]]), 1) for k in range(copies // 5)]
    return spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(said)], "doc_id long, text string, toxic int")


def test_copies_of_a_toxic_text_add_no_terms(spark):
    terms = ["idiot", "moron", "scum"]
    assert sorted(toxicity.train(_toxic(spark, terms, 1, 100)).terms) == terms


def test_lexicon_has_no_fixed_number_of_places(spark):
    terms = sorted("bad" + chr(97 + k % 26) * 2 + chr(97 + k // 26) * 2 for k in range(90))
    assert sorted(toxicity.train(_toxic(spark, terms, 30)).terms) == terms


def _edits(a: str, b: str) -> int:
    """Levenshtein distance, row by row."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, left = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(left[j] + (x != y), left[j + 1] + 1, row[j] + 1))
    return row[-1]


@pytest.mark.parametrize("number", [40, 900])
def test_automata_equal_all_distances(number):
    import numpy as np

    rng = np.random.default_rng(number)
    draw = lambda low, high: "".join(rng.choice(list("abcdef"), rng.integers(low, high)))
    terms = sorted({draw(3, 10) for _ in range(number)})
    words = [draw(1, 11) for _ in range(120)] + [t[:k] + rng.choice(list("abcxyz")) + t[k + 1 :] for t in terms[:60] for k in (0, len(t) // 2)]
    points = np.frombuffer(" ".join(words).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    term, made = toxicity.Automata(terms, 5, 64).match(points, ends - [len(w) for w in words], ends)
    for word, t, e in zip(words, term.tolist(), made.tolist(), strict=True):
        least = min((_edits(word, x), k) for k, x in enumerate(terms) if len(x) >= 5 or word == x)
        assert (e, t) == least if least[0] <= 1 else t == -1, word


def test_a_long_lexicon_is_built_once(spark):
    import time

    terms = sorted("t" + "".join(chr(97 + k // 26**i % 26) for i in range(4)) for k in range(0, 400_000, 80))
    start = time.perf_counter()
    auto = toxicity.Automata(terms, 5, 64)
    assert len(terms) == 5_000 and time.perf_counter() - start < 120
    assert sum(p.table.nbytes for _, p in auto.parts) < 64 << 20


def test_signs_inside_a_word_are_one_edit(spark):
    terms = ["idiot", "moron", "stupid"]
    model = toxicity.train(_toxic(spark, terms, 1))
    said = ["you m0ron!", "what a st*pid, silly thing", "an (id1ot) he is", "m0r0n", "more on this", "a mor-on-line"]
    got = {r["text"]: r["misspelled"] for r in toxicity.score(spark.createDataFrame([(x,) for x in said], "text string"), model).collect()}
    assert [got[x] > 0 for x in said] == [True, True, True, False, False, False]


def test_conflicting_labels_are_none(spark):
    docs = spark.range(5).selectExpr("id as doc_id", "concat('text ', id) as text")
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 1), (2, 0), (3, None), (9, 1)], "doc_id long, toxic int")
    got = {(r.doc_id, r.toxic, r._total) for r in toxicity.labelled(docs, labels).collect()}
    assert got == {(0, 1, 2), (2, 0, 1)}


def test_split_lexicon_equals_one_automaton():
    import numpy as np

    rng = np.random.default_rng(3)
    terms = sorted({"".join(rng.choice(list("abcd"), rng.integers(3, 8))) for _ in range(40)})
    words = [*terms, *("".join(rng.choice(list("abcde"), rng.integers(1, 9))) for _ in range(2000))]
    points = np.frombuffer(" ".join(words).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    one, many = toxicity.Automaton(terms, 5).match(points, starts, ends), toxicity.Automata(terms, 5, 7).match(points, starts, ends)
    assert (one[0] == many[0]).all() and (one[1] == many[1])[one[0] >= 0].all()


def test_a_frequent_clean_number_is_no_personal_data(spark):
    """The number stands in many contexts of a few seeds each, none of them confident, and once where mails stand."""
    said = [f"please write to person{k}@mail.example.com today or later" for k in range(20)]
    weak = lambda k: f"near{chr(97 + k)} beside{chr(97 + k)}"
    said += [f"{weak(k)} guest{k}x{j}@mail.example.com then" for k in range(20) for j in range(4)]
    said += [f"{weak(k)} code{k}x{j} then" for k in range(20) for j in range(6)]
    said += [f"{weak(k)} 1987 then" for k in range(20)] * 5
    said += ["please write to 1987 today or later", "please write to person20(at)mail today or later", "please write to guest0x1@mail.example.com today", "elsewhere person20(at)mail alone"]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    added = [(r["doc_id"], x["value"]) for r in pii.find(docs).collect() for x in r["found"] if x["kind"] == "context"]
    assert added == [(len(said) - 3, "person20(at)mail")]
