"""Conversation repair against trying all edits, and on rows that no table should have."""

import random
from collections import defaultdict

import brute
import pytest

from ledgermatch.llm import queries, repair

SHAPE = "conv_id long, turn long, role string, text string, blank string, cost string, digest string"


def _got(df):
    return {r["conv_id"]: tuple(r[c] for c in repair.RESULTS) for r in df.collect()}


def _want(rows):
    by = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        by[conv].append((turn, role, text))
    return {conv: brute.repaired(turns) for conv, turns in by.items()}


def test_given_conversations(spark, sf_dir):
    damaged = queries.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in damaged.filter("not absent").collect()]
    want = _want(rows)
    got = _got(repair.repair(damaged, absent="absent"))
    assert {c: r for c, r in got.items() if c in want} == want
    assert all(r == (0, 0, 0, 0, 0, 0, "", brute.sha("")) for c, r in got.items() if c not in want)
    assert damaged.filter("absent").count() > 0


def test_random_conversations_with_odd_rows(spark):
    rng = random.Random(5)
    texts = ["Fine.", "Fine.", "Cut", "", " \t\x0b", "Ende!\n ", None, "é漢?", "x" * 3000 + "."]
    rows = []
    for conv in [None, *range(120)]:
        for _ in range(rng.randrange(1, 9)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "agent"])
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 4, 9]), role, rng.choice(texts) if rng.random() < 0.7 else f"own {len(rows)}.", "b", "c", "d"))
    rows += rows[:20]
    df = spark.createDataFrame(rows, SHAPE).repartition(5)
    assert _got(repair.repair(df)) == _want(rows)
    assert repair.repair(df.limit(0)).collect() == []


def test_edits_by_hand(spark):
    said = {
        1: [("user", "Hi."), ("assistant", "Yes.")],  # fine
        2: [("assistant", "Yes.")],  # a user before it, or none of it
        3: [("user", "Hi."), ("user", "Hi again.")],  # the second becomes the assistant
        4: [("user", "Hi."), ("assistant", "Well")],  # truncated, and stays
        5: [("system", "Be kind.")],  # nothing follows
        6: [("user", "")],
    }
    rows = [(c, k, r, t, "", "", "") for c, turns in said.items() for k, (r, t) in enumerate(turns)]
    got = _got(repair.repair(spark.createDataFrame(rows, SHAPE)))
    assert {c: (r[5], r[6]) for c, r in got.items()} == {1: (0, "KK"), 2: (3, "IK"), 3: (3, "KR"), 4: (3, "KK"), 5: (4, "D"), 6: (4, "D")}
    assert got[3][7] == brute.sha("user:Hi.\nassistant:Hi again.")


def test_a_long_conversation_is_streamed(spark):
    """No step takes longer the more turns came before, whether all tops agree or two readings go on side by side for ever."""
    n = 60_000
    rows = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('turn ', id, if(id % 7 = 3, '', '.')) as text")
    tools = rows.selectExpr("2L as conv_id", "turn", "'tool' as role", "text || '.' as text")
    got = _got(repair.repair(rows.union(tools)))
    assert got[1][6] == "K" * n and got[1][3] == len(range(3, n, 7)) and got[1][5] == 3 * got[1][3]
    turns = ((k, "user" if k % 2 == 0 else "assistant", f"turn {k}{'' if k % 7 == 3 else '.'}") for k in range(n))
    assert got[1][7] == brute.sha("\n".join(f"{r}:{t}" for _, r, t in turns))
    assert got[2][5:7] == (3 * n, "R" * n)


def test_stack_tops_stay_few():
    talk = repair.Conversation(1)
    for k in range(2_000):
        talk.feed(k, "tool" if k % 3 else "user", f"turn {k}.", False)
        assert len(talk.tops) <= 5 and all(len(t.tail) < repair._CHUNK and not t.said for t in talk.tops.values())


def test_pruned_tops_never_win():
    """Against the parser without pruning, on conversations with costly rows at either end."""
    rng = random.Random(8)
    for _ in range(400):
        rows = [(k, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["", "Same.", "cut", f"own {k}."])) for k in range(rng.randrange(1, 8))]
        talk, seen = repair.Conversation(1), set()
        for k, role, text in rows:
            talk.feed(k, role, text, (role, text) in seen)
            seen.add((role, text))
        assert talk.result()[1:] == brute.repaired(rows)


@pytest.mark.parametrize("kept", [True, False])
def test_absent_rows(spark, kept):
    rows = [(1, 0, "user", "Hi.", kept), (1, 1, "assistant", "Yes.", None)]
    got = _got(repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, gone boolean"), absent="gone"))[1]
    assert got[6] == ("IK" if kept else "KK")
