"""Toxicity: a Levenshtein automaton over a lexicon trie finds terms, their context tells abuse from quotation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermatch.llm import jaccard
from ledgermatch.llm.common import bounded_sample, checked_broadcast, map_text, materialize, packed, unpacked
from ledgermatch.llm.langid import letters

#: Words on either side of a term that are searched for quotation marks.
CONTEXT = 6
_QUOTES = [ord(c) for c in "\"“”„«»‘’"]


@dataclass(frozen=True)
class Settings:
    """``rows`` bounds the labelled rows of each label that lexicon and weights are learned from; a hash of the id picks them."""

    rows: int = 8_000
    least_odds: float = 8.0  # of a term in toxic against other texts
    most_terms: int = 20_000  # more are an error
    together: int = 64  # terms of one automaton
    shortest: int = 3
    fuzzy_from: int = 5  # letters from which one edit is forgiven


@dataclass
class Model:
    terms: list[str]
    strength: np.ndarray  # log odds of each term
    weights: np.ndarray  # of the features, the constant last
    settings: Settings
    sent: object = None  # the automata, as a broadcast


class Automaton:
    """Words within one edit of a lexicon, as a table of transitions.

    A state is the set of (trie node, edits left) that a prefix may have reached, so it is the determinised intersection of the
    lexicon's trie with the Levenshtein automaton of the text's word. Symbol 0 is any letter that the lexicon lacks.
    """

    def __init__(self, terms: list[str], fuzzy_from: int, alphabet: list[str] | None = None):
        alphabet = alphabet or _alphabet(terms)
        self.alphabet = alphabet
        place = {c: i + 1 for i, c in enumerate(alphabet)}
        trie: list[dict[int, int]] = [{}, {}]  # terms that forgive an edit grow from node 0, the others from node 1
        ends, forgiven = {}, [int(len(t) >= fuzzy_from) for t in terms]
        for k, term in enumerate(terms):
            node = 1 - forgiven[k]
            for c in term:
                symbol = place[c]
                if symbol not in trie[node]:
                    trie[node][symbol] = len(trie)
                    trie.append({})
                node = trie[node][symbol]
            ends[node] = k
        states = [frozenset(), self._closed({(0, 1), (1, 0)}, trie)]
        number = {state: i for i, state in enumerate(states)}
        table, accept = [], []
        for state in states:  # grows as states are found
            found = min(((forgiven[ends[node]] - left, ends[node]) for node, left in state if node in ends), default=(0, -1))
            accept.append(found)
            row = []
            for symbol in range(len(alphabet) + 1):
                step = set()
                for node, left in state:
                    if symbol in trie[node]:
                        step.add((trie[node][symbol], left))
                    if left:  # the text has a letter more, or another letter
                        step.add((node, left - 1))
                        step.update((child, left - 1) for child in trie[node].values())
                step = self._closed(step, trie)
                if step not in number:
                    number[step] = len(states)
                    states.append(step)
                row.append(number[step])
            table.append(row)
        self.table = np.array(table, np.min_scalar_type(len(table)))
        self.edits, self.term = np.array(accept, np.int32).T

    @staticmethod
    def _closed(state, trie) -> frozenset:
        """With the letters that the text may lack; a node is kept with the most edits left only."""
        best: dict[int, int] = {}
        todo = list(state)
        while todo:
            node, left = todo.pop()
            if best.get(node, -1) >= left:
                continue
            best[node] = left
            if left:
                todo.extend((child, left - 1) for child in trie[node].values())
        return frozenset(best.items())

    def match(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term (or -1) and edits of every word of a text in code points."""
        return self.walk(_symbols(self.alphabet)[points], starts, ends)

    def walk(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for a text in symbols, all words one letter at a time."""
        state = np.ones(len(starts), np.int32)
        live = np.arange(len(starts))
        at = 0
        while len(live):
            live = live[starts[live] + at < ends[live]]
            state[live] = self.table[state[live], symbols[starts[live] + at]]
            live = live[state[live] > 0]
            at += 1
        return self.term[state], self.edits[state]


def _alphabet(terms: list[str]) -> list[str]:
    return sorted({c for t in terms for c in t})


def _symbols(alphabet: list[str]) -> np.ndarray:
    """The symbol of every code point; 0 is a character that no term holds."""
    out = np.zeros(0x110000, np.min_scalar_type(len(alphabet)))
    out[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
    return out


class Automata:
    """A lexicon of any size, ``together`` terms to an automaton; finds what one automaton of all terms finds.

    All parts read one alphabet, so a text is turned into symbols once.
    """

    def __init__(self, terms: list[str], fuzzy_from: int, together: int):
        self.alphabet = _alphabet(terms)
        self.parts = [(k, Automaton(terms[k : k + together], fuzzy_from, self.alphabet)) for k in range(0, len(terms), together)]

    def match(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, symbols: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of the terms of a word the one with the fewest edits, then the first one."""
        text = (_symbols(self.alphabet) if symbols is None else symbols)[points]
        term, edits = np.full(len(starts), -1, np.int32), np.zeros(len(starts), np.int32)
        for first, auto in self.parts:
            found, made = auto.walk(text, starts, ends)
            better = (found >= 0) & ((term < 0) | (made < edits))
            term[better], edits[better] = found[better] + first, made[better]
        return term, edits


FEATURES = ("abuse", "strongest", "quoted", "misspelled", "density")


def _words(points: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters, and runs of other characters than blanks that have something else between their first and last letter.

    The latter are words with a sign or digit put in (``st*pid``); the punctuation around them is not theirs.
    """

    def runs(mask):
        edge = np.diff(np.concatenate(([False], mask, [False])).astype(np.int8))
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    starts, ends = runs(letter)
    wide, until = runs((points > 32) & (points != 0xA0))
    # from the first letter of the run to the last one
    first, last = np.searchsorted(starts, wide), np.searchsorted(ends, until, side="right") - 1
    several = last > first
    more = starts[first[several]], ends[last[several]]
    starts, ends = np.concatenate((starts, more[0])), np.concatenate((ends, more[1]))
    order = np.lexsort((ends, starts))
    return starts[order], ends[order]


def _features(terms: list[str], strength: np.ndarray, s: Settings, sent=None):
    """``sent`` is a broadcast of the automata, which are built once; without it each task builds them."""

    def work():
        auto = None
        if terms:
            auto = sent.value if sent is not None else Automata(terms, s.fuzzy_from, s.together)
            symbols = _symbols(auto.alphabet)

        def make(column):
            texts = [(x or "").lower() for x in column.to_pylist()]
            out = np.zeros((len(texts), len(FEATURES)))
            if auto is None:
                return [list(out)]
            points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
            begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
            letter = letters()[points]
            starts, ends = _words(points, letter)
            row = np.searchsorted(begin, starts, side="right") - 1
            term, edits = auto.match(points, starts, ends, symbols)
            words = np.bincount(row, minlength=len(texts))
            hit = np.flatnonzero(term >= 0)
            marks = np.concatenate(([0], np.cumsum(np.isin(points, _QUOTES))))
            first = np.searchsorted(row, row[hit])
            last = first + words[row[hit]] - 1
            before, after = np.maximum(hit - CONTEXT, first), np.minimum(hit + CONTEXT, last)
            quoted = (marks[starts[hit]] > marks[starts[before]]) & (marks[ends[after]] > marks[ends[hit]])
            close = (marks[starts[hit]] > marks[np.maximum(starts[hit] - 1, 0)]) & (marks[np.minimum(ends[hit] + 1, len(points))] > marks[ends[hit]])
            quoted |= close
            power = strength[term[hit]] * np.where(edits[hit] > 0, 0.5, 1.0)
            add = lambda v: np.bincount(row[hit], weights=v, minlength=len(texts))
            abuse, held = add(power * ~quoted), add(power * quoted)
            np.maximum.at(out[:, 1], row[hit], power * ~quoted)
            out[:, 0], out[:, 2], out[:, 3] = np.log1p(abuse), np.log1p(held), np.log1p(add((edits[hit] > 0) & ~quoted))
            out[:, 4] = np.minimum(100 * abuse / np.maximum(words, 1), 10) / 10
            return [list(out)]

        return make

    return work


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the constant is not shrunk."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _heard(rows: DataFrame, s: Settings) -> tuple[DataFrame, int, int]:
    """Words with the toxic and the other classes of near-copies that hold them, and the number of classes of each label.

    A class counts once a label, however many copies it has; it holds the words of all its texts.
    """
    near = jaccard.near_duplicates(rows.select("_key", "_text"), "_key", "_text")
    near = materialize(near.groupBy("_key", F.col("class_id").alias("class")).agg(F.count(F.lit(1)).alias("n")), "toxicity-classes")
    several = near.groupBy("class").agg(F.sum("n").alias("n")).filter("n > 1").select("class")
    copied = materialize(near.join(several, "class").select("_key", "class"), "toxicity-copied")
    rows = rows.join(checked_broadcast(copied, "2"), "_key", "left").select("class", "_label", "_text")
    word = F.explode(F.array_distinct(F.split(F.lower("_text"), r"[^\p{L}]+"))).alias("word")
    counts = F.sum("_label").alias("bad"), F.sum(1 - F.col("_label")).alias("good")

    def counted(rows, *by):
        alone, classes = rows.filter("class is null"), rows.filter("class is not null").distinct()
        both = alone.groupBy(*by).agg(*counts).unionByName(classes.groupBy(*by).agg(*counts))
        return both.groupBy(*by).agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))

    words = rows.select("class", "_label", word).filter(F.length("word") >= s.shortest)
    total = counted(rows.select("class", "_label")).first()
    return materialize(counted(words, "word"), "toxicity-words"), total["bad"], total["good"]


def _lexicon(rows: DataFrame, s: Settings) -> tuple[list[str], np.ndarray]:
    """Every word whose smoothed odds reach ``least_odds`` and whose support chance does not explain, with its log odds.

    Under chance a word's classes are toxic as often as all classes are. The Chernoff bound on its toxic classes, times the number
    of words heard, must be at most 1, so the support a term needs follows from the labels and not from a fixed share or number.
    """
    heard, bad, good = _heard(rows, s)
    n, rate = F.col("bad") + F.col("good"), bad / (bad + good)
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * p))).otherwise(0.0)
    odds = (F.col("bad") + 0.5) / (bad + 1) * (good + 1) / (F.col("good") + 0.5)
    support = part("bad", rate) + part("good", 1 - rate)
    chosen = heard.withColumn("odds", odds).filter((F.col("odds") >= s.least_odds) & (support >= float(np.log(max(heard.count(), 1)))))
    chosen = chosen.orderBy(F.desc(F.col("bad") * F.log("odds")), "word").limit(s.most_terms + 1).collect()
    if len(chosen) > s.most_terms:
        raise ValueError(f"more than {s.most_terms} terms; raise Settings.most_terms")
    return [r["word"] for r in chosen], np.log([r["odds"] for r in chosen]) if chosen else np.zeros(0)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """At most about ``s.rows`` documents of each label, with the label and ``_total``, the number of documents that have it.

    Labels are counted and picked before any text is read, so the texts are neither shuffled nor stored as a whole. A document
    with both labels has none.
    """
    agreed = labels.filter(f"`{label_col}` in (0, 1)").groupBy(id_col).agg(F.min(label_col).cast("int").alias(label_col), F.max(label_col).cast("int").alias("_other"))
    agreed = agreed.filter(F.col(label_col) == F.col("_other")).drop("_other")
    totals = agreed.groupBy(label_col).agg(F.count(F.lit(1)).alias("_total"))
    picked = materialize(bounded_sample(agreed, label_col, s.rows, id_col).join(checked_broadcast(totals, "2"), label_col), "toxicity-picked")
    return docs.join(checked_broadcast(picked, "3"), id_col)


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", s: Settings = Settings()) -> Model:  # noqa: B008
    """Learn the lexicon, the strength of its terms and the weights of the context features from labelled ``rows``.

    ``rows`` is what ``labelled`` returns, or any table with texts and labels, of which about ``s.rows`` of each label are taken. The lexicon is counted over them,
    each class of near-copies once, so no number of copies makes a word a term; a term has ``s.shortest`` letters or more.
    Labels other than 0 and 1 are left out. Without both labels there is no lexicon and every score is the share of label 1.
    """
    total = F.col("_total") if "_total" in rows.columns else F.lit(None)
    rows = rows.select(F.col(id_col).cast("string").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.col(label_col).cast("int").alias("_label"), total.cast("long").alias("_total"))
    rows = rows.filter("_label in (0, 1)")
    counted = {r["_label"]: (r["n"], r["total"]) for r in rows.groupBy("_label").agg(F.count(F.lit(1)).alias("n"), F.max("_total").alias("total")).collect()}
    sample = rows if all(t is not None for _, t in counted.values()) else bounded_sample(rows, "_label", s.rows, "_id")
    sample = materialize(sample.withColumn("_key", F.xxhash64("_text")), "toxicity-labelled")
    totals = {r["_label"]: r["count"] for r in sample.groupBy("_label").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        rate = (bad + 0.5) / (bad + good + 1)
        return Model([], np.zeros(0), np.array([0.0] * len(FEATURES) + [np.log(rate / (1 - rate)) if bad + good else 0.0]), s)
    terms, strength = _lexicon(sample, s)
    sent = _sent(sample, terms, s)
    seen = map_text(sample.select("_text", "_label"), "_text", _features(terms, strength, s, sent), [T.StructField("x", T.ArrayType(T.DoubleType()))]).collect()
    x, y = np.array([r["x"] for r in seen]), np.array([r["_label"] for r in seen], float)
    # the sample keeps all of the rarer label: weigh the constant back to the labels' share
    share = {label: n if total is None else total for label, (n, total) in counted.items()}
    w = _logistic(x, y)
    w[-1] += np.log(share[1] / share[0]) - np.log(bad / good)
    return Model(terms, strength, w, s, sent)


def _sent(rows: DataFrame, terms: list[str], s: Settings):
    """The automata, built once and sent to every executor once; their number is bounded by ``s.most_terms``."""
    return rows.sparkSession.sparkContext.broadcast(Automata(terms, s.fuzzy_from, s.together)) if terms else None


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``score`` (probability of label 1), ``predicted`` and the context features to ``docs``; one pass, no shuffle.

    Null and empty texts hold no term and get the score of such texts. The text alone decides, so repeated rows get equal
    results and null ids do no harm. Other columns are kept; columns of a result's name are replaced.
    """
    docs = docs.drop("score", "predicted", *FEATURES)
    fields = [T.StructField("_x", T.ArrayType(T.DoubleType()))]
    out = map_text(packed(docs, text_col), "_text", _features(model.terms, model.strength, model.settings, model.sent), fields, drop_text=False)
    linear = F.lit(float(model.weights[-1]))
    for i, w in enumerate(model.weights[:-1]):
        linear += F.col("_x")[i] * float(w)
    score = (1 / (1 + F.exp(-linear))).alias("score")
    features = [F.col("_x")[i].alias(c) for i, c in enumerate(FEATURES)]
    return unpacked(out, docs.columns, text_col, [score, (linear >= 0).cast("int").alias("predicted"), *features])
