"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermatch.llm.common import add_columns, bounded_sample, map_text, materialize

#: Label of a text without letters.
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """``rows`` bounds the labelled rows of each language that the weights are fitted on, ``languages`` the distinct labels
    (more are an error). Document frequencies are taken over all labelled rows."""

    sizes: tuple[int, ...] = (1, 2, 3)
    buckets: int = 1 << 14
    rows: int = 1_500
    languages: int = 512
    shards: int = 6
    rounds: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-4


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # languages x buckets
    idf: np.ndarray
    temperature: float
    settings: Settings


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def counts(text: str | None, s: Settings) -> np.ndarray | None:
    """Hashed counts of character n-grams of a text in lower case, non-letters joined to one blank; null if it has no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[points]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first non-letter after a letter stays, as a blank
    points = np.where(letter, points, 32)[keep].astype(np.uint64)
    points = np.concatenate((np.array([32], np.uint64), points))
    out = np.zeros(s.buckets)
    shift = np.uint64(64 - (s.buckets.bit_length() - 1))
    h = np.zeros(len(points), np.uint64)
    for n in range(1, max(s.sizes) + 1):
        h = (h[: len(points) - n + 1] + points[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in s.sizes:
            out += np.bincount(((h * np.uint64(0xD6E8FEB86659FD93)) >> shift).astype(np.int64), minlength=s.buckets)
    return out


def _vector(c: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(c)
    v = (1 + np.log(c[at])) * idf[at]
    return at, v / (np.sqrt(v @ v) or 1.0)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _solve(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    """Weights that follow the regularised leader: zero where the gradient sum stays below ``l1``."""
    return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))


def _frequencies(rows: DataFrame, s: Settings) -> tuple[np.ndarray, int]:
    """Documents per bucket, over all rows: each task adds up its own, Spark adds up the tasks."""

    def run(batches):
        df = np.zeros(s.buckets + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                c = counts(text.as_py(), s)
                if c is not None:
                    df[:-1] += c > 0
                    df[-1] += 1
        where = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(df[where])], names=["bucket", "n"])

    out = np.zeros(s.buckets + 1, np.int64)
    for r in rows.select("_text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out[:-1], int(out[-1])


def _round(train: DataFrame, state: tuple[np.ndarray, np.ndarray], idf: np.ndarray, languages: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """One pass of FTRL-proximal over every shard from the same state; the shards' states are averaged.

    The sample is bounded, and so are its ``shards`` groups; as many states reach the driver, however the data are partitioned.
    """
    shape = state[0].shape

    def run(rows):
        z, n = state[0].copy(), state[1].copy()
        rows = rows.sort_by([("_order", "ascending"), ("_lang", "ascending")])
        for text, lang in zip(rows.column("_text").to_pylist(), rows.column("_lang").to_pylist(), strict=True):
            c = counts(text, s)
            if c is None:
                continue
            at, v = _vector(c, idf)
            w = _solve(z[:, at], n[:, at], s)
            p = _softmax(w @ v)
            p[languages.index(lang)] -= 1
            g = p[:, None] * v
            more = n[:, at] + g * g
            z[:, at] += g - (np.sqrt(more) - np.sqrt(n[:, at])) / s.alpha * w
            n[:, at] = more
        return pa.table({"z": pa.array([z.tobytes()], pa.binary()), "n": pa.array([n.tobytes()], pa.binary())})

    got = train.groupBy("_shard").applyInArrow(run, "z binary, n binary").collect()
    return tuple(np.mean([np.frombuffer(r[i]).reshape(shape) for r in got], axis=0) for i in (0, 1)) if got else state


def _temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least log loss against smoothed targets, by golden section on its logarithm; 1 without rows.

    Of ``n`` held-out rows that are all told right nobody knows more than that about one in ``n + 2`` is wrong, so that much of every target goes
    to the other languages. Without it, separable languages would drive the temperature to 0 and every score to 1.
    """
    n, k = logits.shape if len(truth) else (0, 0)
    if n == 0 or k < 2:
        return 1.0
    target = np.full((n, k), 1 / (n + 2) / (k - 1))
    target[np.arange(n), truth] = 1 - 1 / (n + 2)
    top = logits - logits.max(axis=1, keepdims=True)

    def loss(t):
        x = top / np.exp(t)
        return -(target * (x - np.log(np.exp(x).sum(axis=1, keepdims=True)))).sum(axis=1).mean()

    ends = a, b = np.log(1e-6), np.log(1e6)
    r = (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    if min(a - ends[0], ends[1] - b) < 0.01 and np.ptp(logits) > 0:
        raise ValueError("no temperature between 1e-6 and 1e6 fits the held-out rows")
    return float(np.exp((a + b) / 2))


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", s: Settings = Settings()) -> Model:  # noqa: B008
    """Fit on ``rows`` with a non-null language. Without any such row the model knows no language."""
    rows = rows.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).filter("_lang is not null")
    languages = sorted(r[0] for r in rows.select("_lang").distinct().limit(s.languages + 1).collect())
    if len(languages) > s.languages:
        raise ValueError(f"more than {s.languages} languages; raise Settings.languages if a model of that width fits the driver")
    df, total = _frequencies(rows, s) if languages else (np.zeros(s.buckets, np.int64), 0)
    idf = np.log((1 + total) / (1 + df)) + 1
    shape = (len(languages), s.buckets)
    z, n = np.zeros(shape), np.zeros(shape)
    temperature = 1.0
    if total:
        sample = bounded_sample(rows, "_lang", s.rows, "_id").withColumn("_part", F.pmod(F.xxhash64("_id", F.lit("part")), F.lit(5)))
        sample = materialize(sample.select("_text", "_lang", "_part", F.xxhash64("_id", "_text").alias("_order")), "langid-sample")
        shards = sample.filter("_part > 0").withColumn("_shard", F.pmod(F.col("_order"), F.lit(s.shards)))
        for _ in range(s.rounds):
            z, n = _round(shards, (z, n), idf, languages, s)
        model = Model(languages, _solve(z, n, s), idf, 1.0, s)
        held = map_text(sample.filter("_part = 0"), "_text", _scores(model, True), [T.StructField("logits", T.ArrayType(T.DoubleType()))])
        held = held.filter("logits is not null").select("_lang", "logits").collect()
        temperature = _temperature(np.array([r["logits"] for r in held]), np.array([languages.index(r["_lang"]) for r in held], int))
    return Model(languages, _solve(z, n, s), idf, temperature, s)


def _scores(model: Model, raw: bool = False):
    def work():
        weights = np.ascontiguousarray(model.weights.T)

        def make(column):
            langs, scores = [], []
            for text in column.to_pylist():
                c = counts(text, model.settings)
                if c is None or not model.languages:
                    langs.append(None if raw else UNKNOWN)
                    scores.append(0.0)
                    continue
                at, v = _vector(c, model.idf)
                x = v @ weights[at]
                p = _softmax(x / model.temperature)
                langs.append(x if raw else model.languages[int(p.argmax())])
                scores.append(float(p.max()))
            return [langs] if raw else [langs, scores]

        return make

    return work


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (its calibrated probability) to ``docs``.

    Null and empty texts and texts without letters are ``und`` with score 0, as is every text if the model knows no
    language. The text alone decides: repeated rows get equal results, null ids do no harm. Other columns are kept; columns of
    a result's name are replaced.
    """
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return add_columns(docs, text_col, _scores(model), fields)


def has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
