"""Resampling a corpus towards a target: importance weights from hashed features, and an exact draw of the best scores."""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermatch.llm.common import map_text, materialize
from ledgermatch.operators.ordinal import ordinal


@dataclass(frozen=True)
class Settings:
    longest: int = 1  # words of the longest feature
    buckets: int = 10_000
    seed: int = 2024
    least_words: int = 20
    percent: int = 10
    #: Thresholds that one counting job tries at once.
    ways: int = 16


#: A-Z in lower case; other ASCII than letters and digits becomes a space.
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(128)).lower() + bytes(range(128, 256))
#: Ids that are null stand behind all others.
_NO_ID = (1 << 63) - 1


def _buckets(raw: bytes, s: Settings) -> tuple[np.ndarray, int]:
    """The bucket of every feature of a text, and its number of words."""
    words = raw.translate(_PLAIN).split()
    runs = [words] + [[b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] for n in range(2, s.longest + 1)]
    return np.concatenate([np.fromiter(map(crc32, r), np.uint32, len(r)) for r in runs]) % s.buckets, len(words)


def _raw(texts: pa.Array) -> list[bytes]:
    return texts.fill_null("").cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def bucket_counts(docs: DataFrame, text: str, s: Settings) -> np.ndarray:
    """How often features fall into each bucket, over all rows. A task sends one row a bucket; ``s.buckets`` numbers reach the driver."""

    def count(batches):
        seen = np.zeros(s.buckets, np.int64)
        for batch in batches:
            for raw in _raw(batch.column(0)):
                seen += np.bincount(_buckets(raw, s)[0], minlength=s.buckets)
        hit = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(seen[hit], pa.int64())], names=["bucket", "n"])

    rows = docs.select(F.col(f"`{text}`")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(s.buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier a bucket is in the target, smoothed by one a bucket, floored."""
    size = float(len(corpus))
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def _weighed(docs: DataFrame, doc_id: str, text: str, gain: np.ndarray, s: Settings) -> DataFrame:
    """``(_row, _id, n_features, weight, score, _words)`` per document."""

    def work():
        def make(texts: pa.Array) -> list:
            features, weights, words = [], [], []
            for raw in _raw(texts):
                at, n = _buckets(raw, s)
                features.append(len(at))
                weights.append(int(gain[at].sum()) // len(at) if len(at) else 0)
                words.append(n)
            return [features, weights, words]

        return make

    others = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias("_")).alias("_row"), F.col(f"`{text}`").alias("_text"))
    long = [T.StructField(c, T.LongType()) for c in ("n_features", "weight", "_words")]
    rows = map_text(rows, "_text", work, long)
    own = F.col("_row").getField(doc_id)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{s.seed}:"), F.coalesce(own.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    return rows.withColumn("score", F.col("weight") + noise.cast("long")).withColumn("_id", F.coalesce(own.cast("long"), F.lit(_NO_ID)))


def cutoff(rows: DataFrame, column: str, places: int, descending: bool, ways: int = 16) -> tuple[int, int]:
    """The value at which ``places`` rows are reached, counted from the best, and the rows strictly better than it.

    Every job counts exactly, over all rows, how many are at least as good as each of ``ways - 1`` thresholds, and the interval
    shrinks to one of ``ways`` parts. There must be ``places`` rows, and one at least.
    """
    sign = -1 if descending else 1
    ends = rows.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    low, high = sorted((sign * ends["a"], sign * ends["b"]))
    better = 0
    # the wanted value lies in low..high; ``better`` rows are below low
    while low < high:
        marks = sorted({low + (high - low) * k // ways for k in range(ways)})
        key = F.col(column) * F.lit(sign)
        counts = rows.agg(*[F.count(F.when(key <= F.lit(m), 1)).alias(f"n{i}") for i, m in enumerate(marks)]).first()
        reached = [(m, counts[f"n{i}"]) for i, m in enumerate(marks)]
        short = [(m, n) for m, n in reached if n < places]
        enough = [m for m, n in reached if n >= places]
        if short:
            low, better = short[-1][0] + 1, short[-1][1]
        high = enough[0] if enough else high
    return sign * low, better


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", s: Settings | None = None) -> DataFrame:
    """The columns of ``docs`` but the text, and ``n_features``, ``weight``, ``score`` and ``rank``.

    Words are runs of ASCII letters and digits, with A-Z in lower case, and of all characters beyond ASCII. Features are runs
    of 1 to ``longest`` words. A feature's bucket is ``crc32`` modulo ``buckets``. A document's weight is the floored mean of the gains of its
    features; its score adds noise fixed by seed and id, so that the best scores are a draw in proportion to the weights. Of the documents
    with ``least_words`` words, ``percent`` in a hundred are drawn, ties to the smaller id.

    Texts are mapped twice and never shuffled. The scored rows are written once. The cutoff is found by bisection with exact counts
    over them, first of the score, then of the ids that share it. Drawn rows are range-partitioned for their ranks, so no task holds them all.

    A text that is null or has no word has weight 0. A null id counts as empty text in the noise and stands behind all ids. Rows
    that repeat score and id take places in any order among themselves. An empty table or target gives empty or smoothed counts,
    never an error. Ids are integers. Columns of the results' names are replaced.
    """
    s = s or Settings()
    names = ("n_features", "weight", "score", "rank")
    docs = docs.drop(*names)
    gain = gains(bucket_counts(docs, text, s), bucket_counts(target, target_text, s))
    rows = materialize(_weighed(docs, doc_id, text, gain, s), "resample-scores")
    able = rows.filter(F.col("_words") >= s.least_words)
    places = s.percent * able.count() // 100
    rank = F.lit(None).cast("long").alias("rank")
    if places:
        score, better = cutoff(able, "score", places, True, s.ways)
        last, _ = cutoff(able.filter(F.col("score") == score), "_id", places - better, False, s.ways)
        drawn = (F.col("_words") >= s.least_words) & ((F.col("score") > score) | ((F.col("score") == score) & (F.col("_id") <= last)))
        ranked = ordinal(rows.filter(drawn), "score desc, _id, n_features", "_rank", unique=True)
        # rows that repeat the last id may be more than the places that are left
        ranked = ranked.select("*", F.when(F.col("_rank") <= places, F.col("_rank")).cast("long").alias("rank")).drop("_rank")
        rows = ranked.unionByName(rows.filter(~drawn).select("*", rank))
    else:
        rows = rows.select("*", rank)
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c != text], *names)
