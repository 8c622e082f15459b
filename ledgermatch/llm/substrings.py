"""Substring dedup: seed and extend over winnowed anchors, keeping repeats of at least ``window`` words."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermatch.llm.common import checked_broadcast, map_text, materialize, text_bytes
from ledgermatch.llm.words import grams, mixed, slide, spans_rows, split_words, stretches

#: Words of a seed. A window of ``window`` words holds ``window - SEED + 1`` seeds; the least hash among them is its anchor.
SEED = 22
#: Rows of one key from which on its side of a join is broadcast.
HOT = 20_000
_FIELD = T.StructField


def _hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _lows(w, window: int):
    """Seed hashes, the least of them in every window, and whether a window lies within one row."""
    seeds = grams(w.hashes(), SEED)
    return seeds, slide(seeds, window - SEED + 1, np.minimum), spans_rows(w, window)


def _seed(window: int):
    """Per text: words, a 128-bit key of the word sequence, the hash of all words joined, distinct anchors."""
    width = window - SEED + 1

    def make(column):
        raw, at = text_bytes(column)
        w = split_words(raw, at)
        words = [x.split() for x in (raw[a:b].tobytes() for a, b in zip(at, at[1:], strict=False))]
        joined = [b" ".join(x) for x in words]
        seeds, low, valid = _lows(w, window)
        if valid.any():
            low = np.where(valid, low, 0)
            pad = np.zeros(width - 1, low.dtype)
            chosen = np.flatnonzero(slide(np.concatenate((pad, low, pad)), width, np.maximum) == seeds)
        else:
            chosen = np.zeros(0, int)
        cut = np.searchsorted(chosen, w.first)
        anchors = [np.unique(seeds[chosen[a:b]]).view(np.int64) for a, b in zip(cut, cut[1:], strict=False)]
        return [np.diff(w.first), [hashlib.md5(x).digest() for x in joined], [_hex(x) for x in joined], anchors]

    return make


def _anchored(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The seeds of a text, and for every window the place of its anchor: its first least seed."""
    seeds, width = grams(hashes, SEED), window - SEED + 1
    if len(seeds) < width:
        return seeds, np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(seeds, width)
    places = [windows[a : a + 65_536].argmin(axis=1) for a in range(0, len(windows), 65_536)]
    return seeds, np.concatenate(places) + np.arange(len(windows))


def _extend(window: int):
    """Per text: each shared anchor extended both ways over all windows that it anchors, as one row with a 128-bit hash of what it spans."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                w = split_words(*text_bytes(batch.column(names.index("_text")).slice(i, 1)))
                one, two = w.hashes(), w.hashes(1)
                seeds, place = _anchored(one, window)
                # the windows of an anchor lie side by side
                first = np.flatnonzero(np.diff(place, prepend=-1))
                count = np.diff(np.append(first, len(place)))
                shared = batch.column(names.index("anchors"))[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                hit = np.isin(seeds[place[first]], shared)
                first, count = first[hit], count[hit]
                anchor, offset = seeds[place[first]], (place[first] - first).astype(np.uint64)
                keys = [mixed(stretches(h, first, first + count + window - 1, k) + offset).view(np.int64) for k, h in ((1, one), (2, two))]
                for a in range(0, len(first), 50_000):
                    b = min(a + 50_000, len(first))
                    same = [batch.column(names.index(c)).slice(i, 1).take(pa.array(np.zeros(b - a, np.int64))) for c in ("_id", "_dig")]
                    cells = (first.astype(np.int32), count.astype(np.int32), anchor.view(np.int64), *keys)
                    yield pa.RecordBatch.from_arrays([*same, *(pa.array(c[a:b]) for c in cells)], names=["_id", "_dig", "start", "size", "anchor", "one", "two"])

    return run


def _windows(window: int):
    """Per text and runs of it: the windows of each run, by 128-bit hashes."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                w = split_words(*text_bytes(batch.column(names.index("_text")).slice(i, 1)))
                one, two = (grams(w.hashes(k), window, k + 1).view(np.int64) for k in (0, 1))
                for r in batch.column(names.index("runs"))[i].as_py():
                    n, at = r["size"], slice(r["start"], r["start"] + r["size"])
                    cells = [pa.array([r[c]] * n, pa.int64()) for c in ("one", "two")] + [pa.array(np.arange(n, dtype=np.int32)), pa.array(one[at]), pa.array(two[at])]
                    low = batch.column(names.index("_id")).slice(i, 1).take(pa.array(np.zeros(n, np.int64)))
                    yield pa.RecordBatch.from_arrays([*cells, low], names=["one", "two", "place", "w_one", "w_two", "_low"])

    return run


def _cut(window: int):
    """Per text and its repeated runs: merge them to maximal repeats and return what is left."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index("_text"))
            removed, kept = [], []
            for i in range(batch.num_rows):
                words = texts[i].as_py().encode().split()
                runs = batch.column(names.index("runs"))[i].values.flatten()
                start, size = (x.to_numpy(zero_copy_only=False) for x in runs)
                gone = np.zeros(len(words) + 1, np.int32)
                np.add.at(gone, start, 1)
                np.add.at(gone, start + size + window - 1, -1)
                gone = np.cumsum(gone)[:-1] > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join([x for x, g in zip(words, gone.tolist(), strict=True) if not g]))
            yield pa.RecordBatch.from_arrays([batch.column(names.index(c)) for c in ("_id", "_dig")] + [pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["_id", "_dig", "removed", "left_text"])

    return run


def _looked_up(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Join ``table``, which has one row per key and in ``_n`` the rows it will meet. Keys that meet ``HOT`` rows or more, of which there
    are few, are broadcast, so that their rows stay where they are."""
    hot = materialize(table.filter(F.col("_n") >= HOT).drop("_n"), "repeats-hot")
    cold = table.filter(F.col("_n") < HOT).drop("_n")
    if hot.isEmpty():
        return rows.join(cold, keys)
    few = checked_broadcast(hot, "70")
    return rows.join(few, keys).unionByName(rows.join(few.select(keys), keys, "left_anti").join(cold, keys))


def _with(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """Join lists to their texts. If their keys alone are few enough to broadcast, the other texts are not shuffled."""
    key = ["_id", "_dig"]
    return texts.join(checked_broadcast(lists.select(key), "2"), key, "left_semi").join(lists, key)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """Remove the words covered by a window of ``window`` words that also starts in a document with a smaller id.

    Seeds: of the hashes of ``SEED`` words, the least one of every window is its anchor, so that two equal windows have the same.
    Documents are joined on these anchors. An anchor that two documents share is extended both ways over all windows that
    it anchors, and such a run is one row with a 128-bit hash of the words it spans. Equal runs are one class with its smallest id. Where an
    anchor has one class, its windows repeat as a whole. Where it has several, which differ somewhere around the anchor, the
    windows of one run of each class are compared one by one. Runs of repeated windows are merged to maximal repeats.

    Whole copies are found by one digest each and are not extended. Every join meets one row per hash, never pairs of documents;
    counts are combined before each shuffle, and classes of many rows are broadcast, so a passage that a third of the documents share is no hot
    group.

    Returns per row: ``id_col``, ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept_text``, which is null where no word goes.
    Null or empty text: no words. A null id is neither smaller nor larger than any: such rows stay whole. Rows that repeat an
    id are compared with smaller ids only, never with each other. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_dig"), F.col(text_col).alias("_text"))
    made = [_FIELD("n_words", T.LongType()), _FIELD("seq", T.BinaryType()), _FIELD("all_sha", T.StringType()), _FIELD("anchors", T.ArrayType(T.LongType()))]
    seeded = materialize(map_text(rows, "_text", lambda: _seed(window), made), "repeats-seeds")

    firsts = seeded.groupBy("seq").agg(F.min("_id").alias("_first"))
    known = seeded.join(firsts, "seq").withColumn("_copy", F.coalesce(F.col("_first") < F.col("_id"), F.lit(False)) & (F.col("n_words") >= window))
    alone = known.filter("not _copy and _id is not null").select("_id", "_dig", F.explode("anchors").alias("anchor"))
    shared = alone.groupBy("anchor").agg(F.min("_id").alias("_low"), F.max("_id").alias("_high")).filter("_low < _high").select("anchor")
    hit = alone.join(shared, "anchor").groupBy("_id", "_dig").agg(F.collect_set("anchor").alias("anchors"))
    hit = materialize(hit, "repeats-hits")

    texts = rows.filter("_id is not null and _text is not null")
    id_type = docs.schema[id_col].dataType.simpleString()
    runs = _with(texts, hit).mapInArrow(_extend(window), f"_id {id_type}, _dig long, start int, size int, anchor long, one long, two long")
    runs = materialize(runs, "repeats-runs")

    key = ["one", "two"]
    classes = runs.groupBy("anchor", *key).agg(
        F.min("_id").alias("_first"), F.max("_id").alias("_last"), F.count(F.lit(1)).alias("_n"), F.min(F.struct("_id", "_dig", "start", "size")).alias("_one")
    )
    classes = materialize(classes, "repeats-classes")
    several = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("_classes")).filter("_classes > 1").select("anchor")
    several = materialize(several, "repeats-several")
    whole = classes.join(several, "anchor", "left_anti").filter("_first < _last").select(*key, "_n", F.col("_first").alias("_whole"))
    parts = classes.join(several, "anchor", "left_semi")
    shown = parts.groupBy("_one._id", "_one._dig").agg(F.collect_list(F.struct("_one.start", "_one.size", *key)).alias("runs"))
    made = _with(texts, shown).mapInArrow(_windows(window), f"one long, two long, place int, w_one long, w_two long, _low {id_type}")
    made = materialize(made.dropDuplicates(["one", "two", "place"]), "repeats-windows")
    seen = made.groupBy("w_one", "w_two").agg(F.min("_low").alias("_since"), F.count(F.lit(1)).alias("_n"))
    since = _looked_up(made.select(*key, "place", "w_one", "w_two"), seen, ["w_one", "w_two"])
    since = since.groupBy(*key).agg(F.collect_list(F.struct("place", "_since")).alias("_parts"))
    parts = parts.join(since, key).filter(F.array_min("_parts._since") < F.col("_last")).select(*key, "_n", "_parts")

    table = whole.unionByName(parts, allowMissingColumns=True)
    some = F.filter("_parts", lambda x: x["_since"] < F.col("_id"))
    run = lambda start, size: F.struct(start.cast("int").alias("start"), size.cast("int").alias("size"))
    again = F.when(F.col("_whole") < F.col("_id"), F.array(run(F.col("start"), F.col("size")))).otherwise(F.transform(some, lambda x: run(F.col("start") + x["place"], F.lit(1))))
    found = _looked_up(runs.drop("anchor"), table, key).withColumn("again", again).filter(F.size("again") > 0)
    found = found.groupBy("_id", "_dig").agg(F.flatten(F.collect_list("again")).alias("runs"))
    found = materialize(found, "repeats-found")

    cut = _with(texts, found).mapInArrow(_cut(window), f"_id {docs.schema[id_col].dataType.simpleString()}, _dig long, removed long, left_text binary")
    cut = cut.dropDuplicates(["_id", "_dig"])
    out = known.drop("anchors", "seq").join(cut, ["_id", "_dig"], "left")
    return out.select(
        F.col("_id").alias(id_col),
        "n_words",
        F.when(F.col("_copy"), F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("_copy"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce(F.sha2("left_text", 256), F.col("all_sha"))).alias("kept_sha256"),
        F.when(F.col("_copy"), F.lit("")).otherwise(F.col("left_text").cast("string")).alias("kept_text"),
    )
