"""Benchmark decontamination: spaced seeds find passages of a benchmark in spite of substituted words."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermatch.llm.common import checked_broadcast, map_text, materialize, packed, text_bytes, unpacked
from ledgermatch.llm.lines import BLOCK, SHAPE, Filters, merged, positions_of, written
from ledgermatch.llm.words import SEPARATOR, grams, mixed, spans_rows, split_words

#: Positions of eight words that each mask looks at. Fixed together with the two below: any two substitutions in 13 words
#: leave one of these masks untouched somewhere (a test proves it).
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SPAN = 8
#: A passage is ``STRETCH`` words of the benchmark (all words of a shorter item) with at most ``SUBSTITUTED`` replaced.
STRETCH, SUBSTITUTED = 13, 2
#: Item places of one seed from which on neighbouring words are added to it.
HOT = 64
#: Positions of the filter in front of the join: per seed, and at most (32 MB). A fuller filter lets more places through and loses none.
PER_SEED, MOST_POSITIONS, PROBES = 64, 1 << 28, 2
_ALNUM = SEPARATOR.copy()
_ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _tokens(column):
    """Words of lower-case texts without ASCII punctuation."""
    import pyarrow.compute as pc

    raw, at = text_bytes(pc.utf8_lower(column))
    w = split_words(raw, at, _ALNUM)
    return w, w.hashes()


def _masked(h: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    n = max(0, len(h) - SPAN + 1)
    out = np.full(n, len(mask) * 31 + mask[2], np.uint64)
    for p in mask:
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[p : p + n]
    return mixed(out)


def _seeds(h: np.ndarray, inside, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys: every mask at every place of ``SPAN`` words, and whole runs of the given lengths."""
    at, keys = [], []
    for mask in MASKS:
        place = np.flatnonzero(inside(SPAN))
        at.append(place)
        keys.append(_masked(h, mask)[place])
    for n in lengths:
        place = np.flatnonzero(inside(n))
        at.append(place)
        keys.append(mixed(grams(h, n)[place] + np.uint64(n)))
    return np.concatenate(at), np.concatenate(keys)


#: Three places around a seed, counted from its start, that one stretch around it can hold; at least three of the five words of
#: a stretch outside its seed are equal.
_AROUND = [d for d in range(SPAN - STRETCH, STRETCH) if not 0 <= d < SPAN]
_TRIPLES = [t for t in combinations(_AROUND, STRETCH - SPAN - SUBSTITUTED) if max(0, -t[0]) + max(0, t[-1] - SPAN + 1) <= STRETCH - SPAN]


def _widened(h: np.ndarray, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of seeds with three words around them, and the places of the seeds. ``h`` is one text."""
    keys, places = [], []
    for triple in _TRIPLES:
        fits = np.flatnonzero((at + triple[0] >= 0) & (at + triple[-1] < len(h)))
        wide = key[fits].copy()
        for d in triple:
            wide = mixed(wide * np.uint64(0x9E3779B97F4A7C15) + h[at[fits] + d] + np.uint64(d + STRETCH))
        keys.append(wide)
        places.append(at[fits])
    return np.concatenate(keys), np.concatenate(places)


def _overlap(item: np.ndarray, text: np.ndarray, shift: int) -> int:
    """Words of the item that equal the text's at ``shift`` inside stretches with few substitutions."""
    a, b = max(0, -shift), min(len(item), len(text) - shift)
    same = np.zeros(len(item), bool)
    same[a:b] = item[a:b] == text[a + shift : b + shift]
    size, wrong = (STRETCH, SUBSTITUTED) if len(item) >= STRETCH else (len(item), 0)
    good = np.flatnonzero(np.convolve(same, np.ones(size, int), "valid") >= size - wrong)
    if not len(good):
        return 0
    cover = np.zeros(len(item) + 1, int)
    np.add.at(cover, good, 1)
    np.add.at(cover, good + size, -1)
    return int((same & (np.cumsum(cover)[:-1] > 0)).sum())


def _item_seeds():
    """Per item: its words' hashes, and places and keys of its seeds; an item shorter than a stretch has one seed, all its words."""

    def make(column):
        w, h = _tokens(column)
        hashes, places, keys = [], [], []
        for a, b in zip(w.first, w.first[1:], strict=False):
            own = h[a:b]
            long = len(own) >= STRETCH
            at, key = _seeds(own, lambda n, own=own: np.ones(max(0, len(own) - n + 1), bool), []) if long else (np.zeros(1, int), np.zeros(0, np.uint64))
            if not long and len(own):
                key = mixed(grams(own, len(own)) + np.uint64(len(own)))
            hashes.append(own.view(np.int64))
            places.append(at[: len(key)])
            keys.append(key.view(np.int64))
        return [hashes, places, keys]

    return make


def _filter(seeds: DataFrame, positions: int) -> dict[int, bytes]:
    def build(batches):
        own = Filters()
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            own.add(np.unique(positions_of(keys, positions, PROBES)))
        yield from written(own)

    return merged(seeds.select("key").mapInArrow(build, SHAPE), "once")


def _hits(blocks: dict[int, bytes], positions: int, lengths: list[int]):
    """Per text: places and keys that pass the filter."""

    def work():
        bits = np.zeros(positions // 8, np.uint8)
        for number, block in blocks.items():
            bits[number * (BLOCK // 8) : (number + 1) * (BLOCK // 8)] = np.frombuffer(block, np.uint8)

        def make(column):
            w, h = _tokens(column)
            at, keys = _seeds(h, lambda n: spans_rows(w, n), lengths)
            for probe in range(PROBES):
                place = positions_of(keys, positions, PROBES)[:, probe].astype(np.int64)
                fine = np.flatnonzero((bits[place >> 3] >> (7 - (place & 7))) & 1)
                at, keys = at[fine], keys[fine]
            row = w.doc[at]
            order = np.argsort(row, kind="stable")
            cut = np.searchsorted(row[order], np.arange(len(column) + 1))
            parts = [order[a:b] for a, b in zip(cut, cut[1:], strict=False)]
            return [[at[p] - w.first[i] for i, p in enumerate(parts)], [keys[p].view(np.int64) for p in parts]]

        return make

    return work


def _wide(rows: DataFrame, own: list[str]) -> DataFrame:
    """Rows with ``text`` and ``hot``, places and keys of hot seeds, as one row per widened key."""
    schema = T.StructType([rows.schema[c] for c in own] + [T.StructField("at", T.LongType()), T.StructField("key", T.LongType())])

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                _, h = _tokens(batch.column(names.index("text")).slice(i, 1))
                hot = batch.column(names.index("hot"))[i].as_py()
                key, at = _widened(h, np.array([x["key"] for x in hot], np.int64).view(np.uint64), np.array([x["at"] for x in hot], np.int64))
                for a in range(0, len(key), 50_000):
                    n = len(key[a : a + 50_000])
                    same = [batch.column(names.index(c)).slice(i, 1).take(pa.array(np.zeros(n, np.int64))) for c in own]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(at[a : a + n]), pa.array(key[a : a + n].view(np.int64))], names=schema.names)

    return rows.mapInArrow(run, schema)


def _laid_over(rows: DataFrame) -> DataFrame:
    """Rows with ``text`` and ``found``, items with shift and length: the text's words where the item lies."""
    schema = "tkey string, item long, shift long, words array<long>"

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                _, h = _tokens(batch.column(names.index("text")).slice(i, 1))
                found = batch.column(names.index("found"))[i].as_py()
                for a in range(0, len(found), 1_000):
                    part = found[a : a + 1_000]
                    words = []
                    for x in part:
                        own = np.zeros(x["size"], np.uint64)  # no word has hash 0 at a place beyond the text's ends
                        low, high = max(0, -x["shift"]), min(x["size"], len(h) - x["shift"])
                        own[low:high] = h[x["shift"] + low : x["shift"] + high]
                        words.append(own.view(np.int64))
                    cells = [pa.array([batch.column(names.index("tkey"))[i].as_py()] * len(part), pa.string())]
                    cells += [pa.array([x[c] for x in part], pa.int64()) for c in ("item", "shift")]
                    yield pa.RecordBatch.from_arrays([*cells, pa.array(words, pa.list_(pa.int64()))], names=["tkey", "item", "shift", "words"])

    return rows.mapInArrow(run, schema)


def _compared(rows: DataFrame) -> DataFrame:
    """Rows with the words of an item and of a text below it: how many of them count."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            one, other = (batch.column(names.index(c)) for c in ("hashes", "words"))
            n = [_overlap(*(x[i].values.to_numpy(zero_copy_only=False) for x in (one, other)), 0) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(names.index(c)) for c in ("tkey", "item")] + [pa.array(n, pa.int64())], names=["tkey", "item", "n"])

    return rows.mapInArrow(run, "tkey string, item long, n long")


def leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least_words: int = SPAN) -> DataFrame:
    """Add ``leak_items`` and ``leak_words`` to ``docs``: the benchmark items found in a text, and how many of their words.

    Words are compared in lower case without ASCII punctuation. An item counts as found where ``STRETCH`` words of it stand in a
    text but for ``SUBSTITUTED``. Items shorter than that must agree in every word. ``least_words`` is the number of words from which on
    an item is evidence at all.

    1. Every run of eight words of an item gives a key under each mask, a short item one key of all its words. These are a table.
    2. The documents are mapped: places whose keys pass a filter of the benchmark's keys, of bounded size, become rows, and are joined with
       that table by key. A key of more than ``HOT`` item places, a phrase that many items share, is not joined itself: it is widened by three words around
       it, in all ways that a stretch allows, which any found stretch shares at least one of.
    3. For each text, item and shift the item is laid over the text's words there, in one row of both, and words are counted.

    Neither documents nor benchmark pass through the driver. Texts move only if they hold a candidate, and only if those are too many to broadcast their keys.

    Null and empty texts hold nothing; null item ids or texts and an empty benchmark find nothing. Repeated items are each
    reported; repeated rows get the same result. Other columns are kept; a column of a result's name is replaced.
    """
    docs = docs.drop("leak_items", "leak_words")
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).dropna()
    items = materialize(items.withColumn("item", F.monotonically_increasing_id()), "leaks-items")
    lists = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("hashes", "places", "keys")]
    known = materialize(map_text(items, "t", _item_seeds, lists, drop_text=False).filter(F.size("hashes") >= least_words), "leaks-known")
    seeds = known.select("item", F.size("hashes").cast("long").alias("size"), F.explode(F.arrays_zip("places", "keys")).alias("x"))
    seeds = materialize(seeds.select("item", "size", F.col("x.places").alias("place"), F.col("x.keys").alias("key")), "leaks-seeds")
    number = seeds.count()
    lengths = [r["size"] for r in seeds.filter(F.col("size") < STRETCH).select("size").distinct().collect()]
    positions = min(max(1 << int(number * PER_SEED).bit_length(), BLOCK), MOST_POSITIONS)

    tkey = F.md5(F.col("_text").cast("binary"))
    texts = docs.select(F.col(f"`{text_col}`").alias("_text")).filter("_text is not null").select(tkey.alias("tkey"), F.col("_text").alias("text"))
    made = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("at", "key")]
    hits = map_text(texts, "text", _hits(_filter(seeds, positions), positions, lengths), made).filter(F.size("at") > 0)
    hits = hits.select("tkey", F.explode(F.arrays_zip("at", "key")).alias("x")).select("tkey", "x.at", "x.key").distinct()
    counts = seeds.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    counts = counts.select("key", ((F.col("n") > HOT) & (F.col("size") >= STRETCH)).alias("hot"))
    hits = materialize(hits.join(checked_broadcast(counts, "2"), "key"), "leaks-hits")

    met = lambda places, table: places.join(checked_broadcast(table, "4"), "key").select("tkey", "item", "size", (F.col("at") - F.col("place")).alias("shift"))
    found = met(hits.filter("not hot"), seeds)
    hot = hits.filter("hot")
    if not hot.isEmpty():
        in_texts = hot.groupBy("tkey").agg(F.collect_list(F.struct("at", "key")).alias("hot"))
        in_texts = _wide(texts.join(checked_broadcast(in_texts, "4 + 2 * size(hot)"), "tkey").dropDuplicates(["tkey"]), ["tkey"])
        in_items = seeds.join(checked_broadcast(counts.filter("hot"), "2"), "key").groupBy("item", "size").agg(F.collect_list(F.struct(F.col("place").alias("at"), "key")).alias("hot"))
        in_items = _wide(in_items.join(items.select("item", F.col("t").alias("text")), "item"), ["item", "size"]).withColumnRenamed("at", "place")
        found = found.unionByName(met(in_texts.distinct(), materialize(in_items.distinct(), "leaks-wide")))
    found = found.distinct().groupBy("tkey", F.pmod(F.xxhash64("item"), F.lit(16)).alias("part")).agg(F.collect_list(F.struct("item", "size", "shift")).alias("found"))
    found = materialize(found, "leaks-candidates")

    with_text = texts.join(checked_broadcast(found.select("tkey").distinct(), "4"), "tkey", "left_semi").dropDuplicates(["tkey"]).join(found, "tkey")
    laid = _laid_over(with_text).join(checked_broadcast(known.select("item", "hashes"), "2 + size(hashes)"), "item")
    proven = _compared(laid).filter("n > 0").groupBy("tkey", "item").agg(F.max("n").alias("n"))
    proven = proven.join(checked_broadcast(known.select("item", "i"), "2"), "item")
    proven = materialize(proven.groupBy("tkey").agg(F.array_sort(F.collect_list(F.struct(F.col("i").alias("item"), F.col("n").alias("words")))).alias("found")), "leaks-found")

    rows = packed(docs, text_col)
    out = rows.join(checked_broadcast(proven, "4 + 2 * size(found)"), tkey == F.col("tkey"), "left")
    lists = [F.coalesce(F.col(f"found.{c}"), F.array().cast("array<long>")).alias(f"leak_{n}") for c, n in (("item", "items"), ("words", "words"))]
    return unpacked(out, docs.columns, text_col, lists)
