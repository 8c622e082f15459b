"""Byte-level BPE encoding and decoding: long texts in overlapping chunks that are stitched where boundaries agree."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermatch.llm.common import give_back, map_text, materialize, packed, unpacked

#: Characters of a chunk, and of the stretch it shares with the next chunk.
CHUNK, OVERLAP = 32_768, 1_024
#: Characters that the library's own splitter is given at once; it recurses and ends the process on runs of a million blanks.
SPLIT = 100_000
_IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
_DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> list[bytes]:
    by_id = {v: k for k, v in ranks(path).items()}
    return [by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)]


def decode(ids, path: str) -> bytes:
    """The raw bytes of the ids, one after the other."""
    words = _vocabulary(path)
    return b"".join([words[i] for i in ids])


def boundaries(text: str, pattern: str) -> np.ndarray:
    """Ends of pre-tokens whose last character is no white space.

    What the pattern matches depends only on the text from the match on, and white space alone looks ahead, so the text may be cut
    here and the parts encoded on their own.
    """
    import regex

    return np.array([m.end() for m in regex.finditer(pattern, text) if not text[m.end() - 1].isspace()], np.int64)


def token_ids(text: str, path: str, pattern: str) -> list[int]:
    """Ids of a text of any length and shape: every match of the pattern encoded on its own."""
    import regex

    enc = encoder(path, pattern)
    if len(text) <= SPLIT:
        return enc.encode_ordinary(text)
    return [i for m in regex.finditer(pattern, text) for i in enc._encode_single_piece(m.group())]


def _whole(path: str, pattern: str):
    def work():
        def make(column):
            return [[np.array(token_ids(x or "", path, pattern), np.int32) for x in column.to_pylist()]]

        return make

    return work


def _digests(ids: list[np.ndarray], path: str) -> list[list]:
    """Per array of ids its length, the digest of the ids, and the digest of the bytes they decode to."""
    coded = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
    plain = [hashlib.sha256(decode(x.tolist(), path)).hexdigest() for x in ids]
    return [[len(x) for x in ids], coded, plain]


def _whole_digested(path: str, pattern: str, with_ids: bool):
    def work():
        encoded = _whole(path, pattern)()

        def make(column):
            (ids,) = encoded(column)
            return [ids] * with_ids + _digests(ids, path)

        return make

    return work


def _edges(pattern: str):
    """Per chunk: boundaries in its first and in its last ``OVERLAP`` characters, counted from the chunk's start."""

    def make(column):
        heads, tails = [], []
        for text in column.to_pylist():
            cut = boundaries(text, pattern)
            cut = cut[cut < len(text)]  # the last token may go on after the chunk
            heads.append(cut[cut <= OVERLAP])
            tails.append(cut[cut > len(text) - OVERLAP] if len(text) > OVERLAP else cut)
        return [heads, tails]

    return make


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Add ``ids`` (array of int) to ``docs``: every match of ``pattern`` encoded by the ranks in ``path``.

    Texts of up to ``chunk`` characters are encoded where they are. Longer ones are dealt out as chunks that overlap by
    ``OVERLAP`` characters and are pre-tokenised apart. A chunk starts anywhere, so its first boundaries may be wrong; where two
    neighbours agree on a boundary inside their overlap, both go on alike from there, and the text is cut. Each piece is encoded
    on its own and the ids are put together by position. A text with two neighbours that never agree (one word, or one run of blanks,
    longer than the overlap) is encoded whole, match by match. Either way the ids are those of the whole text.

    Null and empty texts have no ids. Rows need no key: repeated rows, ties and null ids are kept as they are. Other columns are
    kept; one named ``ids`` is replaced.
    """
    docs = docs.drop("ids")
    rows, long = packed(docs, text_col), _is_long(chunk)
    short = map_text(rows.filter(~long), "_text", _whole(path, pattern), [_IDS], drop_text=False)
    wide = _encode_long(rows.filter(long), path, pattern, chunk)
    return unpacked(short.unionByName(wide), docs.columns, text_col, ["ids"])


def encode_with_digests(docs: DataFrame, path: str, pattern: str, keep: list[str], text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """The rows of ``with_digests(encode(docs, path, pattern, text_col, chunk), path, keep)``, with one Python worker a task.

    One after the other the two passes would share a stage, whose tasks would each hold two workers with the tokenizer's tables in both.
    Here a text that is encoded where it is gets its ids decoded and digested in the same pass, and is left there unless it is kept.
    """
    docs = docs.drop("ids")
    docs = docs.select(*dict.fromkeys([*[c for c in keep if c != "ids"], text_col]))
    rows, long = packed(docs, text_col), _is_long(chunk)
    with_ids, with_text = "ids" in keep, text_col in keep
    made = [_IDS] * with_ids + _DIGESTS
    short = map_text(rows.filter(~long), "_text", _whole_digested(path, pattern, with_ids), made, drop_text=not with_text)
    wide = with_digests(_encode_long(rows.filter(long), path, pattern, chunk), path, ["_row"] + ["_text"] * with_text + ["ids"] * with_ids)
    place = {"ids": F.col("ids"), text_col: F.col("_text")}
    kept = [(place[c] if c in place else F.col("_row").getField(c)).alias(c) for c in keep]
    return short.unionByName(wide).select(*kept, *[f.name for f in _DIGESTS])


def _is_long(chunk: int) -> Column:
    return F.coalesce(F.length("_text"), F.lit(0)) > chunk


def _encode_long(rows: DataFrame, path: str, pattern: str, chunk: int) -> DataFrame:
    """``(_row, _text, ids)`` of packed rows, by way of chunks."""
    wide = rows.withColumn("_key", F.sha2(F.to_json(F.struct("_row", "_text")), 256))
    wide = wide.groupBy("_key").agg(F.first("_row").alias("_row"), F.first("_text").alias("_text"), F.count(F.lit(1)).alias("_n"))
    wide = materialize(wide, "bpe-long")
    body = F.col("_text")
    last = F.greatest(F.length("_body") - 1 - OVERLAP, F.lit(0))
    starts = wide.select("_key", body.alias("_body")).withColumn("at", F.explode(F.sequence(F.lit(0), last, F.lit(chunk))))
    chunks = starts.select("_key", "at", F.substr("_body", F.col("at") + 1, F.lit(chunk + OVERLAP)).alias("chunk")).repartition("_key", "at")
    edges = map_text(chunks, "chunk", lambda: _edges(pattern), [T.StructField(n, T.ArrayType(T.LongType())) for n in ("head", "tail")], drop_text=False)

    in_text = Window.partitionBy("_key").orderBy("at")
    ahead = F.transform(F.lead("head").over(in_text), lambda x: x + chunk)
    edges = edges.withColumn("_next", F.lead("at").over(in_text)).withColumn("_cut", F.array_min(F.array_intersect("tail", ahead)) + F.col("at"))
    edges = edges.withColumn("start", F.coalesce(F.lag("_cut").over(in_text), F.lit(0)))
    edges = edges.withColumn("lost", F.max(F.col("_next").isNotNull() & F.col("_cut").isNull()).over(Window.partitionBy("_key")))
    stop = F.coalesce(F.col("_cut"), F.col("at") + F.length("chunk"))
    inside = F.substr("chunk", (F.col("start") - F.col("at") + 1).cast("int"), (stop - F.col("start")).cast("int"))
    edges = materialize(edges.select("_key", "at", "start", "lost", F.when(~F.col("lost"), inside).alias("piece")), "bpe-pieces")
    whole = wide.join(edges.filter("lost and at = 0").select("_key"), "_key").select("_key", F.lit(0).cast("long").alias("start"), body.alias("piece"))
    pieces = edges.filter("not lost").select("_key", "start", "piece").union(whole).repartition("_key", "start")
    coded = map_text(pieces, "piece", _whole(path, pattern), [_IDS])
    coded = coded.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("start", "ids"))).alias("_all"))
    coded = coded.select("_key", F.flatten(F.col("_all.ids")).alias("ids"))
    rejoined = wide.join(coded, "_key").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return rejoined.select("_row", "_text", "ids")


def with_digests(coded: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """Replace ``ids`` by ``n_tokens``, ``ids_sha256`` and, after decoding them, ``decoded_sha256``."""
    names = [f.name for f in _DIGESTS]

    def run(batches):
        for batch in batches:
            cells = batch.column(batch.schema.names.index("ids"))
            values = [cells[i].values for i in range(batch.num_rows)]
            ids = [x.to_numpy(zero_copy_only=False) if x is not None else np.zeros(0, np.int32) for x in values]
            kept = [batch.column(batch.schema.names.index(c)) for c in keep]
            n, coded, plain = _digests(ids, path)
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())], names=[*keep, *names])
        give_back()

    schema = T.StructType([coded.schema[c] for c in keep] + _DIGESTS)
    return coded.select(*dict.fromkeys([*keep, "ids"])).mapInArrow(run, schema)
