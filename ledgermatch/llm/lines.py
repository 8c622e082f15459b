"""Line dedup: two Bloom filters find suspected repeats, and only those are shuffled and confirmed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermatch.llm.common import checked_broadcast, map_text, materialize
from ledgermatch.llm.words import mixed

#: Fixed value: what is stripped from both ends of a line.
EDGE = b" \t\n\x0b\x0c\r"
#: Positions of one block of the filters: 128 KB a bitmap.
BLOCK = 1 << 20
#: Hashes that wait before they enter the bitmaps of a task.
WAITING = 1 << 18


@dataclass(frozen=True)
class Settings:
    least_chars: int = 20  # code points of a key
    least_docs: int = 3  # documents that hold it
    positions_per_line: int = 16
    hashes: int = 4
    #: Bound of either bitmap, 32 MB. Fuller filters let more lines through to the exact step and lose none.
    most_positions: int = 1 << 28


def _keys(text: bytes, least: int) -> Iterator[tuple[int, bytes]]:
    """Number and key of every line of a text whose key is long enough."""
    for i, line in enumerate(text.split(b"\n")):
        key = line.strip(EDGE).lower()  # bytes lower A-Z only
        if len(key) >= least and (key.isascii() or len(key.decode()) >= least):
            yield i, key


def _raw(texts: pa.Array) -> list[bytes]:
    return texts.fill_null("").cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def positions_of(hashes: np.ndarray, positions: int, number: int) -> np.ndarray:
    """``number`` positions of every hash, one column each; ``positions`` is a power of two."""
    step = mixed(hashes.copy()) | np.uint64(1)
    return (hashes[:, None] + np.arange(number, dtype=np.uint64) * step[:, None]) & np.uint64(positions - 1)


class Filters:
    """A bitmap of the positions seen once and one of those seen twice, in blocks that come into being when they are hit."""

    def __init__(self) -> None:
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _block(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        if number not in self.blocks:
            self.blocks[number] = np.zeros(BLOCK // 8, np.uint8), np.zeros(BLOCK // 8, np.uint8)
        return self.blocks[number]

    def add(self, at: np.ndarray) -> None:
        """Positions with repeats; a position that is seen again enters the second bitmap."""
        at, often = np.unique(at, return_counts=True)
        cuts = np.flatnonzero(np.diff(at // BLOCK)) + 1
        for part, n in zip(np.split(at, cuts), np.split(often, cuts), strict=True):
            if len(part):
                bits = np.zeros(BLOCK, bool)
                bits[(part % BLOCK).astype(np.int64)] = True
                new = np.packbits(bits)
                bits[:] = False
                bits[(part[n > 1] % BLOCK).astype(np.int64)] = True
                self.merge(int(part[0] // BLOCK), new, np.packbits(bits))

    def merge(self, number: int, once: np.ndarray, twice: np.ndarray) -> None:
        """Two tasks that have both seen a position once have seen it twice."""
        mine = self._block(number)
        mine[1][:] |= twice | (mine[0] & once)
        mine[0][:] |= once


def _filters(docs: DataFrame, text: str, s: Settings, positions: int) -> dict[int, bytes]:
    """Blocks of the merged twice-seen filter; at most ``positions / 8`` bytes in all."""

    def build(batches):
        own, waiting, size = Filters(), [], 0

        def flush():
            if waiting:
                own.add(positions_of(np.concatenate(waiting), positions, s.hashes).ravel())
                waiting.clear()

        for batch in batches:
            for row in _raw(batch.column(0)):
                # a key counts once a document
                seen = {xxhash.xxh3_64_intdigest(key) for _, key in _keys(row, s.least_chars)}
                waiting.append(np.fromiter(seen, np.uint64, len(seen)))
                size += len(seen)
                if size >= WAITING:
                    flush()
                    size = 0
        flush()
        yield from written(own)

    parts = docs.select(F.col(f"`{text}`").alias("_text")).mapInArrow(build, SHAPE)
    return merged(parts, "twice")


def merged(parts: DataFrame, which: str) -> dict[int, bytes]:
    """One bitmap, ``once`` or ``twice``, of the filters that all tasks have written; at most its stated size reaches the driver."""

    def merge(batches):
        whole = Filters()
        for batch in batches:
            for number, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole.merge(number, np.frombuffer(once, np.uint8), np.frombuffer(twice, np.uint8))
        yield from written(whole)

    whole = parts.repartition("block").mapInArrow(merge, SHAPE)
    return {r["block"]: bytes(r[which]) for r in whole.select("block", which).collect() if any(r[which])}


SHAPE = "block int, once binary, twice binary"


def written(filters: Filters) -> Iterator[pa.RecordBatch]:
    for number, (once, twice) in filters.blocks.items():
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([once.tobytes()], pa.binary()), pa.array([twice.tobytes()], pa.binary())], names=["block", "once", "twice"])


def _digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def _suspects(docs: DataFrame, doc_id: str, text: str, s: Settings) -> DataFrame:
    """Rows ``(_doc, _key)``, each once: the 128-bit digests of the lines that pass the twice-seen filter."""
    lines = F.length("_t") - F.length(F.replace("_t", F.lit("\n"), F.lit(""))) + 1
    most = docs.select(F.col(f"`{text}`").alias("_t")).agg(F.sum(F.when(F.length("_t") >= s.least_chars, lines)).alias("n")).first()["n"] or 0
    positions = min(max(1 << int(most * s.positions_per_line - 1).bit_length(), BLOCK), s.most_positions) if most else BLOCK
    blocks = _filters(docs, text, s, positions) if most else {}
    sent = docs.sparkSession.sparkContext.broadcast(blocks)

    def work():
        twice = {number: np.frombuffer(bits, np.uint8) for number, bits in sent.value.items()}

        def passes(hashes: np.ndarray) -> np.ndarray:
            at = positions_of(hashes, positions, s.hashes)
            fine = np.ones(len(hashes), bool)
            numbers, inside = at // np.uint64(BLOCK), (at % np.uint64(BLOCK)).astype(np.int64)
            for k in range(s.hashes):
                left = np.flatnonzero(fine)
                for number in np.unique(numbers[left, k]).tolist():
                    rows = left[numbers[left, k] == number]
                    place = inside[rows, k]
                    # packbits puts the first position into the highest bit
                    fine[rows] = (twice[number][place >> 3] >> (7 - (place & 7))) & 1 if number in twice else False
            return fine

        def make(texts: pa.Array) -> list:
            rows, keys = [], []
            for i, raw in enumerate(_raw(texts)):
                own = list(dict.fromkeys(key for _, key in _keys(raw, s.least_chars)))
                rows.append(np.full(len(own), i))
                keys += own
            out: list[list[bytes]] = [[] for _ in range(len(texts))]
            if keys:
                fine = passes(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)))
                for i, k in zip(np.concatenate(rows)[fine].tolist(), np.flatnonzero(fine).tolist(), strict=True):
                    out[i].append(_digest(keys[k]))
            return [out]

        return make

    ids = docs.select(F.col(f"`{doc_id}`").alias("_doc"), F.col(f"`{text}`").alias("_text")).filter("_doc is not null")
    found = map_text(ids, "_text", work, [T.StructField("_keys", T.ArrayType(T.BinaryType()))])
    return found.select("_doc", F.explode("_keys").alias("_key")).distinct()


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", s: Settings | None = None) -> DataFrame:
    """``docs`` with ``n_lines`` (before dropping), ``n_dropped`` and ``kept_text``.

    Texts are split at ``\\n``. The key of a line is the line without space and U+0009 to U+000D at both ends, with A-Z in
    lower case. A key of ``least_chars`` code points or more that stands in ``least_docs`` documents or more loses all its lines
    but those of the document with the largest id.

    1. Every task enters the key hashes of its documents into two bitmaps: positions seen once and seen twice. The bitmaps are
       merged block by block. A key of two documents has all its positions in the twice-seen filter; a key of one gets there by
       collisions only.
    2. Lines that pass the filter are suspected. Only their 128-bit digests move, each once a document. Counts and the largest id are
       combined before they are shuffled, so a line that a third of all documents hold is no heavy group.
    3. The digests to drop come back to their documents by a join on the id, broadcast if they have been counted to be few.

    The filters take 16 positions a line up to the bound of ``most_positions``, some 17 million lines at full width. With more
    lines they fill up: of the lines that stand in one document a share of ``(1 - exp(-hashes * lines / positions)) ** hashes`` is suspected
    for nothing, and at the very end the exact step sees all lines, as a plain count would. Results are the same at every size; raise the bound on
    executors with more memory.

    A null or empty text is one empty line. Rows that repeat an id are one document. A row without an id counts for no key and
    loses no line. Columns of the results' names are replaced; all others stay, in their order.
    """
    s = s or Settings()
    pairs = materialize(_suspects(docs, doc_id, text, s), "line-suspects")
    repeated = pairs.groupBy("_key").agg(F.count(F.lit(1)).alias("_docs"), F.max("_doc").alias("_last")).filter(F.col("_docs") >= s.least_docs)
    repeated = materialize(repeated.select("_key", "_last"), "line-repeats")
    drops = pairs.join(checked_broadcast(repeated, "3"), "_key").filter("_doc <> _last").groupBy("_doc").agg(F.collect_list("_key").alias("_drop"))
    drops = materialize(drops, "line-drops")

    fields = ("n_lines", "n_dropped", "kept_text")
    docs = docs.drop(*fields)
    rows = docs.select(F.struct("*").alias("_row"))
    id_type = docs.schema[doc_id].dataType
    joined = rows.join(checked_broadcast(drops, "2 + 2 * size(_drop)"), F.col("_row").getField(doc_id) == F.col("_doc").cast(id_type), "left")
    named = joined.select("_row", "_drop", F.col("_row").getField(text).alias("_text"))
    out = _without(named)
    return out.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns], *fields)


def _without(rows: DataFrame) -> DataFrame:
    schema = T.StructType([rows.schema["_row"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())])

    def run(batches):
        for batch in batches:
            row, drop, texts = batch.columns
            lines, gone, kept = [], [], []
            for raw, digests in zip(_raw(texts), drop.to_pylist(), strict=True):
                lines.append(raw.count(b"\n") + 1)
                dropped: set[int] = set()
                if digests:
                    digests = set(digests)
                    # the least length is implied: only long keys have digests here
                    dropped = {i for i, key in _keys(raw, 1) if _digest(key) in digests}
                gone.append(len(dropped))
                kept.append(raw if not dropped else b"\n".join(x for i, x in enumerate(raw.split(b"\n")) if i not in dropped))
            yield pa.RecordBatch.from_arrays([row, pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
