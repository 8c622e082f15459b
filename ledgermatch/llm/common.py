"""What the operators share: intermediate tables, folds, text passes over Arrow batches, components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermatch.operators.skew import shared_folder

#: Numbers of 8 bytes that a join may broadcast after they were counted; above it the join shuffles.
BROADCAST_NUMBERS = 2_000_000
#: Bytes of text that one numpy pass takes at a time; a longer text is a pass of its own.
PASS_BYTES = 1 << 19


#: Rows that Spark hands to Python at once: texts are large, and a batch is held on both sides.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to ``BATCH_ROWS``, unless it is lower already. Results do not depend on it."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


def give_back() -> None:
    """Return memory that this worker has freed to the system; a reused worker would keep it beside the next task's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, weight: str = "1", most: int = BROADCAST_NUMBERS) -> DataFrame:
    """Mark ``df`` for broadcast if its rows' weights, in numbers held, add up to ``most`` at most; otherwise the join shuffles."""
    return F.broadcast(df) if (df.agg(F.sum(F.expr(weight))).first()[0] or 0) <= most else df


def fold(doc_id: str, parts: int) -> Column:
    """``crc32`` of the id as text, modulo ``parts``; an id that is null counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def bounded_sample(df: DataFrame, group: str, rows: int, key: str) -> DataFrame:
    """About ``rows`` rows of each value of ``group``, chosen by a hash of ``key``; all rows where there are fewer."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    unit = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1_000_003)) / 1_000_003
    return df.join(checked_broadcast(sizes, most=10_000), group).filter(unit * F.col("_n") < rows).drop("_n")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, without a copy, and the offsets of its rows; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _parts(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``PASS_BYTES`` of text, of one row at least."""
    _, at = text_bytes(batch.column(text))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PASS_BYTES, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def map_text(df: DataFrame, text: str, work: Callable[[], Callable[[pa.Array], list]], fields: list[T.StructField], drop_text: bool = True) -> DataFrame:
    """Add the columns that a numpy pass makes from whole texts, a bounded slice of rows at a time.

    ``work()`` runs once a task and returns a function from a text column to one list or array per field.
    """
    names = df.columns
    at = names.index(text)
    kept = [i for i in range(len(names)) if not (drop_text and i == at)]
    schema = T.StructType([df.schema[i] for i in kept] + fields)
    labels = schema.names
    types = [_arrow(f.dataType) for f in fields]

    def run(batches):
        make = work()
        for batch in batches:
            for part in _parts(batch, at):
                made = make(part.column(at))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in kept] + [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, types, strict=True)], names=labels)
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def packed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` as ``(_row, _text)``, so that no column of its own can clash with one that an operator adds."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    return docs.select(F.struct(*others, F.lit(0).alias("_")).alias("_row"), F.col(f"`{text}`").alias("_text"))


def unpacked(rows: DataFrame, columns: list[str], text: str, more: list) -> DataFrame:
    """The columns of a packed table again, in their order, and more."""
    return rows.select(*[(F.col("_text") if c == text else F.col("_row").getField(c)).alias(c) for c in columns], *more)


def add_columns(docs: DataFrame, text: str, work: Callable, fields: list[T.StructField]) -> DataFrame:
    """``map_text`` that keeps all columns of ``docs``; columns of a result's name are replaced."""
    docs = docs.drop(*[f.name for f in fields])
    return unpacked(map_text(packed(docs, text), "_text", work, fields, drop_text=False), docs.columns, text, [f.name for f in fields])


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    plain = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary()}
    return plain[type(kind)]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges (a, b)``: a row ``(v, label)`` per vertex, ``label`` the least vertex reached.

    Every round takes the least label among the neighbours and then jumps to that label's own label, so the number of
    rounds grows with the logarithm of the diameter. Each round is written to the shared folder.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("label")), f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        step = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        over = labels.select(F.col("v").alias("low"), F.col("label").alias("jump"))
        step = materialize(step.join(over, "low").select("v", "old", F.least("low", "jump").alias("label")), f"{name}-labels")
        labels = step.select("v", "label")
        if step.filter("label <> old").isEmpty():
            return labels
