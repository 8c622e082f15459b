"""Routing of heavy keys, and ranking that no single task has to hold.

A window over a key puts every row of that key into one task. That is the best plan while
keys are small, and a failure when one key holds a third of the table. So a plan first asks
``hot_keys`` which keys are heavy. The answer only picks the route: rows of heavy keys go
through ``spread_rank``, all others through the plain window, and both routes are exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermatch.functions.text import literal

#: a heavy key shows up about this often among the rows looked at
_SEEN = 10_000
#: a list of heavy keys is broadcast only up to this length, which has been counted
_FEW = 100_000
#: keys a sketch keeps; it loses none with more than 3.5 rows in so many
_TRACKED = 4096
#: a key with fewer rows than this weighs on no task
_LIGHT = 1000
#: bytes of keys that a task gets, of their text and about what a hash table takes besides
_TASK_BYTES = 32 << 20
#: below this a further task costs more than it saves
_LEAST_BYTES = 1 << 20
_ROW_BYTES, _FIELD_BYTES = 64, 8


@dataclass(frozen=True)
class HotKeys:
    """The hashes of the heavy keys of a ledger, as a column ``h``, and how many there are."""

    keys: DataFrame
    count: int

    @property
    def few(self) -> bool:
        return self.count <= _FEW

    def listed(self) -> DataFrame:
        return F.broadcast(self.keys) if self.few else self.keys


#: no heavy key
NONE: tuple = ()
Hot = HotKeys | tuple


@dataclass(frozen=True)
class KeySize:
    """Bytes of the keys of a table, and its heavy keys."""

    bytes: int
    hot: Hot

    def partitions(self, cores: int) -> int:
        """As many as keep a task small, and one for each core where there is work for it."""
        return max(1, -(-self.bytes // _TASK_BYTES), min(cores, self.bytes // _LEAST_BYTES))


def quoted(names: Sequence[str]) -> str:
    return ", ".join(f"`{n}`" for n in names)


def key_hash(keys: Sequence[str]) -> str:
    return f"xxhash64({quoted(keys)})"


def hot_keys(ledgers: Mapping[str, tuple[DataFrame, Sequence[str]]], hot_rows: int) -> dict[str, Hot]:
    """Hashes of the keys with about ``hot_rows`` rows or more, per named ledger, in one job.

    Reads key columns only and counts a share of the rows, since the answer picks a route and never
    a result. The keys stay a DataFrame, however many they are; the driver receives their number. A ledger
    without any gets ``NONE``.
    """
    share = min(1.0, _SEEN / hot_rows)
    hashed = [
        df.selectExpr(f"{key_hash(keys)} as h").sample(share, seed=1).selectExpr(f"'{name}' as ledger", "h")
        for name, (df, keys) in ledgers.items()
    ]
    heavy = (
        reduce(DataFrame.unionAll, hashed)
        .groupBy("ledger", "h")
        .agg(F.expr("count(*) as n"))
        .filter(f"n >= {hot_rows * share * 0.9}")
        .select("ledger", "h")
    )
    numbers = {row.ledger: row.n for row in heavy.groupBy("ledger").agg(F.expr("count(*) as n")).collect()}
    if numbers:
        heavy = checkpoint(heavy)
    return {
        name: HotKeys(heavy.filter(f"ledger = '{name}'").select("h"), numbers[name]) if name in numbers else NONE
        for name in ledgers
    }


def key_sizes(tables: Mapping[str, DataFrame]) -> dict[str, KeySize]:
    """Size and heavy keys of tables that hold key columns only, in one job that shuffles one sketch per table and task.

    Heavy is a key with more than 3.5 rows in 4096, so a table has about a thousand of them at most. As with ``hot_keys`` the
    answer picks a route and never a result.
    """
    hashed = []
    for name, df in tables.items():
        texts = [f"ifnull(octet_length(`{c}`), 0)" for c, kind in df.dtypes if kind in ("string", "binary")]
        width = " + ".join([str(_ROW_BYTES + _FIELD_BYTES * len(df.columns)), *texts])
        hashed.append(df.selectExpr(f"{literal(name)} as ledger", f"{key_hash(df.columns)} as h", f"bigint({width}) as width"))
    seen = (
        reduce(DataFrame.unionAll, hashed)
        .groupBy("ledger")
        .agg(
            F.expr("sum(width) as bytes"),
            F.expr(f"approx_top_k(h, {_TRACKED}, {_TRACKED}) as items"),
            F.expr(f"greatest({_LIGHT}, 3.5 * count(*) / {_TRACKED}) as least"),
        )
        .selectExpr("ledger", "bytes", "transform(filter(items, i -> i.count >= least), i -> i.item) as heavy")
    )
    sizes = {row.ledger: row for row in seen.collect()}
    return {
        name: KeySize(sizes[name].bytes, _listed(df.sparkSession, sizes[name].heavy)) if name in sizes else KeySize(0, NONE)
        for name, df in tables.items()
    }


def _listed(spark: SparkSession, hashes: Sequence[int]) -> Hot:
    return HotKeys(spark.createDataFrame([(h,) for h in hashes], "h long"), len(hashes)) if hashes else NONE


def split_hot(df: DataFrame, keys: Sequence[str], hot: Hot) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ordinary keys and the rows of heavy keys; None if there are no heavy keys."""
    if not hot:
        return df, None
    hashed = df.selectExpr("*", f"{key_hash(keys)} as _h")
    plain, heavy = (hashed.join(hot.listed(), F.expr("_h = h"), how).drop("_h") for how in ("left_anti", "left_semi"))
    return plain, heavy


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Broadcast hint for a table that a short job has shown to hold no more than ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the session names."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Unset, as in tests, it lies in the warehouse of a local
    session; a cluster has to name it, since a folder of one machine would be lost to the others."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"


def use_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def window_rank(df: DataFrame, keys: Sequence[str], order: str, name: str) -> DataFrame:
    return df.selectExpr("*", f"row_number() over (partition by {quoted(keys)} order by {order}) as {name}")


def spread_rank(df: DataFrame, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """``row_number`` over ``keys`` without ever holding one key in one task."""
    return spread_sum(df, keys, order, name, "1").withColumn(name, F.expr(f"int({name})"))


def spread_sum(df: DataFrame, keys: Sequence[str], order: str, name: str, weight: str) -> DataFrame:
    """Running sum of ``weight`` over ``keys`` without ever holding one key in one task.

    Rows are range-partitioned by key, order and a frozen row id, so a heavy key spans many
    partitions. Each partition sums its own rows; the sums of the earlier partitions of the same
    key are the offset of the local one. The two checkpoints fix the row ids and the partition
    bounds, so a lost executor cannot move a row between two reads. ``order`` is a list of columns
    as SQL text.
    """
    by_key = quoted(keys)
    frozen = checkpoint(df.selectExpr("*", "monotonically_increasing_id() as _row"))
    tasks = max(int(frozen.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    ranged = frozen.repartitionByRange(tasks, *keys, F.expr(f"struct({order})"), "_row")
    ranged = checkpoint(ranged.selectExpr("*", "spark_partition_id() as _part"))

    earlier = f"over (partition by {by_key} order by _part rows between unbounded preceding and 1 preceding)"
    offsets = (
        ranged.groupBy(*keys, "_part")
        .agg(F.expr(f"sum({weight}) as part_sum"))
        .selectExpr(*[f"`{k}`" for k in keys], "_part", f"ifnull(sum(part_sum) {earlier}, 0) as offset")
    )
    upto = f"over (partition by _part, {by_key} order by {order}, _row rows unbounded preceding)"
    local = ranged.selectExpr("*", f"sum({weight}) {upto} as _local")
    same = " and ".join(["l._part = o._part", *[f"l.`{k}` <=> o.`{k}`" for k in keys]])
    return (
        local.alias("l")
        .join(offsets.alias("o"), F.expr(same))
        .selectExpr(*[f"l.`{c}`" for c in df.columns], f"_local + offset as {name}")
    )
