"""A place of every row in a total order, without a task that sees all rows, and a sample that needs no order at all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.operators.skew import checkpoint, quoted

#: bits that ``monotonically_increasing_id`` leaves to the place within a partition
_PLACE = 33


def ordinal(df: DataFrame, order: str, name: str = "ordinal", unique: bool = False) -> DataFrame:
    """Number the rows 1, 2, 3 … by ``order``, a list of columns as SQL text such as ``amount desc, id``.

    Rows are range-partitioned by the order, sorted within their partition and frozen there by a checkpoint. The number of a
    row is its place in the partition plus the rows of all earlier partitions, of which there is one count per partition.
    Unless the order is ``unique``, ties are broken by all columns and then by a frozen row number, so that a value held by a third of
    all rows is spread as well; rows equal in every column take any of their numbers. An empty table stays empty.
    """
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    keys = [_key(df, k) for k in order.split(",")]
    if not unique:
        df = checkpoint(df.selectExpr("*", "monotonically_increasing_id() as _tie"))
        rest = [c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
        keys += [F.xxhash64(*[F.col(f"`{c}`") for c in rest if c != "_tie"]).asc(), F.col("_tie").asc()]
    sorted_rows = df.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    frozen = checkpoint(sorted_rows.selectExpr("*", "monotonically_increasing_id() as _at"))
    place = f"(_at & {(1 << _PLACE) - 1})"
    sizes = frozen.groupBy(F.expr(f"shiftright(_at, {_PLACE}) as _part")).agg(F.expr(f"max({place}) + 1 as _n"))
    earlier = sizes.selectExpr("_part", "ifnull(sum(_n) over (order by _part rows between unbounded preceding and 1 preceding), 0) as _earlier")
    numbered = frozen.join(F.broadcast(earlier), F.expr(f"shiftright(_at, {_PLACE}) = _part"))
    kept = [c for c in df.columns if c != "_tie"]
    return numbered.selectExpr(*[f"`{c}`" for c in kept], f"_earlier + {place} + 1 as `{name}`")


def _key(df: DataFrame, term: str):
    words = term.split()
    column = F.expr(words[0])
    known = {
        "": column.asc(), "asc": column.asc(), "desc": column.desc(), "asc nulls last": column.asc_nulls_last(),
        "nulls last": column.asc_nulls_last(), "nulls first": column.asc_nulls_first(), "desc nulls first": column.desc_nulls_first(),
        "asc nulls first": column.asc_nulls_first(), "desc nulls last": column.desc_nulls_last(),
    }
    return known[" ".join(words[1:]).lower()]


def sample_rows(df: DataFrame, rows: int, keys: Sequence[str] = (), seed: str = "sample") -> DataFrame:
    """``rows`` rows, the same ones however the table is partitioned: those with the least hash of their key columns.

    Each task keeps its own least rows and the winners are merged, so nothing is sorted as a whole and no row but the
    candidates moves. Without ``keys`` all columns are hashed. Rows that are equal in all hashed columns are interchangeable.
    """
    columns = list(keys) or df.columns
    text = ", ".join(f"ifnull(cast(`{c}` as string), '<null>')" for c in columns)
    ranked = df.selectExpr("*", f"sha2(concat_ws('␟', '{seed}', {text}), 256) as _hash")
    return ranked.orderBy("_hash").limit(rows).selectExpr(*quoted(df.columns).split(", "))
