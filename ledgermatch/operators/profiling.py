"""What a table holds: counts, distinct values, nulls, frequent values, repeated keys.

The columns are turned into (column, value) rows and counted once per value. Equal values combine
before the shuffle, so a value that fills a third of the table costs one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.functions.text import literal
from ledgermatch.operators import ordinal, skew


def count_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, value, n): every value of the columns as text, nulls included."""
    columns = list(columns or df.columns)
    texts = df.selectExpr(*[f"cast(`{c}` as string) as `{c}`" for c in columns])
    long = texts.unpivot([], columns, "column_name", "value")
    return long.groupBy("column_name", "value").agg(F.expr("count(*) as n"))


def in_one_pass(df: DataFrame, **measures: str) -> DataFrame:
    """A row per column with aggregates over it, ``{c}`` in their SQL; nothing but sums is shuffled."""
    rows = ", ".join(
        f"struct({literal(c)} as column_name, " + ", ".join(f"{sql.format(c=f'`{c}`')} as {name}" for name, sql in measures.items()) + ")"
        for c in df.columns
    )
    return df.agg(F.expr(f"array({rows}) as measured")).selectExpr("inline(measured)")


def column_stats(tables: Mapping[str, DataFrame], rsd: float = 0.05, exact: bool = True) -> DataFrame:
    """Rows, exact and estimated distinct values and nulls of every column of the tables.

    The estimate comes from the pass that counts rows. The exact count shuffles every distinct cell and can be left out.
    """
    parts = []
    for name, df in tables.items():
        stats = in_one_pass(
            df, rows="count(*)", distinct_approx=f"approx_count_distinct({{c}}, {rsd})", nulls="count_if({c} is null)"
        )
        if exact:
            counted = count_values(df).groupBy("column_name").agg(F.expr("count(value) as distinct_exact"))
            stats = stats.join(counted, "column_name")
        parts.append(stats.selectExpr(f"{literal(name)} as table_name", "*"))
    return reduce(DataFrame.unionByName, parts).orderBy("table_name", "column_name")


def value_counts(spec: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Frequency of each value of the chosen columns; one pass per table."""
    parts = [
        count_values(df, columns).selectExpr(f"{literal(name)} as table_name", "column_name as field", "value", "n")
        for name, (df, columns) in spec.items()
    ]
    return reduce(DataFrame.unionByName, parts).orderBy("table_name", "field", F.desc("n"))


def repeated_keys(spec: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Keys that occur more than once. Keys are counted by their columns; ``key`` shows the parts joined by a blank.

    Most keys may be unique, and then a task holds nearly every row it gets. Adaptive execution merges partitions by their packed
    bytes, which is a sixteenth of that for keys of numbers, so the number of partitions follows from rows and bytes counted before.
    """
    keyed = {name: df.selectExpr(*[f"`{k}` as k{i}" for i, k in enumerate(keys)]) for name, (df, keys) in spec.items()}
    sizes = skew.key_sizes(keyed)
    parts = []
    for name, df in keyed.items():
        key = " || ' ' || ".join(f"cast({k} as string)" for k in df.columns)
        counted = _count_keys(df, sizes[name]).filter("n > 1")
        parts.append(counted.selectExpr(f"{literal(name)} as table_name", f"{key} as key", "n"))
    return reduce(DataFrame.unionByName, parts)


def _count_keys(df: DataFrame, size: skew.KeySize) -> DataFrame:
    """The distinct rows and their number ``n``. Frequent ones are added up in each task before they are dealt out by key."""
    keys = df.columns
    plain, heavy = skew.split_hot(df, keys, size.hot)
    rows = plain.selectExpr("*", "1L as n")
    if heavy is not None:
        rows = rows.unionByName(heavy.groupBy(*keys).agg(F.expr("count(*) as n")))
    partitions = size.partitions(df.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(partitions, *keys).groupBy(*keys).agg(F.expr("sum(n) as n"))


def sample_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """Rows to look at: the same ones however the table is partitioned."""
    return ordinal.sample_rows(df, n)


def describe_columns(df: DataFrame, max_unique: int = 20) -> DataFrame:
    """Type, nulls, distinct values, and either all value counts or three sample values per column.

    ``top_values`` lists a column's values only when there are at most ``max_unique``, so a list
    is never longer than that; the others show smallest, largest and one more value. Smallest and largest
    are those of the column's type, not of its text.
    """
    ends = in_one_pass(df, smallest="cast(min({c}) as string)", largest="cast(max({c}) as string)")
    counted = count_values(df)
    stats = counted.groupBy("column_name").agg(
        F.expr("sum(if(value is null, n, 0)) as nulls"),
        F.expr("count(value) as distinct_values"),
        F.expr("min_by(value, xxhash64(value)) as other"),
    )
    stats = stats.join(ends, "column_name").selectExpr("*", "array(smallest, largest, other) as samples")
    few = stats.filter(f"distinct_values <= {max_unique}").select("column_name")
    # one row per column of the table
    listed = (
        counted.join(F.broadcast(few), "column_name", "left_semi")
        .groupBy("column_name")
        .agg(F.expr("sort_array(collect_list(struct(-n as negated, value, n))) as ranked"))
        .selectExpr("column_name", "transform(ranked, r -> struct(r.value as value, r.n as n)) as top_values")
    )
    kinds = " ".join(f"when {literal(name)} then '{kind}'" for name, kind in df.dtypes)
    return stats.join(listed, "column_name", "left").selectExpr(
        "column_name",
        f"case column_name {kinds} end as data_type",
        "nulls",
        "distinct_values",
        "top_values",
        "if(top_values is null, samples, null) as samples",
    )
