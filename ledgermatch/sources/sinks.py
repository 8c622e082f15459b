"""Where results go: Parquet tables, CSV and TSV folders, catalog tables with their descriptions and sizes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermatch.functions.text import literal


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write Parquet and return the written table, so that later plans start from the files."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_table(df: DataFrame, name: str, comment: str | None = None, columns: Mapping[str, str] | None = None) -> None:
    """Save as a catalog table and persist the descriptions of the table and its columns."""
    spark = df.sparkSession
    df.write.mode("overwrite").saveAsTable(name)
    if comment:
        spark.sql(f"comment on table {name} is '{_escaped(comment)}'")
    for column, text in (columns or {}).items():
        spark.sql(f"alter table {name} alter column `{column}` comment '{_escaped(text)}'")


def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def export_csv(df: DataFrame, folder: str, sep: str = ",") -> None:
    """A folder of delimited text files, each with a header; ``sep="\\t"`` for TSV."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"').csv(folder)


def export_all(tables: Mapping[str, DataFrame], folder: str, sep: str = ",") -> None:
    for name, df in tables.items():
        export_csv(df, f"{folder}/{name}", sep)


def write_buckets(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """A catalog table whose files are hashed and sorted by ``keys``: a join or window on these keys reads it without a shuffle.

    Rows are dealt to the buckets before they are written, so that each bucket is one file.
    """
    keys = list(keys)
    dealt = df.repartition(buckets, *[F.col(f"`{k}`") for k in keys])
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


def register(
    df: DataFrame, name: str, path: str, comment: str = "", columns: Mapping[str, str] | None = None, by: Sequence[str] = ()
) -> None:
    """A catalog table over files that have been written, with its comment and those of its columns; no row is read or copied.

    An older table of that name is replaced; the files belong to no table and stay. ``by`` names the columns the folders go by.
    """
    spark = df.sparkSession
    told = columns or {}
    shape = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" + (f" comment {literal(told[f.name])}" if f.name in told else "") for f in df.schema
    )
    spark.sql(f"drop table if exists {name}")
    parted = f"partitioned by ({', '.join(f'`{c}`' for c in by)}) " if by else ""
    spark.sql(f"create table {name} ({shape}) using parquet {parted}comment {literal(comment)} location {literal(path)}")
    if by:
        spark.sql(f"msck repair table {name}")


_DESCRIBED = (
    "struct<table_name:string,schema_name:string,type:string,comment:string,"
    "columns:array<struct<name:string,type:struct<name:string>,comment:string>>,"
    "statistics:struct<size_in_bytes:bigint,num_rows:bigint>>"
)


def catalog_listing(spark: SparkSession, tables: Sequence[str], count_rows: bool = True) -> DataFrame:
    """The columns of catalog tables with types, comments and sizes, one row per column.

    A table takes one statement to describe it, whatever its number of columns, and one that counts its rows for the catalog,
    where other readers and the optimizer find the number too. The texts are taken apart by Spark.
    """
    told = []
    for name in tables:
        if count_rows:
            spark.sql(f"analyze table {name} compute statistics")
        told.append((spark.sql(f"describe table extended {name} as json").first()[0],))
    table = spark.createDataFrame(told, "told string").select(F.from_json("told", _DESCRIBED).alias("t"))
    rows = table.selectExpr("t.*", "posexplode(t.columns) as (place, c)")
    return rows.selectExpr(
        "table_name", "lower(type) as kind", "comment as table_comment", "statistics.num_rows as row_count",
        "statistics.size_in_bytes as bytes", "place + 1 as place", "c.name as column_name", "c.type.name as data_type",
        "c.comment as column_comment",
    )


def list_tables(spark: SparkSession) -> DataFrame:
    """Tables and views of the current database with their columns, types and comments; names only, no data."""
    names = [f"`{t.name}`" if t.isTemporary else ".".join(f"`{part}`" for part in [*t.namespace, t.name]) for t in spark.catalog.listTables()]
    return catalog_listing(spark, names, count_rows=False).selectExpr(
        "table_name", "kind", "table_comment as comment", "column_name", "data_type", "column_comment"
    )


def table_sizes(tables: Mapping[str, DataFrame]) -> dict[str, int]:
    """Rows of each table, counted in one job."""
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return {r.name: r.n for r in reduce(DataFrame.unionAll, counted).collect()} if counted else {}
