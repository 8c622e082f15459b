"""Raw files as all-text DataFrames. Nothing is inferred; every reader stays distributed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes 0x80-0x9f are where the Windows code page and ISO-8859-1 differ.
_WINDOWS = {byte: bytes([byte]).decode("cp1252", "ignore") for byte in range(0x80, 0xA0)}


@dataclass(frozen=True)
class FileTag:
    """A column that names the file of a row: what ``pattern`` captures in its path, by default its name without an ending."""

    name: str = "source_file"
    pattern: str = r"([^/]+?)(?:\.[^./]*)?$"

    def column(self) -> Column:
        return F.regexp_extract(F.url_decode("_metadata.file_path"), self.pattern, 1).alias(self.name)


def text_schema(columns: Sequence[str], comments: Mapping[str, str] | None = None) -> T.StructType:
    """Every column a string, with its description in the field metadata."""
    comments = comments or {}
    return T.StructType(
        [T.StructField(c, T.StringType(), True, {"comment": comments[c]} if c in comments else {}) for c in columns]
    )


def read_text_csv(
    spark: SparkSession,
    path: str | list[str],
    columns: Sequence[str],
    *,
    sep: str = ",",
    encoding: str = "utf-8",
    multiline: bool = False,
    comments: Mapping[str, str] | None = None,
    tag: FileTag | None = None,
) -> DataFrame:
    """CSV with a header line, all columns text, empty cells null.

    The header must spell the columns in their order; another one is an error, never a shift of columns. Quotes inside
    quoted text are doubled. ``multiline`` allows line breaks there; such a file is read by one task.

    ``cp1252`` is read as ISO-8859-1, which maps each byte to one character, and the 27 characters
    that differ are put right by an expression; Spark's own list of charsets does not hold it.
    """
    windows = encoding.lower() in ("cp1252", "windows-1252")
    schema = text_schema(columns, comments)
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", sep)
        .option("encoding", "iso-8859-1" if windows else encoding)
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("recursiveFileLookup", tag is not None)
        .csv(path)
    )
    tags = [tag.column()] if tag else []
    if not windows:
        return raw.select(*tags, "*") if tag else raw
    wrong = "".join(chr(byte) for byte, char in _WINDOWS.items() if char)
    right = "".join(char for char in _WINDOWS.values() if char)
    fixed = [F.translate(F.col(f"`{f.name}`"), wrong, right).alias(f.name, metadata=f.metadata) for f in schema]
    return raw.select(*tags, *fixed)


def read_banner_csv(
    spark: SparkSession,
    path: str | list[str],
    columns: Sequence[str],
    *,
    banner: str | None = None,
    sep: str = ",",
    comments: Mapping[str, str] | None = None,
    tag: FileTag | None = None,
) -> DataFrame:
    """CSV below a banner line, with LF and CRLF line ends mixed.

    Files are split, so no task knows which line came first: banner and header go by content. The
    header is the line that spells the columns; ``banner`` is a regular expression for the banner line.
    Without one, each file's first line is the banner, found by its place in the file. Every other line
    that is not empty is a record, and one that does not fit the columns is an error: nothing is dropped.
    """
    tags = [tag.column()] if tag else []
    read = spark.read.option("recursiveFileLookup", tag is not None).text(path).select(
        F.rtrim(F.col("value"), F.lit("\r")).alias("line"), "_metadata.file_path", "_metadata.file_block_start", *tags
    )
    spelled = [sep.join(columns), sep.join(f'"{c}"' for c in columns)]
    is_header = F.col("line").isin(*spelled, *["\ufeff" + s for s in spelled])
    if banner is None:
        # ids grow along a split, so the least one of the split at 0 is the file's first line
        read = read.withColumn("_at", F.monotonically_increasing_id())
        firsts = read.filter("file_block_start = 0").groupBy("file_path").agg(F.min("_at").alias("_at"))
        lines = read.join(F.broadcast(firsts), ["file_path", "_at"], "left_anti")
    else:
        lines = read.filter(~F.col("line").rlike(banner))
    record = ~is_header & (F.col("line") != "")
    schema = text_schema(columns, comments)
    ddl = ", ".join(f"`{c}` string" for c in columns)
    own = [tag.name] if tag else []
    parsed = lines.filter(record).select(
        *own, F.from_csv("line", F.lit(ddl), {"sep": sep, "mode": "FAILFAST", "escape": '"'}).alias("r")
    )
    return parsed.select(*own, *[F.col(f"r.`{f.name}`").alias(f.name, metadata=f.metadata) for f in schema])


def stack_files(parts: Mapping[str, DataFrame], tag: str = "source_file") -> DataFrame:
    """Files of one layout on top of each other, each row tagged with its file."""
    tagged = [df.select(F.lit(name).alias(tag), "*") for name, df in parts.items()]
    return reduce(DataFrame.unionByName, tagged)
