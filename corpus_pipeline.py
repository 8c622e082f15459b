"""A training corpus from raw documents: five stages, each one operator of ``ledgermatch.llm``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermatch.llm import bpe, decontam, jaccard, langid, pii
from ledgermatch.llm import spans as S
from ledgermatch.llm.common import checked_broadcast, materialize
from ledgermatch.llm.queries import RANKS

#: A document stays if its language is known with at least this calibrated probability.
LEAST_SCORE = 0.3


def _place(docs: DataFrame, name: str) -> str:
    return f"c{docs.columns.index(name)}"


def _numbered(docs: DataFrame) -> DataFrame:
    """Columns by number, so that none can clash with one that an operator adds."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)])


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: no text, no letter, or no language with ``LEAST_SCORE``.

    The model is fitted on the labelled rows of ``docs``. If there are none, no language can be told, and every document with
    a letter stays.
    """
    model = langid.train(docs)
    if not model.languages:
        return docs.filter(langid.has_letter("text"))
    known = langid.identify(_numbered(docs), model, _place(docs, "text"))
    return _named(known.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near duplicates the row with the least id, then the least text digest, stays; of equal rows, one.

    A row goes only if its class keeps another one: two unlike texts under one id are two classes. Rows without an id or without
    words are no duplicates and stay.
    """
    near = materialize(jaccard.near_duplicates(docs, detail=True).filter("class_key is not null"), "pipeline-classes")
    first = near.groupBy("class_key").agg(F.min(F.struct("doc_id", "text_key")).alias("kept"))
    several = near.groupBy("class_key", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    fate = several.join(first, "class_key").groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(
        F.bool_or(F.struct("doc_id", "text_key") == F.col("kept")).alias("_stays"), F.max("n").alias("_n")
    )
    # most rows are the only one of their class, and need no mention
    fate = materialize(fate.filter("not _stays or _n > 1"), "pipeline-fates")
    rows = docs.select(F.struct("*").alias("_row"))
    row = lambda c: F.col("_row").getField(c)
    same = (row("doc_id") == F.col("_id")) & (F.sha2(row("text").cast("binary"), 256) == F.col("_key"))
    judged = rows.join(checked_broadcast(fate, "7"), same, "left").filter(F.coalesce("_stays", F.lit(True)))
    columns = [row(c).alias(c) for c in docs.columns]
    once = judged.filter(F.coalesce("_n", F.lit(1)) == 1).select(*columns)
    again = judged.filter("_n > 1")
    return once.unionByName(again.dropDuplicates(["_id", "_key"]).select(*columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    found = decontam.leaks(_numbered(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), _place(docs, "text"))
    return _named(found.filter(F.size("leak_items") == 0), docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; ``n_chars`` follows the text. Null texts stay null."""
    found = pii.find(docs).filter(F.size("found") > 0).select(F.col("doc_id").alias("_id"), "_key", "found").dropDuplicates(["_id", "_key"])
    rows = docs.select(F.struct("*").alias("_row"))
    row = lambda c: F.col("_row").getField(c)
    same = row("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(row("text"), F.lit(""))) == F.col("_key"))
    clean = F.when(F.col("found").isNull(), row("text")).otherwise(S.redact(row("text"), F.col("found")))
    out = rows.join(found, same, "left").select("_row", "found", clean.alias("_clean"))
    size = F.when(F.col("found").isNull(), row("n_chars")).otherwise(F.length("_clean")) if "n_chars" in docs.columns else None
    changed = {"text": F.col("_clean"), "n_chars": size}
    return out.select(*[changed.get(f.name, row(f.name)).cast(f.dataType).alias(f.name) for f in docs.schema])


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its id, language, source and token ids, with digests of the ids and of the bytes they decode to."""
    return bpe.encode_with_digests(docs, RANKS, public_tokenizers.PATTERN, ["doc_id", "lang", "source", "ids"])


STAGES = [
    ("language_id", keep_known_language),
    ("jaccard_join", keep_one_of_each_class),
    ("decontamination", drop_leaks),
    ("pii", redact_personal_data),
    ("byte_bpe", encode_tokens),
]

#: The model, the MinHash forest and the tokenizer have no SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
