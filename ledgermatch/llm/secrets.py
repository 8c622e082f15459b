"""Secret scans: matches of fixed shapes, and corpus-wide ownership of candidate values, with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.llm import spans as S
from ledgermatch.llm.common import materialize

#: The three base shapes. Possessive where nothing can follow, so that no long run is tried twice.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++"""
ASSIGNED = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
#: A value of another shape that may be a credential: 20 or more characters with letters and digits.
SHAPED = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ["assign", "access", "hex", "live"]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source", spread: tuple[int, int] = (3, 2)) -> DataFrame:
    """Secrets of every text: base spans, and candidates that the corpus shows to belong to one owner.

    Base kinds: ``assign`` (a name, a sign and 8 or more characters), ``access`` (16 or more) and ``hex`` (32 or more).
    A candidate is the value of a base match, or any other run of 20 or more characters with letters and digits.
    Candidates are hashed and counted over all rows by owner: the repositories that hold them, where copies of one text count once,
    for the least of their owners. The counts are combined before each shuffle, so a value that a third of the rows hold is no heavy
    group. How widely a value is spread is its effective number of owners, ``(sum n)^2 / sum n^2`` over the repositories ``n`` of each owner; it depends on
    shares, not on the size of the corpus. A value spread over more than ``spread`` (three halves) is a widely copied example, any other
    is live: used often by one owner, or now and then by another. Base spans stay whatever the verdict; a live candidate that overlaps no base span is
    added as kind ``live``.

    Returns per row: ``id_col``, ``base`` and ``found`` (sorted arrays of ``(start, end, value, kind)``; the value is the
    matched text), ``n_live`` and ``n_example`` (candidates by verdict). Null texts are empty. A null owner or repository counts as one more
    owner or repository. Repeated rows get equal results and count once. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.col(repository_col).cast("string").alias("_repo"), F.col(owner_col).cast("string").alias("_owner"))
    text = F.col("_text")
    value = lambda x: F.regexp_replace(x["value"], ASSIGNED, "")
    assign = F.filter(S.matches(text, ASSIGN, "assign", [":", "="]), lambda x: F.length(value(x)) >= 8)
    access = F.filter(S.matches(text, ACCESS, "access", ["AKIA"]), lambda x: F.length(x["value"]) >= 16)
    hexes = S.matches(text, HEX, "hex")
    shaped = F.filter(S.matches(text, SHAPED, "live"), lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]"))
    rows = rows.select("_id", "_repo", "_owner", F.xxhash64("_text").alias("_copy"), S.ordered(F.concat(assign, access, hexes), KINDS).alias("base"), shaped.alias("shaped"))
    rows = rows.withColumn("more", S.apart_from(F.col("shaped"), F.col("base"))).drop("shaped")
    hashed = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["kind"].alias("kind"), F.xxhash64(value(x)).alias("hash"))
    rows = rows.withColumn("_key", F.xxhash64("_id", "_repo", "_owner", "base", "more"))
    rows = materialize(rows.withColumn("seen", F.transform(F.concat("base", "more"), hashed)), "secrets-found")

    held = rows.filter(F.size("seen") > 0).select("_copy", "_repo", "_owner", F.explode(F.array_distinct("seen.hash")).alias("hash"))
    # one place per text: a null owner is the least
    place = F.min(F.struct(F.col("_owner").isNotNull().alias("known"), "_owner", "_repo")).alias("at")
    texts = held.groupBy("hash", "_copy").agg(place).select("hash", "at._owner", "at._repo").distinct()
    by_owner = texts.groupBy("hash", "_owner").agg(F.count(F.lit(1)).alias("n"))
    owned = by_owner.groupBy("hash").agg((F.sum("n") * F.sum("n") * spread[1] <= F.sum(F.col("n") * F.col("n")) * spread[0]).alias("live"))

    each = rows.filter(F.size("seen") > 0).select("_id", "_key", F.explode("seen").alias("x")).distinct().select("_id", "_key", "x", F.col("x.hash").alias("hash"))
    judged = each.join(owned, "hash").groupBy("_id", "_key").agg(F.collect_list(F.when(F.col("live") & (F.col("x.kind") == "live"), F.struct("x.start", "x.end", "x.value", "x.kind"))).alias("added"), F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"))
    judged = judged.withColumnRenamed("_id", "_jid").withColumnRenamed("_key", "_jkey")
    out = rows.join(judged, rows["_id"].eqNullSafe(F.col("_jid")) & (F.col("_key") == F.col("_jkey")), "left")
    none = F.array().cast("array<struct<start:int,end:int,value:string,kind:string>>")
    found = S.ordered(F.concat("base", F.coalesce("added", none)), KINDS)
    return out.select(F.col("_id").alias(id_col), "base", found.alias("found"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))
