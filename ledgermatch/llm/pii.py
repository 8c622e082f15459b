"""Personal data: matches of fixed shapes seed lexical patterns that find further identifiers, with Spark expressions only."""

from __future__ import annotations

from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermatch.llm import spans as S
from ledgermatch.llm.common import materialize

#: The four base shapes, possessive and without starts inside a run, so that a long run is read once.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A word with a digit or an at sign may be an identifier.
SHAPED = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
KINDS = ["email", "ip", "card", "phone", "context"]
_EDGE = r"[^\p{L}\p{N}@+]"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(acc, i):
        d = F.substr(back, i + 1, F.lit(1)).cast("int") * (1 + i % 2)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    fits = F.length(digits).between(14, 19)
    return F.when(fits, F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0).otherwise(False)


def _octets(x: Column) -> Column:
    def small(part):
        bare = F.ltrim(part, F.lit("0"))
        return F.when(F.length(bare) > 3, False).otherwise(F.coalesce(F.try_to_number(F.concat(F.lit("0"), bare), F.lit("9999")), F.lit(0)) <= 255)

    return F.forall(F.split(x, r"\."), small)


def base_spans(text: Column) -> Column:
    """Emails, addresses, cards and phones of a text, as sorted ``(start, end, value, kind)``."""
    ip = F.filter(S.matches(text, IP, "ip"), lambda x: _octets(x["value"]))
    card = F.filter(S.matches(text, CARD, "card"), lambda x: _luhn(_digits(x["value"])))
    phone = F.filter(S.matches(text, PHONE, "phone", ["+"]), lambda x: F.length(_digits(x["value"])).between(10, 15))
    return S.ordered(F.concat(S.matches(text, EMAIL, "email", ["@"]), ip, card, phone), KINDS)


def _candidates(text: Column) -> Column:
    """Identifier-like words without the punctuation around them, each with the two words before and the word after it.

    An identifier before the word next to another one is ``<id>``.
    """
    empty = F.array().cast("array<struct<start:int,end:int,value:string,left:string,right:string>>")
    bare = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}]+", " ")
    words = lambda x: F.filter(F.split(bare(x), " "), lambda w: F.length(w) > 0)
    another = lambda there: F.when(there, F.array(F.lit("<id>"))).otherwise(F.array().cast("array<string>"))

    def one(x, i):
        lead = F.length(F.regexp_extract(x["v"], rf"^{_EDGE}*+", 0))
        core = F.regexp_replace(x["v"], rf"^{_EDGE}++|{_EDGE}++$", "")
        # an identifier alone is no pattern: the parts of one number stand next to each other
        left = F.when(F.size(x["before"]) > 0, F.concat(another(i > 0), x["before"])).otherwise(F.array().cast("array<string>"))
        return F.struct(
            x["gap"].alias("gap"), F.length(x["v"]).alias("n"), lead.alias("lead"), core.alias("value"),
            F.array_join(F.slice(left, F.greatest(F.size(left) - 1, F.lit(1)), 2), " ").alias("left"),
            F.coalesce(F.try_element_at(x["after"], F.lit(1)), F.lit("")).alias("right"),
        )

    def zipped(gaps):
        # the words of every gap are cut once; the gap after a value is the one before the next
        ahead = F.zip_with(F.regexp_extract_all(text, F.lit(SHAPED), F.lit(0)), gaps, lambda v, g: F.struct(v.alias("v"), g.alias("g")))
        each = F.zip_with(ahead, F.slice(gaps, F.lit(2), F.size(gaps)), lambda x, g: F.struct(
            x["v"].alias("v"), x["g"]["n"].alias("gap"), x["g"]["words"].alias("before"), g["words"].alias("after")))
        return F.transform(F.filter(each, lambda x: x["v"].isNotNull()), one)

    def placed(found):
        def span(x, at):
            start = at + x["gap"] + x["lead"]
            return F.struct(start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value"), x["left"].alias("left"), x["right"].alias("right"))

        return F.zip_with(found, S.before(F.transform(found, lambda x: x["gap"] + x["n"]), 0, add), span)

    between = lambda pieces: F.transform(pieces, lambda g: F.struct(F.length(g).alias("n"), words(g).alias("words")))
    gaps = S.let(F.split(text, SHAPED, -1), between)
    return F.when(text.rlike("[0-9@]"), S.let(S.let(gaps, zipped), placed)).otherwise(empty)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, least_support: int = 3, least_confidence: float = 0.8) -> DataFrame:
    """Personal data of every text: base shapes, and identifiers that stand where base entities stand.

    Words with a digit or an at sign are instances; the two words before and the word after one are its patterns, where an identifier
    before the word counts as a word. Instances that
    lie inside a base span are seeds of score 1. In each round a pattern's confidence is the mean score of its distinct instances
    over the whole corpus (one is added to the count, so rare patterns stay low). Only patterns of at least ``least_confidence``
    with at least ``least_support`` seeds are kept as confident. A context (the words before and after) scores the higher
    confidence of its confident patterns; without one it scores 0 if a pattern of it has ``least_support`` distinct instances, and else tells
    nothing. An instance scores the mean over its distinct contexts that tell something, so a value that is frequent elsewhere
    falls. After ``rounds`` rounds, instances of at least ``least_confidence`` are added as kind ``context``, at the places
    that stand in a confident pattern and overlap no base span.

    Base spans always stay. All counts are combined by (pattern, instance) before they are shuffled, so a pattern that a third
    of the rows share is no hot group. Returns per row: ``id_col``, ``base`` and ``found``, sorted arrays of ``(start, end, value, kind)``.
    Null texts are empty. Rows without base entities anywhere add nothing. Repeated rows and null ids are kept and
    get equal results. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.select("_id", F.xxhash64("_text").alias("_key"), base_spans(F.col("_text")).alias("base"), _candidates(F.col("_text")).alias("like"))
    rows = materialize(rows, "pii-found")

    marked = F.zip_with("like", S.overlaps(F.col("like"), F.col("base")), lambda x, seed: F.struct(x.alias("x"), seed.alias("seed")))
    places = rows.filter(F.size("like") > 0).select("_id", "_key", F.explode(marked).alias("m")).select("_id", "_key", "m.x", "m.seed", F.xxhash64("m.x.value").alias("instance"))
    contexts = F.array(F.when(F.length("x.left") > 0, F.concat(F.lit("before "), "x.left")), F.when(F.length("x.right") > 0, F.concat(F.lit("after "), "x.right")))
    places = materialize(places.withColumn("patterns", F.array_compact(contexts)), "pii-places")

    # each context of an instance counts once, however often it is repeated
    slots = places.groupBy("instance", "patterns").agg(F.max("seed").alias("seed"))
    slots = materialize(slots.select("instance", "seed", F.xxhash64("instance", "patterns").alias("slot"), F.explode("patterns").alias("pattern")), "pii-slots")
    edges = slots.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    known = edges.groupBy("pattern").agg(F.count_if("seed").alias("seeds"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_support)
    edges = materialize(edges.join(known, "pattern"), "pii-edges")
    scores = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    is_seed = slots.groupBy("instance").agg(F.max("seed").alias("seed"))
    for _ in range(rounds):
        patterns = edges.join(scores, "instance").groupBy("pattern").agg((F.sum("score") / (F.count(F.lit(1)) + 1)).alias("confidence"), F.max("seeds").alias("seeds"))
        sure = (F.col("confidence") >= least_confidence) & (F.col("seeds") >= least_support)
        patterns = materialize(patterns.select("pattern", F.when(sure, F.col("confidence")).otherwise(0.0).alias("confidence")), "pii-patterns")
        told = slots.join(patterns, "pattern").groupBy("instance", "slot").agg(F.max("confidence").alias("told"))
        told = told.groupBy("instance").agg(F.avg("told").alias("told"))
        scores = told.join(is_seed, "instance").select("instance", F.when(F.col("seed"), 1.0).otherwise(F.col("told")).alias("score"))
        scores = materialize(scores, "pii-scores")
    sure = scores.filter(F.col("score") >= least_confidence).select("instance")
    confident = patterns.filter("confidence > 0").select("pattern")
    added = places.filter("not seed").join(sure, "instance").withColumn("pattern", F.explode("patterns")).join(confident, "pattern")
    added = added.select("_id", "_key", F.struct("x.start", "x.end", "x.value", F.lit("context").alias("kind")).alias("x"))
    added = added.groupBy(F.col("_id").alias("_aid"), F.col("_key").alias("_akey")).agg(F.collect_set("x").alias("added"))

    out = rows.join(added, rows["_id"].eqNullSafe(F.col("_aid")) & (F.col("_key") == F.col("_akey")), "left")
    found = F.when(F.col("added").isNull(), F.col("base")).otherwise(S.ordered(F.concat("base", "added"), KINDS))
    return out.select(F.col("_id").alias(id_col), "_key", "base", found.alias("found"))
