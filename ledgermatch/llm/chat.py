"""Chat formatting with Spark expressions only: sort turns, merge neighbours of one role, concatenate, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template. A block is a start mark, the role, a line feed, texts joined by the join mark, and an end mark.
START, JOIN, END = "<|im_start|>", "<|im_join|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """One backslash more between ``<`` and ``|``, so that no control string is left; reversible."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role may hold neither a line feed nor a control string; percent signs keep this reversible."""
    for a, b in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def unescape_role(role: Column) -> Column:
    for a, b in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``formatted`` and ``loss_spans``, the code points that a loss may be taken on.

    The turns of a conversation are collected as structs, sorted, and neighbours of one role are merged into one block; the join
    mark keeps their bounds. A span covers one escaped text of ``loss_role`` and no mark. The only shuffle is on the
    conversation; its turns must meet in one row, since the result is one text, and a cell of Spark bounds that text.

    Null texts and roles are empty. Turns are ordered by turn (null first), role and text, so ties and repeated rows have one
    order and are all kept. A null conversation id is a group of its own. An empty table gives an empty result. Other columns
    are ignored, whatever their names.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    rows = turns.select(F.col(conv_col).alias("_conv"), turn.alias("_turn")).groupBy("_conv").agg(F.sort_array(F.collect_list("_turn")).alias("turns"))
    none = F.array().cast("array<struct<role:string,texts:array<string>>>")

    def merge(blocks, x):
        last = F.try_element_at(blocks, F.lit(-1))
        text = F.array(escape(x["text"]))
        grown = F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(F.struct(x["role"].alias("role"), F.concat(last["texts"], text).alias("texts"))))
        new = F.concat(blocks, F.array(F.struct(x["role"].alias("role"), text.alias("texts"))))
        return F.when((F.size(blocks) > 0) & (last["role"] == x["role"]), grown).otherwise(new)

    merged = F.aggregate("turns", none, merge)
    rows = rows.select("_conv", merged.alias("blocks"))
    head = lambda b: F.concat(F.lit(START), escape_role(b["role"]), F.lit("\n"))
    body = F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], JOIN), F.lit(END)))

    # every text with the length of what stands before it since the text before
    def lengths(b):
        return F.transform(b["texts"], lambda t, i: F.struct(F.when(i == 0, F.length(head(b))).otherwise(len(JOIN)).alias("before"), F.length(t).alias("n"), F.when(i == F.size(b["texts"]) - 1, len(END)).otherwise(0).alias("after"), (b["role"] == loss_role).alias("loss")))

    spans = F.array().cast("array<struct<start:int,end:int>>")
    zero = F.struct(F.lit(0).alias("at"), spans.alias("out"))

    def place(acc, x):
        start = acc["at"] + x["before"]
        out = F.when(x["loss"], F.concat(acc["out"], F.array(F.struct(start.alias("start"), (start + x["n"]).alias("end"))))).otherwise(acc["out"])
        return F.struct((start + x["n"] + x["after"]).alias("at"), out.alias("out"))

    masked = F.aggregate(F.flatten(F.transform("blocks", lengths)), zero, place, lambda acc: acc["out"])
    return rows.select(F.col("_conv").alias(conv_col), F.array_join(body, "").alias("formatted"), masked.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of ``(role, text)``."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: F.length(b) > 0)

    def parse(b):
        inner = F.substr(b, F.lit(len(START) + 1))
        role = F.substring_index(inner, "\n", 1)
        texts = F.split(F.substr(inner, F.length(role) + 2), r"<\|im_join\|>", -1)
        return F.transform(texts, lambda t: F.struct(unescape_role(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, parse))


def loss_text(formatted: Column, spans: Column) -> Column:
    """What stands under the mask, unescaped, one span after the other."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
