"""Regex matches with their places, as Spark expressions: code points, end exclusive."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Elements that one fold appends to an array by copying it; a longer array is folded in blocks of this size.
_BLOCK = 512
#: Characters that ``redact`` cuts a text into before it looks places up.
_PIECE = 1024
_FAR = (1 << 31) - 1


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def before(numbers: Column, start: int, op: Callable[[Column, Column], Column]) -> Column:
    """For every element of an array of ints, ``op`` over ``start`` and the elements before it. ``start`` changes nothing under ``op``.

    A fold that appends copies its array at each step, so it runs within blocks, and over the totals of the blocks.
    """
    empty = F.array().cast("array<int>")

    def fold(values, zero):
        step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(values, F.struct(zero.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    def joined(blocks):
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(start), op))
        return F.flatten(F.zip_with(blocks, fold(totals, F.lit(start)), lambda b, at: fold(b, at)))

    def whole(values):
        last = F.floor((F.size(values) - 1) / _BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(values, i * _BLOCK + 1, F.lit(_BLOCK)))
        return F.when(F.size(values) == 0, empty).otherwise(let(blocks, joined))

    return let(numbers, whole)


def matches(text: Column, pattern: str, kind: str, needs: list[str] | None = None) -> Column:
    """Array of ``(start, end, value, kind)`` for the leftmost, non-overlapping matches of a pattern that matches no empty text.

    Built-in functions return matches without places. The text between two matches is what ``split`` returns, so the places
    are the running lengths of both. A text with none of the strings ``needs`` has no match and is not searched.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    lengths = F.zip_with(values, between, lambda v, b: F.struct(v.alias("value"), F.length(v).alias("n"), F.length(b).alias("gap")))
    empty = F.array().cast("array<struct<start:int,end:int,value:string,kind:string>>")

    def placed(found):
        span = lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["n"]).alias("end"), x["value"].alias("value"), F.lit(kind).alias("kind"))
        return F.zip_with(found, before(F.transform(found, lambda x: x["gap"] + x["n"]), 0, add), span)

    # the piece after the last match has no match of its own
    found = let(F.filter(lengths, lambda x: x["value"].isNotNull()), placed)
    likely = text.rlike(pattern)
    if needs:
        likely = reduce(or_, [text.contains(x) for x in needs]) & likely
    return F.when(likely, found).otherwise(empty)


def ordered(spans: Column, kinds: list[str]) -> Column:
    """Sorted by start, then by the kind's place in ``kinds``, then by end."""
    rank = lambda x: F.array_position(F.array(*[F.lit(k) for k in kinds]), x["kind"])
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("s"), rank(x).alias("r"), x["end"].alias("e"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda x: x["x"])


def listed(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def overlaps(spans: Column, taken: Column) -> Column:
    """For each of ``spans``, whether it overlaps one of ``taken``. Both are sorted by start; no span is empty, and no two of ``spans`` start together.

    One pass over both in order of their starts: a span is met from the left if a start before it reaches beyond its own, and
    from the right if the next start lies before its end.
    """
    place = lambda x, who: F.struct(x["start"].alias("start"), F.lit(who).alias("who"), x["end"].alias("end"))
    both = F.array_sort(F.concat(F.transform(taken, lambda x: place(x, 0)), F.transform(spans, lambda x: place(x, 1))))

    def judged(all_):
        ends = F.transform(all_, lambda x: F.when(x["who"] == 0, x["end"]).otherwise(0))
        starts = F.transform(all_, lambda x: F.when(x["who"] == 0, x["start"]).otherwise(_FAR))
        reach, next_ = before(ends, 0, _most), F.reverse(before(F.reverse(starts), _FAR, _least))
        near = F.zip_with(reach, next_, lambda r, n: F.struct(r.alias("reach"), n.alias("next")))
        met = F.zip_with(all_, near, lambda x, y: F.struct(x["who"].alias("who"), ((y["reach"] > x["start"]) | (y["next"] < x["end"])).alias("met")))
        return F.transform(F.filter(met, lambda x: x["who"] == 1), lambda x: x["met"])

    none = F.transform(spans, lambda x: F.lit(False))
    return F.when((F.size(spans) == 0) | (F.size(taken) == 0), none).otherwise(let(both, judged))


def apart_from(spans: Column, taken: Column) -> Column:
    """The spans that overlap none of ``taken``; see ``overlaps`` for the order that both must have."""
    marked = F.zip_with(spans, overlaps(spans, taken), lambda x, met: F.struct(x.alias("x"), met.alias("met")))
    return F.transform(F.filter(marked, lambda x: ~x["met"]), lambda x: x["x"])


def redact(text: Column, spans: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by ``[KIND]`` of its first one. ``spans`` is sorted.

    The text is cut into pieces of equal length first, so a place is found without counting characters from the start.
    """
    word = lambda x: F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))

    def cut(pieces, a, b):
        first = F.floor(a / _PIECE).cast("int")
        near = F.array_join(F.slice(pieces, first + 1, F.floor(b / _PIECE).cast("int") - first + 1), "")
        return F.substr(near, a - first * _PIECE + 1, b - a)

    def replaced(pieces):
        def filled(gaps):
            tail = F.greatest(F.array_max(F.transform(gaps, lambda g: g["end"])), F.lit(0))
            said = F.transform(F.filter(gaps, lambda g: g["start"] >= g["at"]), lambda g: F.concat(cut(pieces, g["at"], g["start"]), g["word"]))
            return F.concat(F.array_join(said, ""), cut(pieces, tail, F.length(text)))

        reach = before(F.transform(spans, lambda x: x["end"]), 0, _most)
        gap = lambda x, at: F.struct(at.alias("at"), x["start"].alias("start"), x["end"].alias("end"), word(x).alias("word"))
        return let(F.zip_with(spans, reach, gap), filled)

    done = let(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_PIECE}}}"), F.lit(0)), replaced)
    return F.when(F.size(spans) > 0, done).otherwise(text)
