"""Exact quantiles and descriptions by group, without holding a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.operators import skew

#: rank accuracy of the estimate that brackets a quantile
_ACCURACY = 10_000
#: the bracket is this many accuracies wide on either side
_MARGIN = 4
#: a group below this is its own bracket; above it, a margin spans more than the ranks next to a quantile
_SMALL = 50_000
#: slices of a bracket that are counted apart
_SLICES = 64


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    also: Mapping[str, str] | None = None,
) -> DataFrame:
    """Exact interpolated quantiles of a double column: one row per group, one column per name.

    ``also`` adds aggregates over ``v``, the value, as {name: SQL}. The first pass estimates with known
    rank error and so brackets each exact quantile; its result is a row per group. The second pass counts
    the rows below a bracket, drops those above it and keeps the few values inside, all before the
    shuffle; equal values have been counted together before it. A bracket is cut into slices of equal
    width that are counted apart, so no task holds a group. A quantile outside its bracket is an error,
    never a wrong number.
    """
    by, also = list(by), dict(also or {})
    keys = [f"`{c}`" for c in by] or ["0 as all_rows"]
    by = by or ["all_rows"]
    rows = df.selectExpr(*keys, f"cast({value} as double) as v").filter("v is not null")
    margin = _MARGIN / _ACCURACY
    lows = [f"{p - margin}D" if p > margin else None for p in probs.values()]
    highs = [f"{p + margin}D" if p + margin < 1 else None for p in probs.values()]

    def bounds(points, end):
        near = f"if(count(*) < {_SMALL}, {end}, percentile_approx(v, %s, {_ACCURACY}))"
        return ", ".join(end if p is None else near % p for p in points)

    brackets = rows.groupBy(*by).agg(
        F.expr("count(*) as total"),
        F.expr(f"arrays_zip(array({bounds(lows, 'min(v)')}), array({bounds(highs, 'max(v)')})) as ends"),
        *[F.expr(f"{sql} as {name}") for name, sql in also.items()],
    )
    names = [f"`{c}`" for c in by]
    inside = "nanvl((v - b['0']) / (b['1'] - b['0']), 1D)"
    slice_of = f"if(b['1'] > b['0'], least({_SLICES - 1}, int(floor({inside} * {_SLICES}))), 0)"
    near = (
        rows.join(skew.broadcast_if_small(brackets.select(*by, "ends")), by)
        .selectExpr(*names, "v", "posexplode(ends) as (i, b)")
        .filter("v <= b['1']")
        .groupBy(*by, "i", F.expr(f"if(v < b['0'], -1, {slice_of}) as slice"), F.expr("if(v < b['0'], null, v) as v"))
        .agg(F.expr("count(*) as n"))
    )
    of_group = f"partition by {', '.join(names)}, i"
    # a row per group, quantile and slice
    starts = (
        near.groupBy(*by, "i", "slice")
        .agg(F.expr("sum(n) as slice_n"))
        .selectExpr(*names, "i", "slice", f"sum(slice_n) over ({of_group} order by slice) - slice_n as earlier")
    )
    points = "array(" + ", ".join(f"{p}D" for p in probs.values()) + ")"
    counted = near.join(starts, [*by, "i", "slice"]).selectExpr(
        *names, "i", "v", "n", f"earlier + sum(n) over ({of_group}, slice order by v) as upto"
    )
    placed = counted.join(skew.broadcast_if_small(brackets.select(*by, "total")), by).selectExpr(
        *names, "i", "v", "n", "upto", f"(total - 1) * element_at({points}, i + 1) as place"
    )
    ends = placed.groupBy(*by, "i", "place").agg(
        F.expr("max(if(floor(place) >= upto - n and floor(place) < upto, v, null)) as low"),
        F.expr("max(if(ceil(place) >= upto - n and ceil(place) < upto, v, null)) as high"),
    )
    missed = "raise_error('a quantile lies outside its bracket')"
    exact = f"if(low is null or high is null, {missed}, low + (high - low) * (place - floor(place)))"
    named = [
        F.expr(f"max(if(i = {i}, {exact}, null)) as {name}")
        for i, name in enumerate(probs)
    ]
    result = ends.groupBy(*by).agg(*named)
    if also:
        result = result.join(brackets.select(*by, *also), by)
    return result.drop("all_rows")


def describe(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of a column for each group with a value."""
    moments = {"count": "count(v)", "mean": "avg(v)", "std": "stddev_samp(v)", "min": "min(v)", "max": "max(v)"}
    described = quantiles(df, by, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, moments)
    return described.select(*by, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def spread_of(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rows, min, median, 99th percentile and max of a column for each group with a value."""
    ends = {"row_count": "count(v)", "min": "min(v)", "max": "max(v)"}
    spread = quantiles(df, by, value, {"median": 0.5, "p99": 0.99}, ends)
    return spread.select(*by, "row_count", "min", "median", "p99", "max")
