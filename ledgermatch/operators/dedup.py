"""Rank of a row among the copies that share its key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.config import HOT_ROWS
from ledgermatch.operators import skew


def stable_order(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> str:
    """SQL order: the given columns, then every other one, so that only identical rows can tie.

    Better plain columns: an expression, which is what holds a bracket, is computed before the shuffle and travels
    with the rows.
    """
    rest = [c for c in df.columns if c not in order_by and c not in keys]
    given = [c if "(" in c else skew.quoted([c]) for c in order_by]
    return ", ".join([*given, *([skew.quoted(rest)] if rest else [])]) or "1"


def dup_rank(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str] = (),
    *,
    hot: skew.Hot | None = None,
    hot_rows: int = HOT_ROWS,
    name: str = "dup_rank",
) -> DataFrame:
    """Number the rows of each key from 1; nothing is dropped.

    ``hot`` takes the result of ``skew.hot_keys`` when the caller has it already.
    """
    if hot is None:
        hot = skew.hot_keys({name: (df, keys)}, hot_rows)[name]
    order = stable_order(df, keys, order_by)
    plain, heavy = skew.split_hot(df, keys, hot)
    ranked = skew.window_rank(plain, keys, order, name)
    return ranked if heavy is None else ranked.unionByName(skew.spread_rank(heavy, keys, order, name))


def first_rate(
    rates: DataFrame,
    *,
    currency: str = "currency",
    date: str = "rate_date",
    rate: str = "usd_rate",
    prefer: str | None = None,
) -> DataFrame:
    """One rate per currency and day: the lowest, or the one with the smallest ``prefer``.

    The copies with rank 1 and nothing else, so it is an aggregate that combines before the shuffle.
    """
    chosen = f"min(`{rate}`)" if prefer is None else f"min_by(`{rate}`, struct(`{prefer}`, `{rate}`))"
    return rates.groupBy(currency, date).agg(F.expr(f"{chosen} as `{rate}`"))
