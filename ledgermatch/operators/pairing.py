"""Full outer pairing of two ledgers.

Every row of both sides comes out. The n-th provider row of a key meets the n-th engine row of that
key; provider rows beyond the last engine row meet that last one. With one engine row per key, the
usual case, this is the plain full outer join on the key, and true repeats on both sides pair one to
one in place of all with all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.config import HOT_ROWS
from ledgermatch.operators import skew
from ledgermatch.operators.dedup import stable_order

#: gives rows without a key a value of their own, so that they do not all hash to one partition
SPREAD = "_spread"
_NTH, _COPIES = "_nth", "_copies"


def with_spread(df: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Adds the spreading value: 0 for a row with a key, else a hash of ``by`` or of all other columns.

    A few columns are better than all, since the search for heavy keys has to read them.
    """
    if SPREAD in df.columns:
        return df
    no_key = " or ".join(f"`{k}` is null" for k in keys)
    rest = by or [c for c in df.columns if c not in keys]
    return df.selectExpr("*", f"if({no_key}, xxhash64({skew.quoted(rest)}), 0L) as {SPREAD}")


def spread_keys(keys: Sequence[str]) -> list[str]:
    return [*keys, SPREAD]


def pair_ledgers(
    engine: DataFrame,
    provider: DataFrame,
    keys: Sequence[str],
    *,
    engine_order: Sequence[str],
    provider_order: Sequence[str] = (),
    rank: str = "dup_rank",
    hot: skew.Hot | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Both sides' columns, plus ``rank`` (place among the provider rows of the key),
    ``engine_copies``, ``has_engine`` and ``has_provider``.

    Both frames carry the key columns; all other column names must differ. A null key pairs with nothing.
    """
    if hot is None:
        hot = skew.hot_keys({"pair": both_keys(engine, provider, keys)}, hot_rows)["pair"]
    on = spread_keys(keys)
    engine, provider = with_spread(engine, keys), with_spread(provider, keys)
    e_order = stable_order(engine, on, engine_order)
    p_order = stable_order(provider, on, provider_order)
    e_plain, e_heavy = skew.split_hot(engine, on, hot)
    p_plain, p_heavy = skew.split_hot(provider, on, hot)
    paired = _pair_in_place(e_plain, p_plain, on, e_order, p_order, rank)
    if e_heavy is None:
        return paired
    return paired.unionByName(_pair_spread(e_heavy, p_heavy, on, e_order, p_order, rank, bounded=hot.few))


def both_keys(engine: DataFrame, provider: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The key columns of both sides stacked, for ``skew.hot_keys``."""
    on = spread_keys(keys)
    return with_spread(engine, keys).select(*on).unionAll(with_spread(provider, keys).select(*on)), on


def _pair_in_place(engine, provider, on, e_order, p_order, rank) -> DataFrame:
    """Both sides are hashed by key once; ranks, the count and the join all use that layout."""
    window = f"partition by {skew.quoted(on)}"
    engine = engine.selectExpr(
        "*", f"row_number() over ({window} order by {e_order}) as {_NTH}", f"count(*) over ({window}) as {_COPIES}"
    )
    provider = skew.window_rank(provider, on, p_order, rank)
    return _join_sides(engine, provider, on, rank, f" and e.{_NTH} = least(p.{rank}, e.{_COPIES})")


def _pair_spread(engine, provider, on, e_order, p_order, rank, bounded: bool) -> DataFrame:
    """Heavy keys: the place in the key is part of the join key, so one key spreads over all tasks.

    The surplus copies of a key all meet its last engine row: one row per key, which is joined
    by broadcast when the number of heavy keys is bounded and as the unskewed side otherwise.
    """
    engine = skew.spread_rank(engine, on, e_order, _NTH)
    provider = skew.spread_rank(provider, on, p_order, rank)
    keyed = " and ".join(f"`{k}` is not null" for k in on)
    copies = engine.filter(keyed).groupBy(*on).agg(F.expr(f"count(*) as {_COPIES}"))
    copies = F.broadcast(copies) if bounded else copies
    engine = engine.join(copies, list(on), "left")
    provider = provider.join(copies.withColumnRenamed(_COPIES, "_met"), list(on), "left")

    firsts = provider.filter(f"_met is null or {rank} <= _met").drop("_met")
    paired = _join_sides(engine, firsts, on, rank, f" and e.{_NTH} = p.{rank}")
    last = engine.filter(f"{_NTH} = {_COPIES}")
    last = F.broadcast(last) if bounded else last
    surplus = provider.filter(f"{rank} > _met").drop("_met")
    return paired.unionByName(_join_sides(last, surplus, on, rank, "", how="right"))


def _join_sides(engine, provider, on, rank, place: str, how: str = "full") -> DataFrame:
    keys = [k for k in on if k != SPREAD]
    e_only = [c for c in engine.columns if c not in (*on, _NTH, _COPIES)]
    p_only = [c for c in provider.columns if c not in (*on, rank)]
    same = " and ".join(f"e.`{k}` = p.`{k}`" for k in on) + place
    joined = engine.selectExpr("*", "true as _e").alias("e").join(
        provider.selectExpr("*", "true as _p").alias("p"), F.expr(same), how
    )
    return joined.selectExpr(
        *[f"coalesce(e.`{k}`, p.`{k}`) as `{k}`" for k in keys],
        *[f"`{c}`" for c in (*e_only, *p_only)],
        f"p.{rank}",
        f"int({_COPIES}) as engine_copies",
        "_e is not null as has_engine",
        "_p is not null as has_provider",
    )
