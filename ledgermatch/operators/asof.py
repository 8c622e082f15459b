"""Last rate on or before a date.

Spark has no as-of join. A join on ``start <= date < end`` would compare every fact with every
rate of its currency. So the rates are laid out as one row per currency and day, each row carrying
the last rate known on that day, and the as-of join becomes an equi-join with one match per fact.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date as Date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.functions import money
from ledgermatch.functions.text import literal
from ledgermatch.operators.dedup import first_rate
from ledgermatch.operators.skew import checkpoint, quoted


@dataclass(frozen=True)
class RateBook:
    """Daily rates, gaps filled: (rate_currency, on_date, known_date, known_rate)."""

    daily: DataFrame
    last_date: Date | None
    #: the checked row bound allows a broadcast; otherwise the join shuffles on currency and day,
    #: where adaptive execution splits the fact side of a heavy day
    small: bool

    def lookup(self) -> DataFrame:
        return F.broadcast(self.daily) if self.small else self.daily

    def close(self) -> None:
        """Let go of the kept table."""
        self.daily.unpersist()


def rate_book(
    rates: DataFrame,
    *,
    currency: str = "currency",
    date: str = "rate_date",
    rate: str = "usd_rate",
    prefer: str | None = None,
    broadcast_rows: int = 1_000_000,
) -> RateBook:
    """Lay the rates out by day. One small job reads their extent, which bounds the row count."""
    one = first_rate(rates, currency=currency, date=date, rate=rate, prefer=prefer)
    extent = rates.agg(
        F.expr(f"count(distinct `{currency}`) as currencies"),
        F.expr(f"min(`{date}`) as first"),
        F.expr(f"max(`{date}`) as last"),
    ).first()
    days = 0 if extent.last is None else (extent.last - extent.first).days + 1
    last = "null" if extent.last is None else f"date'{extent.last}'"
    # at most one row per day is left for a currency, so this window stays small
    following = f"lead(`{date}`) over (partition by `{currency}` order by `{date}`)"
    daily = one.selectExpr("*", f"ifnull(date_sub({following}, 1), {last}) as until").selectExpr(
        f"`{currency}` as rate_currency",
        f"explode(sequence(`{date}`, until)) as on_date",
        f"`{date}` as known_date",
        f"`{rate}` as known_rate",
    )
    small = extent.currencies * days <= broadcast_rows
    # a small table is kept: every ledger looks its rates up here, and a few partitions hold it
    return RateBook(daily.coalesce(8).persist() if small else daily, extent.last, small)


def attach_rate(
    facts: DataFrame,
    book: RateBook,
    currency: str,
    on: str,
    *,
    base: str | None = None,
    rate_name: str = "fx_rate",
    date_name: str = "fx_date",
) -> DataFrame:
    """Left as-of join: adds the rate and its date, null before the first rate of the currency.

    ``on`` is SQL text for the date. Rows in the ``base`` currency get rate 1 and their own date.
    """
    # a date after the last rate sees the last rate; a null date must stay null
    last = "null" if book.last_date is None else f"date'{book.last_date}'"
    known = f"if(({on}) > {last}, {last}, ({on}))"
    looked_up = f"`{currency}`"
    if base is not None and not book.small:
        # base rows need no rate: spread over keys that no rate has, they do not meet on one currency and day
        apart = f"concat('~', pmod(xxhash64({quoted(facts.columns)}), 1024))"
        looked_up = f"if(`{currency}` = {literal(base)}, {apart}, `{currency}`)"
    same = f"{looked_up} = rate_currency and {known} = on_date"
    joined = facts.join(book.lookup(), F.expr(same), "left")
    rate, date = "known_rate", "known_date"
    if base is not None:
        rate = f"if(`{currency}` = '{base}', cast(1 as {money.RATE}), {rate})"
        date = f"if(`{currency}` = '{base}', {on}, {date})"
    return joined.selectExpr("*", f"{rate} as `{rate_name}`", f"{date} as `{date_name}`").drop(*book.daily.columns)


def attach_interval(
    facts: DataFrame,
    starts: DataFrame,
    keys: Sequence[str],
    on: str,
    valid_from: str,
    values: Sequence[str],
    broadcast_rows: int = 100_000,
) -> DataFrame:
    """Left as-of join with open-ended validity: the values of the last start of the key on or before ``on``.

    ``starts`` holds ``keys``, ``valid_from`` and ``values``; a start stays in force until the next one of its key, however far
    that is, so nothing is laid out by day. ``on`` is SQL text over ``facts``. A start without a date has always been in force.
    A null key meets nothing, and a fact without a date sees only starts without one. Of equal starts the one with the greatest values counts.

    A short job counts the starts. Up to ``broadcast_rows`` of them go to the facts as one sorted array per key, and no fact moves.
    More are merged with the facts by ``spread_interval``. Both routes give the same rows.
    """
    if starts.limit(broadcast_rows + 1).count() > broadcast_rows:
        return spread_interval(facts, starts, keys, on, valid_from, values)
    entry = f"struct(`{valid_from}` is not null as known, `{valid_from}` as at, struct({quoted(values)}) as found)"
    arrays = starts.groupBy(*[F.expr(f"`{k}` as _key{i}") for i, k in enumerate(keys)]).agg(
        F.expr(f"sort_array(collect_list({entry})) as _starts")
    )
    same = " and ".join(f"`{k}` = _key{i}" for i, k in enumerate(keys))
    due = f"try_element_at(filter(_starts, x -> not x.known or x.at <= ({on})), -1).found"
    joined = facts.join(F.broadcast(arrays), F.expr(same), "left").selectExpr("*", f"{due} as _found")
    return joined.selectExpr(*[f"`{c}`" for c in facts.columns], *[f"_found.`{v}` as `{v}`" for v in values])


def spread_interval(
    facts: DataFrame, starts: DataFrame, keys: Sequence[str], on: str, valid_from: str, values: Sequence[str]
) -> DataFrame:
    """``attach_interval`` as one ordered merge of facts and starts, without ever holding one key in one task.

    Both are range-partitioned by key and date. In a partition the last start seen is carried forward by ``last_value``; the last
    start of the earlier partitions of the same key, of which there is one row per partition, is what the partition begins with.
    The checkpoints fix row ids and partition bounds.
    """
    by_key = ", ".join(f"_key{i}" for i in range(len(keys)))
    named = [f"`{k}` as _key{i}" for i, k in enumerate(keys)]
    late = facts.selectExpr(*named, f"({on}) as _on", "1 as _kind", "struct(*) as _fact")
    early = starts.selectExpr(*named, f"`{valid_from}` as _on", "0 as _kind", f"struct({quoted(values)}) as _found")
    events = early.unionByName(late, allowMissingColumns=True).selectExpr("*", "monotonically_increasing_id() as _row")
    tasks = max(int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    order = "_on, _kind, _found, _row"
    merged = checkpoint(events).repartitionByRange(tasks, *by_key.split(", "), *order.split(", "))
    merged = checkpoint(merged.selectExpr("*", "spark_partition_id() as _part"))

    # one row per key and partition
    earlier = f"over (partition by {by_key} order by _part rows between unbounded preceding and 1 preceding)"
    ends = merged.groupBy(*by_key.split(", "), "_part").agg(
        F.expr("max(if(_kind = 0, struct(_on is not null as known, _on, _found), null)) as _last")
    )
    carried = ends.selectExpr("*", f"last_value(_last._found) ignore nulls {earlier} as _carried")
    here = f"over (partition by _part, {by_key} order by {order} rows unbounded preceding)"
    local = merged.selectExpr("*", f"last_value(_found) ignore nulls {here} as _here").filter("_kind = 1")
    whole = " and ".join(["l._part = c._part", *[f"l._key{i} <=> c._key{i}" for i in range(len(keys))]])
    joined = local.alias("l").join(carried.alias("c"), F.expr(whole)).selectExpr("l._fact", "ifnull(l._here, c._carried) as _due")
    known = " and ".join(f"_fact.`{k}` is not null" for k in keys)
    return joined.selectExpr(*[f"_fact.`{c}`" for c in facts.columns], *[f"if({known}, _due.`{v}`, null) as `{v}`" for v in values])
