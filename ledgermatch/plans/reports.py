"""Reports on one side of the match, read from the ledgers and not from the pairs."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.config import MatchConfig
from ledgermatch.functions.money import TOTAL, percent_of, total
from ledgermatch.operators.asof import RateBook
from ledgermatch.operators.rules import SETTLED
from ledgermatch.plans import profiles as P


def revenue_share(ledger: DataFrame, config: MatchConfig) -> DataFrame:
    """Sales, reversals and net revenue per provider, and its share of the whole."""
    captured = ledger.filter(f"status = '{SETTLED}' and {config.period.holds('captured_at_utc')}")
    per_psp = captured.groupBy("psp").agg(
        F.expr(f"count_if(operation_type = '{P.SALE}') as sales"),
        F.expr(f"count_if(operation_type <> '{P.SALE}') as reversals"),
        F.expr(f"{total('signed_amount_usd')} as net_usd"),
    )
    # a row per provider is left here
    return per_psp.selectExpr(
        "*",
        f"cast(sum(net_usd) over () as {TOTAL}) as sum_net_usd",
        f"{percent_of('net_usd', 'sum(net_usd) over ()')} as share_usd",
    ).orderBy(F.desc("share_usd"))


def money_events(provider: DataFrame, profile: P.Profile, config: MatchConfig, book: RateBook | None) -> DataFrame:
    """Provider rows that moved money in the period, with their money in base currency."""
    kept = provider.filter(config.period.holds("provider_at")).filter(P.moves_money(profile))
    if profile.ignored_types:
        kept = kept.filter(f"provider_type not in ({P.R.text_list(profile.ignored_types)})")
    if profile.keyless:
        kept = kept.filter(f"provider_type in ({P.R.text_list(profile.keyless[:2])})")
    return P.valued(kept, profile, config, book)


def provider_net(
    provider: DataFrame, profile: P.Profile, config: MatchConfig, book: RateBook | None, sale: str
) -> DataFrame:
    """Sales, reversals and net money of one provider; ``sale`` is the condition for a sale row."""
    return money_events(provider, profile, config, book).agg(
        F.expr(f"count_if({sale}) as sales"),
        F.expr(f"count_if(not ({sale})) as reversals"),
        F.expr(f"{total('full_usd')} as net_usd"),
    ).selectExpr(f"'{profile.psp}' as psp", "*")


def ledger_revenue(
    ledgers: Mapping[str, tuple[DataFrame, DataFrame, P.Profile]], config: MatchConfig, book: RateBook | None
) -> DataFrame:
    """Money per provider on both sides, straight from the ledgers: (psp, engine_usd, provider_usd)."""
    parts = []
    for engine, provider, profile in ledgers.values():
        at = config.period.holds("coalesce(captured_at_utc, created_at_utc)")
        booked = engine.filter(f"psp = '{profile.psp}' and status = '{SETTLED}' and {at}")
        parts.append(booked.selectExpr("psp", "signed_amount_usd as engine_usd", "cast(null as decimal(18,2)) as provider_usd"))
        reported = money_events(provider, profile, config, book)
        parts.append(reported.selectExpr(f"'{profile.psp}'", "cast(null as decimal(18,2))", "full_usd"))
    return reduce(DataFrame.unionAll, parts).groupBy("psp").agg(
        F.expr(f"{total('engine_usd')} as engine_usd"), F.expr(f"{total('provider_usd')} as provider_usd")
    )


def fee_percent(rows: DataFrame, gross: str, fee: str, contract_pct: str, *by: str) -> DataFrame:
    """Rows, gross, fee and effective percent by account; rows whose own percent is off the contract."""
    return rows.groupBy(*by).agg(
        F.expr("count(*) as row_count"),
        F.expr(f"{total(gross)} as gross"),
        F.expr(f"{total(fee)} as fee"),
        F.expr(f"{percent_of(f'sum({fee})', f'sum({gross})')} as fee_pct"),
        F.expr(
            f"count_if(round(100 * cast({fee} as double) / cast({gross} as double), 1) <> {contract_pct})"
            " as rows_off_contract"
        ),
    )
