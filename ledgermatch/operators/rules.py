"""Ordered cause rules over paired rows: the first rule that holds names the cause."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ledgermatch.config import MatchConfig
from ledgermatch.functions import times
from ledgermatch.functions.text import literal

SETTLED, DECLINED = "settled", "declined"
ENGINE, PROVIDER = "engine", "provider"

# The side whose figure stands, by cause.
WINNERS = {
    "missing_at_provider": PROVIDER,
    "missing_in_engine": PROVIDER,
    "duplicate_row_in_export": ENGINE,
    "provider_date_format": ENGINE,
    "period_cutoff": ENGINE,
    "matched_declined": ENGINE,
    "status_mismatch": PROVIDER,
    "amount_mismatch": PROVIDER,
    "engine_fx_rate_error": PROVIDER,
    "matched": ENGINE,
    "engine_fx_date_error": PROVIDER,
    "fx_date_lag": PROVIDER,
    "provider_fx_rate": ENGINE,
}
MATCHED_CAUSES = ("matched", "matched_declined")


@dataclass(frozen=True)
class CauseRules:
    """The ordered causes of one profile, and the provider statuses they read."""

    order: tuple[str, ...]
    #: cause of a pair no rule caught
    fallback: str
    #: provider statuses that agree with a settled engine row
    accepted: tuple[str, ...] = ()
    #: provider status that agrees with a declined engine row
    refused: str | None = None
    #: True: a match needs equal money in base currency; False: equal status is enough
    compare_money: bool = True


#: money without a rate; its own cause, which no rule table knows, so the pair is unexplained and not lost
MISSING_RATE = "missing_rate"
UNPRICED = "(provider_usd is null or engine_usd is null)"


def classify(pairs: DataFrame, rules: CauseRules, config: MatchConfig) -> DataFrame:
    """Adds ``cause`` to paired rows."""
    branches = " ".join(f"when {_CONDITIONS[name](rules, config)} then '{name}'" for name in rules.order)
    return pairs.selectExpr("*", f"case when {UNPRICED} then '{MISSING_RATE}' {branches} else '{rules.fallback}' end as cause")


#: a provider row beyond the engine rows of its key; its engine money is already counted
SURPLUS_COPY = "dup_rank > greatest(engine_copies, 1)"


def text_list(values: Sequence[str]) -> str:
    return ", ".join(literal(v) for v in values)


def cause_bucket(known: Sequence[str] = tuple(WINNERS)) -> str:
    """SQL text: matched, explained, or unexplained for a cause no rule table knows."""
    return (
        f"case when cause in ({text_list(MATCHED_CAUSES)}) then 'matched'"
        f" when cause in ({text_list(known)}) then 'explained' else 'unexplained' end"
    )


def winner_table(spark: SparkSession, winners: Mapping[str, str] = WINNERS) -> DataFrame:
    rows = ", ".join(f"({literal(cause)}, {literal(side)})" for cause, side in winners.items())
    return spark.sql(f"select * from values {rows} as rules(cause, corrected_from)")


_FLAGS_DIFFER = "engine_in_period <> provider_in_period"


def _accepted(rules: CauseRules) -> str:
    return f"provider_status in ({text_list(rules.accepted)})"


def _status_mismatch(rules: CauseRules, config: MatchConfig) -> str:
    not_settled = f"engine_status <> '{SETTLED}'"
    return f"({not_settled} or not {_accepted(rules)})" if rules.accepted else not_settled


def _amount_mismatch(rules: CauseRules, config: MatchConfig) -> str:
    differ = "abs(engine_amount) <> abs(provider_amount)"
    if rules.compare_money:
        return differ
    return f"engine_status = '{SETTLED}' and {_accepted(rules)} and {differ}"


def _matched(rules: CauseRules, config: MatchConfig) -> str:
    if rules.compare_money:
        return "engine_usd = provider_usd"
    return f"engine_status = '{SETTLED}' and {_accepted(rules)}"


_CONDITIONS: dict[str, Callable[[CauseRules, MatchConfig], str]] = {
    "missing_at_provider": lambda rules, config: "not has_provider",
    "missing_in_engine": lambda rules, config: "not has_engine",
    "duplicate_row_in_export": lambda rules, config: SURPLUS_COPY,
    "provider_date_format": lambda rules, config: f"provider_date_swapped and {_FLAGS_DIFFER}",
    "period_cutoff": lambda rules, config: _FLAGS_DIFFER,
    "matched_declined": lambda rules, config: (
        f"engine_status = '{DECLINED}' and provider_status = '{rules.refused}'"
    ),
    "status_mismatch": _status_mismatch,
    "amount_mismatch": _amount_mismatch,
    # rate 1 is right for a row in the base currency
    "engine_fx_rate_error": lambda rules, config: f"engine_fx_rate = 1 and currency <> '{config.base_currency}'",
    "matched": _matched,
    "engine_fx_date_error": lambda rules, config: times.stale("engine_fx_date", "engine_at", config.stale_days),
}
