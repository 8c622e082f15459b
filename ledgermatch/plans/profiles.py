"""The five ways an engine ledger is matched with a provider export.

========  ==========================================  =============================
profile   pair key                                    provider money
========  ==========================================  =============================
id_base   provider id                                 as reported, base currency
id_fx     provider id                                 valued at the reference rate
id_own    provider id                                 provider's own conversion
journal   id for sales, order + type for reversals    valued at the reference rate
keyless   time + product + type                       provider's own conversion
========  ==========================================  =============================

Engine rows: ENGINE_COLUMNS. Provider rows: PROVIDER_COLUMNS, with null where an export has no such
column; amounts carry their sign, fees are positive costs.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import ClassVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.config import MatchConfig
from ledgermatch.functions import money, times
from ledgermatch.operators import rules as R
from ledgermatch.operators import skew
from ledgermatch.operators.asof import RateBook, attach_rate
from ledgermatch.operators.dedup import dup_rank
from ledgermatch.operators.pairing import both_keys, pair_ledgers, spread_keys, with_spread

SALE, REFUND, CHARGEBACK = "SALE", "REFUND", "CHARGEBACK"

ENGINE_COLUMNS = {
    "psp": "string",
    "txn_id": "string",
    "order_id": "string",
    "operation_type": "string",
    "status": "string",
    "psp_reference": "string",
    "sku": "string",
    "currency": "string",
    "amount_local": money.MONEY,
    "fx_rate_applied": money.RATE,
    "fx_date_applied": "date",
    "amount_usd": money.MONEY,
    "signed_amount_usd": money.MONEY,
    "created_at_utc": "timestamp_ntz",
    "captured_at_utc": "timestamp_ntz",
}
PROVIDER_COLUMNS = {
    "provider_ref": "string",
    "provider_order": "string",
    "provider_type": "string",
    "provider_status": "string",
    "provider_at": "timestamp_ntz",
    "provider_currency": "string",
    "provider_amount": money.MONEY,
    "own_usd": money.MONEY,
    "own_rate": money.RATE,
    "provider_fee": money.MONEY,
    "provider_fee_usd": money.MONEY,
    "product_id": "string",
    "account": "string",
    "source_file": "string",
    "buyer_country": "string",
}

#: columns every profile returns, in order; ``extras`` of the profile follow engine/provider flags
PAIR_COLUMNS = (
    "psp", "txn_id", "order_id", "operation_type", "engine_status", "engine_at",
    "provider_ref", "provider_order", "provider_type", "provider_status", "provider_at", "dup_rank",
    "currency", "engine_amount", "provider_amount", "engine_fx_rate", "engine_fx_date",
    "provider_fx_rate", "provider_fx_date", "engine_in_period", "provider_in_period",
)


@dataclass(frozen=True)
class Profile:
    psp: str
    rules: R.CauseRules
    #: provider statuses that move money; None: every status but ``no_money``
    money: tuple[str, ...] | None = None
    no_money: str | None = None
    #: "own": money as the provider converted it; "reference": amount x reference rate
    valuation: str = "own"
    #: attach the reference valuation for information as well
    reference_info: bool = False
    #: provider types of a journal and the engine operation each one pairs with
    journal: Mapping[str, str] = field(default_factory=dict)
    #: provider type of a sale, of a refund and of a fee line in an export without ids
    keyless: tuple[str, str, str] | None = None
    #: journal events that carry no money of their own and take no part
    ignored_types: tuple[str, ...] = ()
    #: compare engine amounts in base currency and not in the local one
    engine_in_base: bool = False
    extras: tuple[str, ...] = ()

    #: copies of a journal event share these
    copy_keys: ClassVar[list[str]] = ["provider_ref", "provider_type"]

    @property
    def keys(self) -> list[str]:
        return ["key_at", "key_product", "key_type"] if self.keyless else ["pair_key"]

    @property
    def held_by_key(self) -> dict[str, str]:
        """Columns that the pair key already holds; they do not travel a second time."""
        if self.keyless:
            return {"engine_at": "key_at", "provider_at": "key_at", "provider_type": "key_type"}
        return {} if self.journal else {"provider_ref": "pair_key"}


_SAME_HEAD = ("missing_at_provider", "missing_in_engine", "duplicate_row_in_export")


def id_base(psp: str) -> Profile:
    order = (*_SAME_HEAD, "period_cutoff", "matched_declined", "amount_mismatch", "matched")
    rules = R.CauseRules(order, "status_mismatch", ("Completed", "Refunded"), "Denied", compare_money=False)
    return Profile(psp, rules, no_money="Denied", engine_in_base=True)


def id_fx(psp: str) -> Profile:
    order = (
        *_SAME_HEAD, "provider_date_format", "period_cutoff", "matched_declined", "status_mismatch",
        "amount_mismatch", "matched", "engine_fx_date_error",
    )
    rules = R.CauseRules(order, "fx_date_lag", ("Completed", "Refunded", "Reversed"), "Denied")
    return Profile(psp, rules, no_money="Denied", valuation="reference", extras=("provider_date_swapped",))


def id_own(
    psp: str, paid: tuple[str, ...] = ("PAID", "REFUNDED"), refused: str = "REJECTED"
) -> Profile:
    order = (
        *_SAME_HEAD, "period_cutoff", "matched_declined", "status_mismatch", "amount_mismatch",
        "engine_fx_rate_error", "matched",
    )
    rules = R.CauseRules(order, "provider_fx_rate", paid, refused)
    extras = ("reference_fx_rate", "reference_fx_date", "reference_usd", "provider_fee_usd")
    return Profile(psp, rules, money=paid, reference_info=True, extras=extras)


def journal(psp: str) -> Profile:
    order = (
        *_SAME_HEAD, "period_cutoff", "matched_declined", "status_mismatch", "amount_mismatch", "matched",
        "engine_fx_date_error",
    )
    rules = R.CauseRules(order, "fx_date_lag", ("Settled", "Refunded", "Chargeback"), "Refused")
    events = {"Settled": SALE, "Refused": SALE, "Refunded": REFUND, "Chargeback": CHARGEBACK}
    return Profile(
        psp, rules, no_money="Refused", valuation="reference", journal=events, ignored_types=("Authorised",),
        extras=("account", "provider_fee", "provider_fee_usd"),
    )


def keyless(psp: str, types: tuple[str, str, str] = ("Charge", "Charge refund", "Google fee")) -> Profile:
    order = (*_SAME_HEAD, "period_cutoff", "status_mismatch", "amount_mismatch", "matched")
    rules = R.CauseRules(order, "provider_fx_rate")
    extras = ("product_id", "source_file", "buyer_country", "provider_fee_usd")
    return Profile(psp, rules, keyless=types, extras=extras)


@dataclass(frozen=True)
class Heavy:
    """Heavy keys of one ledger pair, see ``skew.hot_keys``."""

    pair: skew.Hot = ()
    copies: skew.Hot = ()


Ledgers = Mapping[str, tuple[DataFrame, DataFrame, Profile]]


def heavy_keys(ledgers: Ledgers, config: MatchConfig) -> dict[str, Heavy]:
    """Look for the heavy keys of several ledger pairs in one job; only key columns are read."""
    stacked = {}
    for name, (engine, provider, profile) in ledgers.items():
        e_side, p_side = _keyed(engine, provider, profile)
        stacked[f"{name} pair"] = both_keys(e_side, p_side, profile.keys)
        if profile.journal:
            stacked[f"{name} copies"] = (p_side, profile.copy_keys)
    found = skew.hot_keys(stacked, config.hot_rows)
    return {name: Heavy(found[f"{name} pair"], found.get(f"{name} copies", ())) for name in ledgers}


def match(
    engine: DataFrame,
    provider: DataFrame,
    profile: Profile,
    config: MatchConfig,
    book: RateBook | None = None,
    heavy: Heavy | None = None,
) -> DataFrame:
    """One row per pair with at least one side in the period, its money on both sides and its cause."""
    if heavy is None:
        heavy = heavy_keys({"one": (engine, provider, profile)}, config)["one"]
    return paired(*prepared(engine, provider, profile, config, book, heavy), profile, config, heavy)


def prepared(
    engine: DataFrame, provider: DataFrame, profile: Profile, config: MatchConfig, book: RateBook | None, heavy: Heavy
) -> tuple[DataFrame, DataFrame]:
    """Both sides cut to the profile, keyed, ranked and valued: what ``paired`` takes, and what can be kept between runs."""
    e_side, p_side = _keyed(engine, provider, profile)
    if profile.journal:
        p_side = dup_rank(p_side, profile.copy_keys, ["provider_at"], hot=heavy.copies)
    if profile.keyless:
        p_side = _with_fee_lines(p_side, profile)
    return (
        with_spread(e_side.drop(*profile.held_by_key), profile.keys),
        with_spread(valued(p_side, profile, config, book).drop(*profile.held_by_key), profile.keys),
    )


def paired(e_side: DataFrame, p_side: DataFrame, profile: Profile, config: MatchConfig, heavy: Heavy) -> DataFrame:
    """The pairs of two prepared sides. Sides that were written in buckets by their pair key meet without a shuffle."""
    # true repeats stand in the same order on both sides, so the n-th meets its like
    rank, order, engine_order = "dup_rank", [], ["txn_id"]
    if profile.keyless:
        order, engine_order = ["abs(provider_amount)"], ["abs(engine_amount)", "txn_id"]
    if profile.journal:
        rank, order = "_place", ["dup_rank", "provider_at", "abs(provider_amount)"]
        engine_order = ["engine_at", "abs(engine_amount)", "txn_id"]
    pairs = pair_ledgers(
        e_side, p_side, profile.keys, engine_order=engine_order, provider_order=order, rank=rank, hot=heavy.pair
    )
    restored = [
        f"if({'has_engine' if column == 'engine_at' else 'has_provider'}, {key}, null) as {column}"
        for column, key in profile.held_by_key.items()
    ]
    return _priced(pairs.selectExpr("*", *restored), profile, config)


def match_all(ledgers: Ledgers, config: MatchConfig, book: RateBook | None) -> dict[str, DataFrame]:
    """Match several providers; the heavy keys of all of them are looked for in one job."""
    heavy = heavy_keys(ledgers, config)
    return {name: match(*sides, config, book, heavy[name]) for name, sides in ledgers.items()}


def _keyed(engine: DataFrame, provider: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """Both ledgers cut to the profile's rows, with their pair keys."""
    if profile.keyless:
        sale, refund, fee = profile.keyless
        e_keys = {"key_at": _ENGINE_AT, "key_product": "sku", "key_type": f"if({_IS_SALE}, '{sale}', '{refund}')"}
        # a fee line belongs to the sale of the same time and product, so it takes the sale's key:
        # the fee join, the rank and the pairing then all use one layout of the rows
        p_keys = {
            "key_at": "provider_at",
            "key_product": "product_id",
            "key_type": f"if(provider_type = '{fee}', '{sale}', provider_type)",
        }
    elif profile.journal:
        e_keys = {"pair_key": f"if({_IS_SALE}, psp_reference, order_id || ':' || operation_type)"}
        events = " ".join(
            f"when '{event}' then " + ("provider_ref" if operation == SALE else f"provider_order || ':{operation}'")
            for event, operation in profile.journal.items()
        )
        p_keys = {"pair_key": f"case provider_type {events} end"}
    else:
        e_keys, p_keys = {"pair_key": "psp_reference"}, {"pair_key": "provider_ref"}

    if profile.ignored_types:
        provider = provider.filter(f"provider_type not in ({R.text_list(profile.ignored_types)})")
    amount = "amount_usd" if profile.engine_in_base else "amount_local"
    engine = engine.filter(f"psp = '{profile.psp}'").selectExpr(
        "txn_id", "order_id", "operation_type", "status as engine_status", f"{_ENGINE_AT} as engine_at",
        "currency as engine_currency", f"{amount} as engine_amount", "fx_rate_applied as engine_fx_rate",
        "fx_date_applied as engine_fx_date", "signed_amount_usd", *_named(e_keys),
    )
    provider = provider.selectExpr("*", *_named(p_keys))
    return with_spread(engine, profile.keys, ["txn_id"]), with_spread(provider, profile.keys, ["provider_amount"])


_ENGINE_AT = times.event_time("captured_at_utc", "created_at_utc")
_IS_SALE = f"operation_type = '{SALE}'"


def _named(columns: Mapping[str, str]) -> list[str]:
    return [f"{sql} as {name}" for name, sql in columns.items()]


def _with_fee_lines(provider: DataFrame, profile: Profile) -> DataFrame:
    """Sales and refunds, the fee lines of a sale summed beside it."""
    sale, refund, fee = profile.keyless
    on = spread_keys(profile.keys)
    fees = (
        provider.filter(f"provider_type = '{fee}'")
        .groupBy(*on)
        .agg(F.expr(f"cast(-sum(own_usd) as {money.MONEY}) as fee_line"))
    )
    sales = provider.filter(f"provider_type in ('{sale}', '{refund}')")
    return sales.drop("provider_fee_usd").join(fees, on, "left").withColumnRenamed(
        "fee_line", "provider_fee_usd"
    )


def valued(provider: DataFrame, profile: Profile, config: MatchConfig, book: RateBook | None) -> DataFrame:
    """Adds ``full_usd``, the row's money in base currency, and the rate behind it."""
    on = "to_date(provider_at)"
    if profile.valuation == "reference":
        rows = attach_rate(
            provider, book, "provider_currency", on, base=config.base_currency,
            rate_name="provider_fx_rate", date_name="provider_fx_date",
        )
        rows = rows.selectExpr("*", f"{money.valued('provider_amount', 'provider_fx_rate')} as full_usd")
        if profile.journal:
            fee = money.valued("provider_fee", "provider_fx_rate")
            rows = rows.drop("provider_fee_usd").selectExpr("*", f"{fee} as provider_fee_usd")
        return rows
    rows = provider.selectExpr(
        "*", "own_usd as full_usd", "own_rate as provider_fx_rate", "cast(null as date) as provider_fx_date"
    )
    if profile.reference_info:
        rows = attach_rate(
            rows, book, "provider_currency", on, rate_name="reference_fx_rate", date_name="reference_fx_date"
        )
        rows = rows.selectExpr("*", f"{money.valued('provider_amount', 'reference_fx_rate')} as reference_usd")
    return rows


def moves_money(profile: Profile) -> str:
    if profile.money is not None:
        return f"provider_status in ({R.text_list(profile.money)})"
    return "true" if profile.no_money is None else f"provider_status <> '{profile.no_money}'"


def _priced(pairs: DataFrame, profile: Profile, config: MatchConfig) -> DataFrame:
    engine_in, provider_in = config.period.holds("engine_at"), config.period.holds("provider_at")
    engine_money = f"not ifnull({R.SURPLUS_COPY}, false) and engine_status = '{R.SETTLED}' and {engine_in}"
    if profile.keyless:
        pairs = pairs.drop("product_id").withColumnRenamed("key_product", "product_id")
    priced = pairs.selectExpr(
        "*",
        f"'{profile.psp}' as psp",
        "coalesce(engine_currency, provider_currency) as currency",
        f"{engine_in} as engine_in_period",
        f"{provider_in} as provider_in_period",
        f"{times.day_month_swapped('provider_at', 'engine_at')} as provider_date_swapped",
        f"if({engine_money}, signed_amount_usd, {money.ZERO}) as engine_usd",
        f"if({moves_money(profile)} and {provider_in}, full_usd, {money.ZERO}) as provider_usd",
    )
    # after the pairing on purpose: a row outside the period can be the partner of a row inside it
    in_period = priced.filter("ifnull(engine_in_period, false) or ifnull(provider_in_period, false)")
    return R.classify(in_period, profile.rules, config).selectExpr(
        *PAIR_COLUMNS, *profile.extras, "engine_usd", "provider_usd", "cause",
        f"cast(provider_usd - engine_usd as {money.MONEY}) as diff_usd",
    )
