"""Tables built from the pairs. Each reads the pairs once and keeps only small frames after that."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.functions.money import MONEY, TOTAL, percent_of, total
from ledgermatch.operators import rules as R

TOTAL_LABEL = "total"

ALL_PAIRS_COLUMNS = (
    "psp", "txn_id", "order_id", "operation_type", "engine_status", "engine_at",
    "provider_ref", "provider_type", "provider_status", "provider_at", "currency",
    "engine_amount", "provider_amount", "engine_in_period", "provider_in_period",
    "engine_usd", "provider_usd", "cause", "diff_usd",
)

#: time and product in place of the provider id, for exports that have no id; null when a part is
STAND_IN_REF = "substring(cast(provider_at as string), 1, 19) || ' ' || product_id"


def all_pairs(pairs: Iterable[DataFrame]) -> DataFrame:
    """The pair tables of all providers in one, with the bucket of each cause."""
    aligned = []
    for one in pairs:
        ref = STAND_IN_REF if "product_id" in one.columns else "provider_ref"
        columns = [f"{ref} as provider_ref" if c == "provider_ref" else c for c in ALL_PAIRS_COLUMNS]
        aligned.append(one.selectExpr(*columns, f"{R.cause_bucket()} as cause_bucket"))
    return reduce(DataFrame.unionByName, aligned)


def _sums(*columns: str) -> list:
    return [F.expr(f"{total(c)} as {c}") for c in columns]


def with_total(per_psp: DataFrame) -> DataFrame:
    """Adds the total row; works on the frame of one row per provider, not on the pairs."""
    sums = [F.expr(f"cast(sum({name}) as {kind}) as {name}") for name, kind in per_psp.dtypes if name != "psp"]
    rolled = per_psp.rollup("psp").agg(F.expr("grouping(psp) as is_total"), *sums)
    return rolled.selectExpr("* except (psp)", f"if(is_total = 1, '{TOTAL_LABEL}', psp) as psp")


def by_cause_money(pairs: DataFrame, *keys: str) -> DataFrame:
    """Rows and money on both sides for each cause."""
    counted = pairs.groupBy(*keys).agg(
        F.expr("count(*) as row_count"), *_sums("engine_usd", "provider_usd", "diff_usd")
    )
    return counted.orderBy(*keys)


def by_cause(pairs: DataFrame) -> DataFrame:
    """Provider x cause with absolute and signed difference and shares."""
    grouped = pairs.groupBy("psp", "cause_bucket", "cause").agg(
        F.expr("count(*) as row_count"),
        F.expr(f"{total('abs(diff_usd)')} as abs_usd"),
        F.expr(f"{total('diff_usd')} as signed_usd"),
    )
    # a row per provider and cause is left here, so a window over all of them stays small
    shares = grouped.selectExpr(
        "*",
        f"{percent_of('abs_usd', 'sum(abs_usd) over ()')} as share_pct",
        f"{percent_of('abs_usd', 'sum(abs_usd) over (partition by psp)')} as share_in_psp_pct",
    )
    return shares.orderBy("psp", F.desc("abs_usd"), "cause")


def by_psp(pairs: DataFrame) -> DataFrame:
    """One row per provider and a total row, without causes."""
    per_psp = pairs.groupBy("psp").agg(
        F.expr("count(*) as row_count"),
        F.expr("count_if(diff_usd <> 0) as discrepancy_rows"),
        F.expr(f"{total('abs(diff_usd)')} as abs_usd"),
        F.expr(f"{total('diff_usd')} as signed_usd"),
    )
    whole = "max(if(is_total = 1, abs_usd, null)) over ()"
    rows = with_total(per_psp).selectExpr("*", f"{percent_of('abs_usd', whole)} as share_pct")
    return rows.orderBy("is_total", F.desc("abs_usd")).select(
        "psp", "row_count", "discrepancy_rows", "abs_usd", "signed_usd", "share_pct"
    )


def totals(pairs: DataFrame) -> DataFrame:
    """Money on both sides, the difference by bucket, and the residual, which must be zero."""
    by_bucket = [
        F.expr(f"cast(ifnull(sum(if(cause_bucket = '{b}', diff_usd, null)), 0) as {TOTAL}) as {b}_usd")
        for b in ("matched", "explained", "unexplained")
    ]
    per_psp = pairs.groupBy("psp").agg(
        F.expr("count(*) as pair_count"),
        F.expr("count(txn_id) as engine_rows"),
        F.expr("count(provider_ref) as provider_rows"),
        F.expr(f"count_if({R.UNPRICED}) as unpriced_rows"),
        *_sums("engine_usd", "provider_usd"),
        F.expr(f"{total('diff_usd')} as total_diff"),
        *by_bucket,
    )
    # from the two sides, not from the differences, so that money without a counterpart shows
    sides = "ifnull(provider_usd, 0) - ifnull(engine_usd, 0)"
    residual = f"cast({sides} - (matched_usd + explained_usd + unexplained_usd) as {TOTAL}) as residual"
    return with_total(per_psp).orderBy("is_total", "psp").selectExpr(*per_psp.columns, residual)


def restate(pairs: DataFrame, winners: Mapping[str, str] = R.WINNERS) -> DataFrame:
    """Each pair with the figure that stands; a cause without a rule takes the provider's.

    The rule table has a row per entry of ``winners``, so it is broadcast.
    """
    table = R.winner_table(pairs.sparkSession, winners)
    ruled = pairs.join(F.broadcast(table), "cause", "left").selectExpr(
        "* except (corrected_from)", f"ifnull(corrected_from, '{R.PROVIDER}') as corrected_from"
    )
    corrected = f"if(corrected_from = '{R.ENGINE}', engine_usd, provider_usd)"
    return ruled.selectExpr(
        "psp", "txn_id", "order_id", "operation_type", "provider_ref", "currency", "cause", "corrected_from",
        "engine_usd", "provider_usd", f"{corrected} as corrected_usd",
        f"cast({corrected} - engine_usd as {MONEY}) as correction_usd",
    )


def restated_revenue(restated: DataFrame) -> DataFrame:
    """Revenue per provider as booked, as restated and as reported, with a total row."""
    per_psp = restated.groupBy("psp").agg(
        *_sums("engine_usd", "corrected_usd", "correction_usd", "provider_usd"),
        F.expr("count_if(correction_usd <> 0) as corrected_rows"),
    )
    gap = f"cast(corrected_usd - provider_usd as {TOTAL}) as corrected_minus_provider"
    return with_total(per_psp).orderBy("is_total", "psp").selectExpr(
        "psp", "engine_usd", "corrected_usd", "correction_usd", "provider_usd", gap, "corrected_rows"
    )
