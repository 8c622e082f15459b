"""Amounts, signs, fees and rates."""

from __future__ import annotations

MONEY = "decimal(18,2)"
RATE = "decimal(18,6)"
PERCENT = "decimal(9,4)"
TOTAL = "decimal(38,2)"

ZERO = f"cast(0 as {MONEY})"


def cast(value: str, to: str) -> str:
    return f"cast({value} as {to})"


def signed(amount: str, positive: str) -> str:
    """Amount as it is where the condition holds, negated elsewhere."""
    return cast(f"if({positive}, {amount}, -({amount}))", MONEY)


def credit_less_debit(credit: str, debit: str) -> str:
    return cast(f"ifnull({credit}, 0) - ifnull({debit}, 0)", MONEY)


def fee_total(*parts: str) -> str:
    return cast(" + ".join(f"ifnull({part}, 0)" for part in parts), MONEY)


def from_minor_units(minor: str, exponent: str) -> str:
    return cast(f"({minor}) / pow(10, {exponent})", MONEY)


def invert_rate(rate: str) -> str:
    return cast(f"cast(1 as {RATE}) / ({rate})", RATE)


def decimal_comma(text: str) -> str:
    return f"translate({text}, ',', '.')"


def valued(amount: str, rate: str) -> str:
    """Amount in the base currency, rounded half up to the cent."""
    return cast(f"round(({amount}) * ({rate}), 2)", MONEY)


def total(amount: str) -> str:
    return cast(f"sum({amount})", TOTAL)


def percent_of(part: str, whole: str) -> str:
    """``100 * part / whole`` to two places; null when the whole is zero."""
    return f"round(100 * cast({part} as double) / nullif(cast({whole} as double), 0), 2)"
