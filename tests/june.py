"""A small month of raw files with one of each difference, and what they must come to."""

from __future__ import annotations

import csv
from datetime import date, datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal
from pathlib import Path
from zoneinfo import ZoneInfo

from ledgermatch.sources.layouts import LAYOUTS

D = Decimal
CENT = D("0.01")


def cents(x) -> Decimal:
    return D(x).quantize(CENT, ROUND_HALF_UP)


def business_days():
    day = date(2026, 5, 25)
    while day <= date(2026, 7, 3):
        if day.weekday() < 5:
            yield day
        day += timedelta(days=1)


RATES = {}
for n, day in enumerate(business_days()):
    RATES["EUR", day] = D("1.080000") + n * D("0.001")
    RATES["GBP", day] = D("1.260000") + n * D("0.002")
    RATES["BRL", day] = D("0.184000") if day == date(2026, 6, 10) else D("0.180000") + n * D("0.0001")
    RATES["CLP", day] = D("0.001050")


def asof(currency, day):
    if currency == "USD":
        return D("1.000000"), day
    while (currency, day) not in RATES:
        day -= timedelta(days=1)
    return RATES[currency, day], day


def at(text) -> datetime:
    return datetime.fromisoformat(text)


class June:
    def __init__(self):
        self.engine, self.adyen, self.dlocal, self.us, self.eu, self.google, self.tail = [], [], [], [], [], [], []
        #: (psp, engine id or None, provider id or None, cause) -> difference in USD
        self.expected = {}
        self.n = 0
        self._paypal_us()
        self._paypal_eu()
        self._dlocal()
        self._adyen()
        self._google()

    # rows ------------------------------------------------------------------------------------

    def txn(self, psp, ref, currency, local, when, status="settled", op="SALE", rate=None, order=None):
        self.n += 1
        txn = f"TXN-{self.n:03d}"
        rate, day = rate or asof(currency, at(when).date())
        captured = when if status == "settled" else ""
        created = str(at(when) - timedelta(minutes=3)) if captured else when
        usd = cents(D(local) * rate)
        order = order or f"ORD-{self.n:03d}"
        self.engine.append([txn, order, op, status, psp, ref or "", "sub_monthly", "US", currency, local, rate, day, usd, created, captured])
        return txn, usd, order

    def activity(self, rows, ref, status, currency, gross, when, kind="Website Payment", fmt="%m/%d/%Y", original="", order="ORD"):
        text = (lambda x: str(x).replace(".", ",")) if rows is self.eu else str
        fee = -cents(abs(D(gross)) * D("0.03"))
        moment = at(when)
        rows.append([
            moment.strftime(fmt), moment.strftime("%H:%M:%S"), "GMT", "Zoë", ref, original, kind, status, currency,
            text(gross), text(fee), text(cents(gross) + fee), order,
        ])

    def expect(self, psp, txn, ref, cause, diff):
        self.expected[psp, txn, ref, cause] = cents(diff)

    def _paypal_us(self):
        us = lambda *a, **k: self.activity(self.us, *a, **k)
        t, _, _ = self.txn("paypal_us", "U1", "USD", "9.99", "2026-06-02 10:00:00")
        us("U1", "Completed", "USD", "9.99", "2026-06-02 10:00:00")
        self.expect("paypal_us", t, "U1", "matched", 0)
        t, _, _ = self.txn("paypal_us", "U2", "USD", "5.00", "2026-06-02 11:00:00", "declined")
        us("U2", "Denied", "USD", "5.00", "2026-06-02 11:00:00")
        self.expect("paypal_us", t, "U2", "matched_declined", 0)
        t, _, _ = self.txn("paypal_us", "U3", "USD", "24.99", "2026-06-03 11:00:00", "pending")
        us("U3", "Completed", "USD", "24.99", "2026-06-03 11:00:00")
        self.expect("paypal_us", t, "U3", "status_mismatch", "24.99")
        t, _, _ = self.txn("paypal_us", "U4", "USD", "9.99", "2026-06-04 11:00:00")
        for cause, diff in (("matched", 0), ("duplicate_row_in_export", "9.99")):
            us("U4", "Completed", "USD", "9.99", "2026-06-04 11:00:00")
            self.expect("paypal_us", t, "U4", cause, diff)
        t, _, _ = self.txn("paypal_us", "U5", "USD", "20.00", "2026-06-05 11:00:00")
        us("U5", "Completed", "USD", "19.00", "2026-06-05 11:00:00")
        self.expect("paypal_us", t, "U5", "amount_mismatch", "-1.00")
        t, _, _ = self.txn("paypal_us", "U6", "USD", "5.00", "2026-06-06 11:00:00")
        self.expect("paypal_us", t, None, "missing_at_provider", "-5.00")
        us("U7", "Refunded", "USD", "-9.99", "2026-06-07 11:00:00", "Refund", original="U1")
        self.expect("paypal_us", None, "U7", "missing_in_engine", "-9.99")
        t, _, _ = self.txn("paypal_us", "U8", "USD", "7.00", "2026-06-30 23:59:59")
        us("U8", "Completed", "USD", "7.00", "2026-07-01 00:00:00")
        self.expect("paypal_us", t, "U8", "period_cutoff", "-7.00")
        self.txn("paypal_us", "U9", "USD", "8.00", "2026-07-02 12:00:00")
        us("U9", "Completed", "USD", "8.00", "2026-07-02 12:00:00")

    def _paypal_eu(self):
        eu = lambda *a, **k: self.activity(self.eu, *a, fmt=k.pop("fmt", "%d/%m/%Y"), **k)
        when = "2026-06-14 09:30:00"  # a Sunday, so the rate of Friday
        t, _, _ = self.txn("paypal_eu", "E1", "EUR", "59.99", when)
        eu("E1", "Completed", "EUR", "59.99", when)
        self.expect("paypal_eu", t, "E1", "matched", 0)
        when = "2026-06-03 08:15:00"
        t, usd, _ = self.txn("paypal_eu", "E2", "EUR", "10.91", when)
        eu("E2", "Completed", "EUR", "10.91", when, fmt="%m/%d/%Y")  # printed month first
        self.expect("paypal_eu", t, "E2", "provider_date_format", -usd)
        for ref, back, cause in (("E3", 10, "engine_fx_date_error"), ("E4", 1, "fx_date_lag")):
            when = "2026-06-18 12:00:00"
            t, usd, _ = self.txn("paypal_eu", ref, "GBP", "100.00", when, rate=asof("GBP", at(when).date() - timedelta(days=back)))
            eu(ref, "Completed", "GBP", "100.00", when)
            self.expect("paypal_eu", t, ref, cause, cents(100 * asof("GBP", at(when).date())[0]) - usd)
        eu("E5", "Reversed", "EUR", "-59.99", "2026-06-20 10:00:00", kind="Payment Reversal", original="E1")
        self.expect("paypal_eu", None, "E5", "missing_in_engine", cents(D("-59.99") * asof("EUR", date(2026, 6, 20))[0]))

    def _dlocal(self):
        def line(ref, currency, local, when, usd, rate, status="PAID", kind="PAYMENT"):
            exponent = 0 if currency == "CLP" else 2
            minor = int(D(local) * 10**exponent)
            self.dlocal.append([ref, "ORD", kind, status, when, "BR", currency, exponent, minor, rate, usd, cents(D(usd) * D("0.045"))])

        def own(currency, local, when):
            rate, _ = asof(currency, at(when).date())
            return cents(D(local) * rate), (1 / rate).quantize(D("0.000001"))

        when = "2026-06-10 15:00:00"  # the day with two published rates
        t, usd, _ = self.txn("dlocal", "DL-1", "BRL", "52.00", when)
        for cause, diff in (("matched", 0), ("duplicate_row_in_export", usd)):
            line("DL-1", "BRL", "52.00", when, *own("BRL", "52.00", when))
            self.expect("dlocal", t, "DL-1", cause, diff)
        t, usd, _ = self.txn("dlocal", "DL-2", "CLP", "9990", when, rate=(D("1.000000"), at(when).date()))
        line("DL-2", "CLP", "9990", when, *own("CLP", "9990", when))
        self.expect("dlocal", t, "DL-2", "engine_fx_rate_error", own("CLP", "9990", when)[0] - usd)
        t, usd, _ = self.txn("dlocal", "DL-3", "BRL", "30.00", when)
        line("DL-3", "BRL", "30.00", when, usd + CENT, D("5.425000"))
        self.expect("dlocal", t, "DL-3", "provider_fx_rate", CENT)
        t, usd, _ = self.txn("dlocal", "DL-4", "BRL", "40.00", when)
        line("DL-4", "BRL", "40.00", when, *own("BRL", "40.00", when), status="IN_MEDIATION")
        self.expect("dlocal", t, "DL-4", "status_mismatch", -usd)
        t, _, _ = self.txn("dlocal", "DL-5", "BRL", "12.00", when, "declined")
        line("DL-5", "BRL", "12.00", when, *own("BRL", "12.00", when), status="REJECTED")
        self.expect("dlocal", t, "DL-5", "matched_declined", 0)
        _, _, order = self.txn("dlocal", "DL-6", "BRL", "20.00", when)
        line("DL-6", "BRL", "20.00", when, *own("BRL", "20.00", when))
        self.expect("dlocal", f"TXN-{self.n:03d}", "DL-6", "matched", 0)
        t, _, _ = self.txn("dlocal", "DL-7", "BRL", "20.00", when, op="REFUND", order=order)
        line("DL-7", "BRL", "20.00", when, *own("BRL", "20.00", when), status="REFUNDED", kind="REFUND")
        self.expect("dlocal", t, "DL-7", "matched", 0)

    def _adyen(self):
        def event(ref, order, kind, currency, amount, when, fee=None):
            local = at(when).replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo("Europe/Amsterdam")).strftime("%Y-%m-%d %H:%M:%S")
            account = "account_us" if currency == "USD" else "account_eu"
            debit, credit = (amount, "") if kind in ("Refunded", "Chargeback") else ("", amount)
            settled = kind == "Settled"
            markup = cents(D(amount) * D("0.005")) if settled else ""
            commission = (fee if fee is not None else cents(D(amount) * D("0.02"))) if settled else ""
            net = D(amount) - D(markup) - D(commission) if settled else ""
            self.adyen.append([
                "group", account, ref, order, kind, local, "Europe/Amsterdam", currency, debit, credit, commission,
                markup, currency, debit, net, 25,
            ])

        def paid(ref, currency, amount, when, fee=None, late=None):
            t, usd, order = self.txn("adyen", ref, currency, amount, when)
            event(ref, order, "Authorised", currency, amount, when)
            event(ref, order, "Settled", currency, amount, late or when, fee)
            return t, usd, order

        t, _, order = paid("A1", "EUR", "20.00", "2026-06-08 12:00:00")
        self.expect("adyen", t, "A1", "matched", 0)
        t, _, _ = self.txn("adyen", "A1R", "EUR", "20.00", "2026-06-09 12:00:00", op="REFUND", order=order)
        event("A1", order, "Refunded", "EUR", "20.00", "2026-06-09 12:00:00")
        self.expect("adyen", t, "A1", "matched", 0)
        t, _, order = paid("A2", "USD", "30.00", "2026-06-08 12:30:00", fee=D("1.60"))  # a dollar over contract
        self.expect("adyen", t, "A2", "matched", 0)
        event("A2", order, "Chargeback", "USD", "30.00", "2026-06-11 12:30:00")
        self.expect("adyen", None, "A2", "missing_in_engine", "-30.00")
        t, _, order = self.txn("adyen", "A3", "USD", "11.00", "2026-06-08 13:00:00", "declined")
        event("A3", order, "Refused", "USD", "11.00", "2026-06-08 13:00:00")
        self.expect("adyen", t, "A3", "matched_declined", 0)
        t, usd, order = self.txn("adyen", "A4", "USD", "10.90", "2026-06-08 14:00:00")
        event("A4", order, "Refused", "USD", "10.90", "2026-06-08 14:00:00")
        self.expect("adyen", t, "A4", "status_mismatch", -usd)
        # 23:30 UTC on the last day is 01:30 of the next month in Amsterdam; still inside the period
        t, _, _ = paid("A5", "USD", "12.00", "2026-06-30 23:30:00")
        self.expect("adyen", t, "A5", "matched", 0)
        t, usd, _ = paid("A6", "EUR", "10.00", "2026-06-29 10:00:00", late="2026-07-03 10:00:00")
        self.expect("adyen", t, "A6", "period_cutoff", -usd)

    def _google(self):
        def line(rows, kind, currency, amount, when, usd, rate):
            local = at(when).replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo("America/Los_Angeles"))
            rows.append([
                f"{local:%b} {local.day}, {local.year}", local.strftime("%H:%M:%S"), kind, "sub_monthly", "US",
                currency, amount, rate, "USD", usd,
            ])

        def sale(currency, amount, when, rate=None, share="0.15"):
            t, usd, order = self.txn("google_play", None, currency, amount, when)
            rate = rate or asof(currency, at(when).date())[0]
            own = cents(D(amount) * rate)
            line(self.google, "Charge", currency, amount, when, own, rate)
            line(self.google, "Google fee", currency, -cents(D(amount) * D(share)), when, -cents(own * D(share)), rate)
            return t, usd, own, order

        def ref(when):
            return f"{when} sub_monthly"

        # before seven o'clock UTC on the first day it is still May in Los Angeles
        when = "2026-06-01 03:00:00"
        t, _, _, order = sale("EUR", "24.99", when)
        self.expect("google_play", t, ref(when), "matched", 0)
        when = "2026-06-15 20:00:00"
        t, usd, own, _ = sale("EUR", "24.99", when, rate=D("1.000000"), share="0.30")
        self.expect("google_play", t, ref(when), "provider_fx_rate", own - usd)
        when = "2026-06-28 20:00:00"
        t, usd, _ = self.txn("google_play", None, "EUR", "24.99", when, op="REFUND", order=order)
        line(self.google, "Charge refund", "EUR", "-24.99", when, -usd, asof("EUR", at(when).date())[0])
        self.expect("google_play", t, ref(when), "matched", 0)
        # the tail of the next month: one row still inside the period, one outside
        when = "2026-06-30 23:00:00"
        t, usd, _ = self.txn("google_play", None, "USD", "9.99", when)
        line(self.tail, "Charge", "USD", "9.99", when, "9.99", "1.000000")
        line(self.tail, "Google fee", "USD", "-1.50", when, "-1.50", "1.000000")
        self.expect("google_play", t, ref(when), "matched", 0)
        when = "2026-07-02 23:00:00"
        self.txn("google_play", None, "USD", "9.99", when)
        line(self.tail, "Charge", "USD", "9.99", when, "9.99", "1.000000")
        line(self.tail, "Google fee", "USD", "-1.50", when, "-1.50", "1.000000")

    # files -----------------------------------------------------------------------------------

    def write(self, folder: Path) -> dict:
        rates = [[day, c, x, f"{day}T16:00Z"] for (c, day), x in RATES.items()]
        rates.append(["2026-06-10", "BRL", "0.190000", "2026-06-12T09:00Z"])
        fees = [["adyen", "account_eu", "2026-01-01", "2.5", "0.00", ""], ["adyen", "account_us", "2026-01-01", "2.5", "0.00", ""],
                ["google_play", "account_main", "2026-01-01", "15", "0.00", ""]]
        files = {
            "engine_log": self.engine,
            "adyen_accounting": self.adyen,
            "dlocal_transactions": self.dlocal,
            "paypal_us_activity": self.us,
            "paypal_eu_activity": self.eu,
            "fx_rates": rates,
            "fee_schedule": fees,
        }
        paths = {name: _write(folder / f"{name}.csv", name, rows) for name, rows in files.items()}
        paths["google_play_earnings"] = {
            tag: _write(folder / f"{tag}.csv", "google_play_earnings", rows)
            for tag, rows in (("earnings_06", self.google), ("earnings_07", self.tail))
        }
        return paths


def _write(path: Path, layout: str, rows) -> str:
    kind = LAYOUTS[layout]
    with open(path, "w", newline="", encoding=kind.encoding) as f:
        if kind.banner:
            f.write("Earnings report (all times America/Los_Angeles)\n")
        out = csv.writer(f, delimiter=kind.sep, lineterminator="\r\n" if kind.banner else "\n")
        out.writerow(kind.columns)
        out.writerows(rows)
    return str(path)
