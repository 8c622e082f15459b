"""Two-sided ledgers with planted differences, derived by Spark from the ``orders`` table.

Every order becomes a sale on both sides; arithmetic on the order key plants the defects, so their
number is known by formula and grows with the table.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cache, cached_property, reduce

from pyspark.sql import DataFrame, SparkSession

from ledgermatch.config import HOT_ROWS, MatchConfig, Period
from ledgermatch.functions import money
from ledgermatch.operators.asof import RateBook, attach_rate, rate_book
from ledgermatch.plans import profiles as P
from ledgermatch.sources.layouts import LAYOUTS

PERIOD = Period("1997-01-01", "1997-07-01")
EXPORT_WINDOW = Period("1995-01-01", "2001-08-01")
PROFILES = ("id_base", "id_fx", "id_own", "journal", "keyless")

_PRODUCT = "concat('p', k % 7)"


def _money(sql: str) -> str:
    return money.cast(sql, money.MONEY)


def _rate(sql: str) -> str:
    return money.cast(sql, money.RATE)


def _share(sql: str, share: str) -> str:
    return _money(f"round({sql} * {share}, 2)")


class Recipe:
    def __init__(self, spark: SparkSession, sf_dir: str, hot_rows: int = HOT_ROWS):
        self.spark = spark
        self.sf_dir = sf_dir
        self.orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
        self.config = MatchConfig(PERIOD, EXPORT_WINDOW, hot_rows=hot_rows)
        self._heavy: dict[str, P.Heavy] = {}

    @cached_property
    def rates(self) -> DataFrame:
        """Rates for the order days; about two days in seven have none."""
        return (
            self.orders.selectExpr("to_date(o_orderdate) as rate_date")
            .distinct()
            .selectExpr("rate_date", "year(rate_date) * 372 + month(rate_date) * 31 + day(rate_date) as n")
            .filter("n % 7 not in (0, 3)")
            .selectExpr("rate_date", "n", "explode(map('EUR', 1, 'GBP', 3, 'BRL', 7)) as (currency, mul)")
            .selectExpr("rate_date", "currency", f"{_rate('(1050000 + 100 * ((n * mul) % 97)) * 0.000001BD')} as usd_rate")
        )

    @cached_property
    def book(self) -> RateBook:
        return rate_book(self.rates, broadcast_rows=self.config.broadcast_rows)

    @cached_property
    def base(self) -> DataFrame:
        return self.orders.selectExpr(
            "o_orderkey as k",
            f"{_money('o_totalprice')} as amount",
            "case o_custkey % 3 when 0 then 'EUR' when 1 then 'GBP' else 'BRL' end as c3",
            "case o_custkey % 3 when 0 then 'EUR' when 1 then 'GBP' else 'USD' end as cu",
            "o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 86400) as event_at",
            "not (o_orderstatus = 'P' and o_orderkey % 4 = 0) as settled",
            "day(o_orderdate) <= 12 as early_day",
            "month(o_orderdate) = 6 as june",
        )

    @cache
    def profile(self, name: str) -> P.Profile:
        if name == "id_own":
            return P.id_own(name, paid=("Completed",), refused="Denied")
        return getattr(P, name)(name)

    # engine side -----------------------------------------------------------------------------

    @cache
    def engine(self, name: str, priced: bool = True) -> DataFrame:
        """Engine ledger of one profile; without prices only its keys are of use."""
        rows = self.base.filter("k % 227 <> 0")
        if name == "keyless":
            rows = rows.filter("settled")
        rows = self._engine_rate(rows, name) if priced else rows.selectExpr("*", *_NO_RATE, "'USD' as fx_currency")
        # no order key is negative: all are sales, but the type stays a column as in a real ledger
        rows = rows.selectExpr(
            "*", f"{money.valued('amount', 'fx_rate')} as usd", "'' as tag",
            f"if(k < 0, '{P.REFUND}', '{P.SALE}') as operation_type",
        )
        if name == "journal":
            late = rows.filter("settled and k % 29 = 7 and k % 5 <> 0").selectExpr(
                *[c for c in rows.columns if c not in ("event_at", "operation_type", "tag")],
                "event_at + interval 5 days as event_at",
                "'R' as tag",
                f"'{P.REFUND}' as operation_type",
            )
            rows = rows.unionByName(late)
        reference = "cast(null as string)" if name == "keyless" else "concat('P', tag, k)"
        return rows.selectExpr(
            f"'{name}' as psp",
            "concat('T', tag, k) as txn_id",
            "concat('O', k) as order_id",
            "operation_type",
            "if(settled, 'settled', 'declined') as status",
            f"{reference} as psp_reference",
            f"{_PRODUCT} as sku",
            "fx_currency as currency",
            "amount as amount_local",
            "fx_rate as fx_rate_applied",
            "fx_date as fx_date_applied",
            "usd as amount_usd",
            f"{money.signed('usd', P._IS_SALE)} as signed_amount_usd",
            # a declined attempt is never captured, it is dated by its creation
            "if(settled, event_at - make_dt_interval(0, 0, int(k % 30)), event_at) as created_at_utc",
            "if(settled, event_at, null) as captured_at_utc",
        )

    def _engine_rate(self, rows: DataFrame, name: str) -> DataFrame:
        if name == "id_base":
            return rows.selectExpr(
                "*", "'USD' as fx_currency", f"{_rate('1')} as fx_rate", "to_date(event_at) as fx_date"
            )
        currency = "cu" if name in ("journal", "keyless") else "c3"
        on = "to_date(event_at)"
        if name in ("id_fx", "journal"):
            on = f"date_sub({on}, case when k % 251 = 0 then 10 when k % 257 = 0 then 2 else 0 end)"
        rows = attach_rate(rows.selectExpr("*", f"{currency} as fx_currency"), self.book, "fx_currency", on, base="USD")
        if name == "id_own":
            wrong = f"if(k % 241 = 0, {_rate('1')}, fx_rate)"
            rows = rows.selectExpr("* except (fx_rate)", f"{wrong} as fx_rate")
        return rows

    # provider side ---------------------------------------------------------------------------

    @cache
    def provider(self, name: str, priced: bool = True) -> DataFrame:
        """Provider export of one profile; without prices only its keys are of use."""
        at = "event_at"
        if name != "keyless":
            at = f"if(june and k % 13 = 0, event_at + interval 31 days, {at})"
        if name == "id_fx":
            clock = "(event_at - cast(to_date(event_at) as timestamp_ntz))"
            swapped = f"cast(make_date(year(event_at), day(event_at), month(event_at)) as timestamp_ntz) + {clock}"
            at = f"if(k % 19 = 0 and early_day, {swapped}, {at})"
        rows = self.base.filter("k % 211 <> 0").selectExpr(
            "*", f"{at} as provider_at", f"{_money('if(k % 239 = 0, amount + 1.23, amount)')} as gross"
        )
        rows, given = getattr(self, f"_provider_{name}")(rows, priced)
        return rows.selectExpr(
            *[f"{given.get(c, f'cast(null as {t})')} as {c}" for c, t in P.PROVIDER_COLUMNS.items()]
        )

    @staticmethod
    def _twice(rows: DataFrame) -> DataFrame:
        return rows.selectExpr("*", "explode(if(k % 223 = 0, array(1, 2), array(1))) as copy")

    def _own_rate(self, rows: DataFrame, currency: str, drift: str, priced: bool) -> DataFrame:
        """The provider's own conversion, taken at the order date."""
        if not priced:
            return rows.selectExpr("*", *_NO_RATE, "cast(null as decimal(18,2)) as usd")
        rows = attach_rate(rows, self.book, currency, "to_date(event_at)", base="USD")
        rate = _rate(f"fx_rate + if({drift}, 0.001, 0)")
        rows = rows.selectExpr("* except (fx_rate)", f"{rate} as fx_rate")
        return rows.selectExpr("*", f"{money.valued('gross', 'fx_rate')} as usd")

    _BY_ID: Mapping[str, str] = {
        "provider_ref": "concat('P', k)",
        "provider_order": "concat('O', k)",
        "provider_type": "'Website Payment'",
        "provider_status": "case when k % 233 = 0 then 'Pending' when settled then 'Completed' else 'Denied' end",
        "provider_at": "provider_at",
        "provider_amount": "gross",
    }

    def _provider_id_base(self, rows, priced):
        fee = _share("gross", "0.034")
        return self._twice(rows), {**self._BY_ID, "provider_currency": "'USD'", "own_usd": "gross", "provider_fee": fee}

    def _provider_id_fx(self, rows, priced):
        fee = _share("gross", "0.034")
        return self._twice(rows), {**self._BY_ID, "provider_currency": "c3", "provider_fee": fee}

    def _provider_id_own(self, rows, priced):
        rows = self._own_rate(self._twice(rows), "c3", "k % 263 = 0", priced)
        money_columns = {"own_usd": "usd", "own_rate": "fx_rate", "provider_fee_usd": _share("usd", "0.045")}
        return rows, {**self._BY_ID, "provider_currency": "c3", **money_columns}

    def _provider_journal(self, rows, priced):
        rows = rows.selectExpr(
            "*",
            "explode(filter(array(if(settled, 'Authorised', null),"
            " if(k % 233 = 0 or not settled, 'Refused', 'Settled'),"
            " if(settled and k % 29 = 7, 'Refunded', null)), e -> e is not null)) as event",
        )
        fee = f"if(event = 'Settled', {_share('gross', '0.025')} + if(k % 271 = 0, 0.50, 0), 0)"
        return rows, {
            "provider_ref": "concat('P', k)",
            "provider_order": "concat('O', k)",
            "provider_type": "event",
            "provider_status": "event",
            "provider_at": "if(event = 'Refunded', event_at + interval 5 days, provider_at)",
            "provider_currency": "cu",
            "provider_amount": _money("if(event = 'Refunded', -amount, gross)"),
            "provider_fee": _money(fee),
            "account": "if(cu = 'USD', 'account_us', 'account_eu')",
        }

    def _provider_keyless(self, rows, priced):
        sale, _, fee = self.profile("keyless").keyless
        rows = self._own_rate(rows.filter("settled"), "cu", "k % 263 = 0 and cu <> 'USD'", priced)
        sales = self._twice(rows).selectExpr("* except (copy)", f"'{sale}' as line", "gross as local", "usd as money")
        share = "if(k % 269 = 0, 0.30, 0.15)"
        lines = (f"'{fee}' as line", f"-{_share('gross', share)} as local", f"-{_share('usd', share)} as money")
        return sales.unionByName(rows.selectExpr("*", *lines)), {
            "provider_type": "line",
            "provider_status": "line",
            "provider_at": "provider_at",
            "provider_currency": "cu",
            "provider_amount": _money("local"),
            "own_usd": _money("money"),
            "own_rate": "fx_rate",
            "product_id": _PRODUCT,
            "source_file": "concat('earnings_', year(provider_at))",
            "buyer_country": "case cu when 'EUR' then 'DE' when 'GBP' then 'GB' else 'US' end",
        }

    # the exports as raw text -----------------------------------------------------------------

    def raw_text(self, layout: str) -> DataFrame:
        """An export printed the way its provider prints it, every column text."""
        source, columns = _PRINTED[layout]
        rows = self.provider(source)
        if layout == "adyen_accounting":
            rows = rows.selectExpr("*", f"{_ZONE} as zone")
        printed = {c: "cast(null as string)" for c in LAYOUTS[layout].columns} | columns
        return rows.selectExpr(*[f"cast({sql} as string) as `{c}`" for c, sql in printed.items()])

    # results ---------------------------------------------------------------------------------

    def heavy(self, *names: str) -> dict[str, P.Heavy]:
        """Heavy keys of the profiles; those not looked for before are looked for in one job."""
        missing = [n for n in names if n not in self._heavy]
        if missing:
            bare = {n: (self.engine(n, False), self.provider(n, False), self.profile(n)) for n in missing}
            self._heavy.update(P.heavy_keys(bare, self.config))
        return {n: self._heavy[n] for n in names}

    @cache
    def pairs(self, name: str) -> DataFrame:
        sides = self.engine(name), self.provider(name), self.profile(name)
        return P.match(*sides, self.config, self.book, self.heavy(name)[name])

    def all_pairs(self) -> dict[str, DataFrame]:
        self.heavy(*PROFILES)
        return {n: self.pairs(n) for n in PROFILES}

    def engine_all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.engine(n) for n in PROFILES])

    @cached_property
    def schedule(self) -> DataFrame:
        """Contract rates in percent, in force until the next start; one account has two contracts in the period, one a start without a date."""
        rows = [
            ("journal", "account_eu", None, "2.5"), ("journal", "account_us", "1995-01-01", "2.5"), ("journal", "account_us", "1997-04-01", "2.4"),
            ("journal", "account_us", "1999-01-01", "9"), ("keyless", "account_main", "1995-01-01", "15"), ("keyless", "account_main", "1997-06-20", "16.5"),
        ]
        df = self.spark.createDataFrame(rows, "psp string, account string, start string, percent string")
        return df.selectExpr(
            "psp", "account", "cast(start as date) as valid_from", f"cast(percent as {money.PERCENT}) as percent_fee",
            f"{money.ZERO} as fixed_fee", "cast(null as string) as fixed_fee_currency",
        )


_ZONE = "case provider_currency when 'EUR' then 'Europe/Amsterdam' when 'GBP' then 'Europe/London' else 'America/New_York' end"
_COMMA = "replace(cast({} as string), '.', ',')"
_ANGELES = "convert_timezone('UTC', 'America/Los_Angeles', provider_at)"
_MINOR = "if(provider_currency = 'BRL', floor(provider_amount), cast(provider_amount * 100 as bigint))"
_DEBIT, _CREDIT = "if(provider_amount < 0, -provider_amount, null)", "if(provider_amount >= 0, provider_amount, null)"
_SETTLED = "provider_type = 'Settled'"
_PRINTED = {
    "paypal_eu_activity": (
        "id_fx",
        {
            "Date": "date_format(provider_at, 'dd/MM/yyyy')",
            "Time": "date_format(provider_at, 'HH:mm:ss')",
            "Time Zone": "'GMT'",
            "Transaction ID": "provider_ref",
            "Type": "provider_type",
            "Status": "provider_status",
            "Currency": "provider_currency",
            "Gross": _COMMA.format("provider_amount"),
            "Fee": _COMMA.format("-provider_fee"),
            "Net": _COMMA.format("(provider_amount - provider_fee)"),
            "Invoice ID": "provider_order",
        },
    ),
    "dlocal_transactions": (
        "id_own",
        {
            "transaction_id": "provider_ref",
            "invoice_id": "provider_order",
            "transaction_type": "if(provider_status = 'Pending', 'REFUND', 'PAYMENT')",
            "status": "provider_status",
            "created_at_utc": "provider_at",
            "currency": "provider_currency",
            "currency_exponent": "if(provider_currency = 'BRL', 0, 2)",
            "local_amount": _MINOR,
            "fx_rate": "cast(1 / own_rate as decimal(18,6))",
            "usd_amount": "own_usd",
            "fee_usd": "provider_fee_usd",
        },
    ),
    "adyen_accounting": (
        "journal",
        {
            "Merchant Account": "account",
            "Psp Reference": "provider_ref",
            "Merchant Reference": "provider_order",
            "Record Type": "provider_type",
            "Creation Date": "convert_timezone('UTC', zone, provider_at)",
            "TimeZone": "zone",
            "Gross Currency": "provider_currency",
            "Gross Debit": _DEBIT,
            "Gross Credit": _CREDIT,
            "Commission": f"if({_SETTLED}, provider_fee, null)",
            "Markup": f"if({_SETTLED}, 0.01, null)",
            "Batch Number": "25",
        },
    ),
    "google_play_earnings": (
        "keyless",
        {
            "source_file": "source_file",
            "Transaction Date": f"date_format({_ANGELES}, 'MMM d, yyyy')",
            "Transaction Time": f"date_format({_ANGELES}, 'HH:mm:ss')",
            "Transaction Type": "provider_type",
            "Product ID": "product_id",
            "Buyer Country": "buyer_country",
            "Buyer Currency": "provider_currency",
            "Amount (Buyer Currency)": "provider_amount",
            "Currency Conversion Rate": "own_rate",
            "Merchant Currency": "'USD'",
            "Amount (Merchant Currency)": "own_usd",
        },
    ),
}
_NO_RATE = (f"cast(null as {money.RATE}) as fx_rate", "cast(null as date) as fx_date")
