"""Raw files, types, zones and exports on small hand-made files."""

from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgermatch.functions import money, times
from ledgermatch.sources import layouts, readers, sinks, staging


def test_csv_is_all_text_and_empty_is_null(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('a,b,c\n007,"x,y",\n1.50,é,z\n', encoding="utf-8")
    df = readers.read_text_csv(spark, str(path), ["a", "b", "c"], comments={"a": "first"})
    assert df.dtypes == [("a", "string"), ("b", "string"), ("c", "string")]
    assert df.schema["a"].metadata["comment"] == "first"
    assert [tuple(r) for r in df.collect()] == [("007", "x,y", None), ("1.50", "é", "z")]


def test_windows_code_page(spark, tmp_path):
    path = tmp_path / "w.csv"
    text = "Name;Gross\nZoë € “quoted” – Œuvre;-59,99\n"
    path.write_bytes(text.encode("cp1252"))
    row = readers.read_text_csv(spark, str(path), ["Name", "Gross"], sep=";", encoding="cp1252").first()
    assert tuple(row) == ("Zoë € “quoted” – Œuvre", "-59,99")


def test_every_windows_character(spark, tmp_path):
    path = tmp_path / "all.csv"
    valid = [b for b in range(0x20, 0x100) if bytes([b]).decode("cp1252", "ignore") and b not in (0x22, 0x2C)]
    path.write_bytes(b"c,d\n" + b"\n".join(b"x" + bytes([b]) + b"x," + str(b).encode() for b in valid))
    rows = readers.read_text_csv(spark, str(path), ["c", "d"], encoding="cp1252").collect()
    assert {int(r.d): r.c for r in rows} == {b: f"x{bytes([b]).decode('cp1252')}x" for b in valid}


def test_banner_and_mixed_line_ends(spark, tmp_path):
    columns = layouts.LAYOUTS["google_play_earnings"].columns
    body = ['"Jun 1, 2026",00:30:00,Charge,p,US,USD,9.99,1.000000,USD,9.99'] * 2
    (tmp_path / "g.csv").write_bytes(
        b"Earnings report\n" + ",".join(columns).encode() + b"\r\n" + body[0].encode() + b"\r\n" + body[1].encode() + b"\n"
    )
    rows = layouts.read_raw(spark, "google_play_earnings", str(tmp_path / "g.csv")).collect()
    assert len(rows) == 2 and all(r["Transaction Date"] == "Jun 1, 2026" for r in rows)
    assert all(r["Amount (Merchant Currency)"] == "9.99" for r in rows)
    named = readers.read_banner_csv(spark, str(tmp_path / "g.csv"), columns, banner="^Earnings")
    assert named.count() == 2


def test_header_must_spell_the_columns(spark, tmp_path):
    (tmp_path / "h.csv").write_text("b,a\n1,2\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.read_text_csv(spark, str(tmp_path / "h.csv"), ["a", "b"]).collect()


def test_doubled_quotes_and_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n"say ""hi"", ok",2\n')
    assert [tuple(r) for r in readers.read_text_csv(spark, str(tmp_path / "q.csv"), ["a", "b"]).collect()] == [('say "hi", ok', "2")]
    (tmp_path / "m.csv").write_text('a,b\n"two\nlines",2\n')
    rows = readers.read_text_csv(spark, str(tmp_path / "m.csv"), ["a", "b"], multiline=True).collect()
    assert [tuple(r) for r in rows] == [("two\nlines", "2")]
    sinks.export_csv(spark.createDataFrame([('say "hi", ok', 2)], "a string, b int"), str(tmp_path / "out"))
    assert duckdb.sql(f"select a, b from read_csv('{tmp_path}/out/*.csv', header = true)").fetchall() == [('say "hi", ok', 2)]


def test_no_line_of_a_banner_file_is_dropped(spark, tmp_path):
    head = "Earnings report, June 2026\na,b\n"
    (tmp_path / "one.csv").write_text(head + '"Jun 1, 2026",1\nx,2\n')
    (tmp_path / "two.csv").write_text(head + "y,3\n")
    both = [str(tmp_path / "one.csv"), str(tmp_path / "two.csv")]
    rows = readers.read_banner_csv(spark, both, ["a", "b"]).collect()
    assert sorted(tuple(r) for r in rows) == [("Jun 1, 2026", "1"), ("x", "2"), ("y", "3")]
    (tmp_path / "cut.csv").write_text(head + 'x,2\n"Jun 2')
    (tmp_path / "turned.csv").write_text("Earnings report\nb,a,c\nx,2\n")
    for name in ("cut", "turned"):
        with pytest.raises((PySparkException, Py4JJavaError)):
            readers.read_banner_csv(spark, str(tmp_path / f"{name}.csv"), ["a", "b"]).collect()


def test_bad_text_raises_and_can_be_put_aside(spark):
    raw = spark.createDataFrame([("1.5", "x"), ("abc", "y"), (None, "z")], "amount string, k string")
    with pytest.raises(PySparkException):
        raw.selectExpr(money.cast("amount", money.MONEY)).collect()
    rows = {r.k: r for r in staging.try_types(raw, {"amount": money.MONEY}).collect()}
    assert rows["x"].amount == Decimal("1.50") and rows["x"].bad_columns == []
    assert rows["y"].amount is None and rows["y"].bad_columns == ["amount"]
    assert rows["z"].bad_columns == []


@pytest.mark.parametrize("zone", ["America/Los_Angeles", "Europe/Amsterdam", "Australia/Lord_Howe"])
def test_local_time_to_utc_as_in_duckdb(spark, zone):
    start, step = datetime(2026, 1, 1, 0, 15), "30 minutes"
    sql = f"select unnest(generate_series(timestamp '{start}', timestamp '2026-12-31', interval {step})) as t"
    con = duckdb.connect()
    want = dict(con.execute(f"select t, timezone('UTC', timezone('{zone}', t)) from ({sql})").fetchall())
    df = spark.sql(
        f"select explode(sequence(timestamp_ntz'{start}', timestamp_ntz'2026-12-31 00:00:00', interval {step})) as t, '{zone}' as z"
    )
    got = {r.t: (r.a, r.b) for r in df.selectExpr("t", f"{times.to_utc('t', 'z')} as a", f"""{times.to_utc('t', f"'{zone}'")} as b""").collect()}
    assert len(got) > 17000
    assert {t: a for t, (a, _) in got.items()} == want == {t: b for t, (_, b) in got.items()}


def test_earlier_reading_of_the_repeated_hour(spark):
    t = "timestamp_ntz'2026-11-01 01:30:00'"
    zone = "'America/Los_Angeles'"
    row = spark.sql(f"select {times.to_utc(t, zone, 'earlier')} as a, {times.to_utc(t, zone)} as b").first()
    assert (row.a, row.b) == (datetime(2026, 11, 1, 8, 30), datetime(2026, 11, 1, 9, 30))
    with pytest.raises(ValueError):
        times.to_utc(t, zone, "never")


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        (money.from_minor_units("12345", "2"), "123.45"),
        (money.from_minor_units("12345", "0"), "12345.00"),
        (money.invert_rate("cast(5.25 as decimal(18,6))"), "0.190476"),
        (money.cast(money.decimal_comma("'-59,99'"), money.MONEY), "-59.99"),
        (money.credit_less_debit("null", "cast(3.50 as decimal(18,2))"), "-3.50"),
        (money.fee_total("cast(0.10 as decimal(18,2))", "null"), "0.10"),
        (money.valued("cast(10.05 as decimal(18,2))", "cast(0.5 as decimal(18,6))"), "5.03"),
        (money.signed("cast(2 as decimal(18,2))", "1 = 2"), "-2.00"),
    ],
)
def test_money(spark, sql, want):
    assert spark.sql(f"select {sql} as v").first().v == Decimal(want)


@pytest.mark.parametrize(
    ("d", "fmt", "want"),
    [
        ("06/30/2026", "MM/dd/yyyy", datetime(2026, 6, 30, 23, 59, 1)),
        ("30/06/2026", "dd/MM/yyyy", datetime(2026, 6, 30, 23, 59, 1)),
        ("Jun 1, 2026", "MMM d, yyyy", datetime(2026, 6, 1, 23, 59, 1)),
        ("Jun 12, 2026", "MMM d, yyyy", datetime(2026, 6, 12, 23, 59, 1)),
    ],
)
def test_wall_clock(spark, d, fmt, want):
    sql = times.wall_clock(f"'{d}'", "'23:59:01'", fmt)
    assert spark.sql(f"select {sql} as v").first().v == want


@pytest.mark.parametrize(
    ("provider", "engine", "want"),
    [
        ("2026-03-06 10:00:00", "2026-06-03 10:00:00", True),
        ("2026-03-06 10:00:00", "2026-06-03 10:00:01", False),
        ("2026-06-30 10:00:00", "2026-06-30 10:00:00", False),
        ("2026-06-06 10:00:00", "2026-06-06 10:00:00", True),
        (None, "2026-06-03 10:00:00", False),
        ("2026-03-06 10:00:00", None, False),
    ],
)
def test_swapped_day_and_month(spark, provider, engine, want):
    literal = [f"timestamp_ntz'{t}'" if t else "cast(null as timestamp_ntz)" for t in (provider, engine)]
    assert spark.sql(f"select {times.day_month_swapped(*literal)} as v").first().v is want


def test_seconds_between(spark):
    sql = times.seconds_between("timestamp_ntz'2026-01-01 00:00:00'", "timestamp_ntz'2026-01-02 00:00:00.5'")
    assert spark.sql(f"select {sql} as v").first().v == 86400.5


def test_exports_and_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb", None), (2, "c,d", date(2026, 1, 2))], "i int, t string, d date")
    sinks.export_csv(df.coalesce(1), str(tmp_path / "tsv"), sep="\t")
    back = spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "tsv"))
    assert sorted(tuple(r) for r in back.collect()) == [("1", "a\tb", None), ("2", "c,d", "2026-01-02")]
    sinks.export_all({"x": df}, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv" / "x")).count() == 2
    written = sinks.write_table(df.select("*", F.lit("p").alias("psp")), str(tmp_path / "t"), ("psp",))
    assert written.columns == ["i", "t", "d", "psp"] and written.count() == 2
    assert sinks.table_sizes({"x": written}) == {"x": 2}


def test_catalog_lists_columns_with_comments(spark):
    layouts.register({"numbers": spark.range(3)}, prefix="lm_")
    try:
        listed = sinks.list_tables(spark).filter("table_name = 'lm_numbers'").collect()
        assert [(r.column_name, r.data_type) for r in listed] == [("id", "bigint")]
    finally:
        spark.catalog.dropTempView("lm_numbers")


def test_comments_are_kept_in_the_catalog(spark, tmp_path):
    spark.sql(f"create database if not exists lm_db location '{tmp_path}'")
    try:
        sinks.save_table(spark.range(2), "lm_db.ids", "engine's ids", {"id": "the 'id'"})
        assert spark.table("lm_db.ids").schema["id"].metadata["comment"] == "the 'id'"
        assert spark.catalog.getTable("lm_db.ids").description == "engine's ids"
    finally:
        spark.sql("drop database lm_db cascade")
