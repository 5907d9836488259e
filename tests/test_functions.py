"""Functions against worked values."""

from __future__ import annotations

import datetime as dt
import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.functions import bonds, dates, numbers, ocr, ratings, risk, text

TODAY = dt.date(2024, 1, 15)


def table(spark, rows, schema, **columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*[c.alias(k) for k, c in columns.items()]).collect()]


def test_price_clusters(spark):
    prices = [0.0, 69.99, 70.0, 95.0, 105.0, 120.0, -1.0, None, float("nan")]
    got = [r[0] for r in table(spark, [(p,) for p in prices], "p double", x=bonds.price_cluster(F.col("p")))]
    assert got == ["Deep Discount", "Deep Discount", "Discount", "Par", "Premium", "High Premium", None, None, None]


def test_first_valid_price(spark):
    got = table(spark, [(0.0, None, 98.0), (101.0, 99.0, 98.0), (0.0, 0.0, 0.0)], "a double, b double, l double", x=bonds.first_valid_price(F.col("a"), F.col("b"), F.col("l")))
    assert [g[0] for g in got] == [98.0, 101.0, None]


def test_current_yield_and_size_pressure(spark):
    got = table(spark, [(5.0, 0.0, 100.0, None), (0.0, 99.0, 99.0, 99.0), (None, 1.0, 1.0, 1.0)], "c double, l double, a double, b double", x=bonds.current_yield(*map(F.col, "clab")))
    assert [g[0] for g in got] == [0.05, None, None]
    assert table(spark, [(300.0, 100.0)], "a double, b double", x=bonds.size_pressure(F.col("a"), F.col("b"))) == [(200.0,)]


@pytest.mark.parametrize(
    ("days", "coupon", "price", "frequency", "want"),
    [(1827, 0.05, 100.0, 2, 4.485432764622608), (3650, 0.04, 92.5, 2, 8.751830639976982), (90, 0.06, 101.0, 4, 0.2475609756097561), (360, 0.0, 95.0, 2, 1.0526315789473684), (0, 0.05, 100.0, 2, 0.0), (-9, 0.05, 100.0, 2, 0.0), (900, 0.05, 0.0, 2, None), (900, 0.05, 100.0, 0, None)],
)
def test_duration(one, days, coupon, price, frequency, want):
    got = one(bonds.duration(F.lit(TODAY + dt.timedelta(days=days)), F.lit(coupon), F.lit(price), F.lit(frequency), F.lit(TODAY)))
    if frequency == 0:  # counts as twice a year
        assert got == one(bonds.duration(F.lit(TODAY + dt.timedelta(days=days)), F.lit(coupon), F.lit(price), F.lit(2), F.lit(TODAY)))
    else:
        assert got == (None if want is None else pytest.approx(want, rel=1e-12))


def test_yield_to_maturity(spark):
    got = table(spark, [(92.5, 4.0, 10.0), (110.0, 6.0, 5.0), (100.0, 5.0, None), (None, 5.0, 3.0)], "p double, c double, y double", x=bonds.yield_to_maturity(*map(F.col, "pcy")))
    assert [g[0] for g in got] == [pytest.approx(0.04935064935064935), pytest.approx(0.0380952380952381), None, None]


def test_payment_frequency(spark):
    texts = ["", "Semi-Annual", "Semi-Annually", "Zero Coupon", "weird", None, "paid quarterly"]
    assert [g[0] for g in table(spark, [(t,) for t in texts], "t string", x=bonds.payment_frequency(F.col("t")))] == [2, 2, 1, 0, 2, None, 4]


def test_treasury_yield(spark):
    got = table(spark, [("99.50",), ("99.500",), ("101.25",), ("0",), (None,)], "t string", x=bonds.treasury_yield(F.lit(4.0), F.col("t")), y=bonds.treasury_yield(F.lit(4.0), F.col("t"), parity=False))
    assert [g[0] for g in got] == [pytest.approx(40.20100502512563), pytest.approx(4.0201005025125625), pytest.approx(39.50617283950617), None, None]
    assert got[0][1] == pytest.approx(400 / 99.5)


def test_price_texts(spark):
    got = table(spark, [("1,000.5",), ("C12.5",), ("0",), ("",), (None,)], "t string", x=bonds.leading_number(F.col("t")), y=bonds.signed_price(F.col("t")))
    assert got == [(1.0, 1000.5), (12.5, 12.5), (None, 0.0), (None, 0.0), (None, 0.0)]


@pytest.mark.parametrize(
    ("described", "want"),
    [
        ("GM CORP 5 Oct01'28 37045VAS9 BAA2/BBB", ("GM CORP", 5.0, "2028-10-01", None, "BAA2/BBB")),
        ("US TREASURY 3.25 12/31/2032 US91282CHF10 AA+/AA+", ("US TREASURY", 3.25, "2032-12-31", "US91282CHF10", "AA+/AA")),
        ("XYZ 5 1/2% MS43", ("XYZ", 5.5, None, None, None)),
        ("GM D08/26/13 05.950% MS43", ("GM D08/26/13", 5.95, None, None, None)),
        ("PLAIN", ("PLAIN", None, None, None, None)),
    ],
)
def test_bond_details(one, described, want):
    assert tuple(one(bonds.bond_details(F.lit(described)))) == want


def test_rating_texts(spark):
    got = table(spark, [("BAA2/BBB (MOODY/SP)",), ("CAA3 (MOODY)",), ("NR",), (None,)], "t string", r=ratings.agency_ratings(F.col("t")))
    assert [tuple(g[0]) for g in got] == [("BAA2", "BBB"), ("CAA3", None), (None, None), (None, None)]


def test_rating_levels(spark):
    worst = lambda strict: ratings.worse_level(ratings.rating_level(F.col("m"), strict), ratings.rating_level(F.col("s"), strict))
    rows = [("BAA2", "BBB"), ("A2", "A-"), ("", ""), ("CAA3", "A")]
    got = table(spark, rows, "m string, s string", strict=worst(True), loose=worst(False), name=ratings.sp_equivalent(worst(False)))
    assert got == [(9, 9, "BBB"), (7, 7, "A-"), (None, None, None), (6, 19, "CCC-")]


def test_resolved_ratings(spark):
    rows = [("T-NOTE 4", None, None, None, None), ("x", " bbb ", None, None, None), ("x", None, "A-", None, None), ("x", None, None, "BAA2/BBB", None), ("x", None, None, None, "Baa3"), ("x", None, None, None, None)]
    name = ratings.resolved_rating(ratings.is_treasury(F.col("n")), *map(F.col, "espm"))
    got = table(spark, rows, "n string, e string, s string, p string, m string", x=name, b=ratings.rating_bucket(name))
    assert got == [("UST", "treasuries"), ("BBB", "bonds_bbb"), ("A-", "bonds_aaa_a"), ("AA", "bonds_aaa_a"), ("BBB-", "bonds_bbb"), ("", "")]


def test_percent_and_roundings(spark):
    got = table(spark, [("4.5%",), ("0.045",), ("1",), ("abc",), (None,), ("inf",)], "t string", x=numbers.percent(numbers.number(F.col("t"))))
    assert [g[0] for g in got] == [4.5, 4.5, 100.0, 0.0, 0.0, 0.0]
    assert table(spark, [(0.5,), (2.5,), (1.5,)], "x double", e=numbers.half_even(F.col("x")), u=numbers.half_up(F.col("x"))) == [(0.0, 1), (2.0, 3), (2.0, 2)]


def test_names(spark):
    rows = [("José  Ñandú-O'Neil",), ("ØRSTED",), ("", ), (None,), ("DOE, JANE",)]
    assert [g[0] for g in table(spark, rows, "t string", x=text.normalized_name(F.col("t")))] == ["jose nandu o neil", "rsted", "", "", "doe jane"]


def test_document_text(spark):
    rows = [("a \r\nb\t\rc  \n",), (None,), ("\n\n x \n",)]
    assert [g[0] for g in table(spark, rows, "t string", x=text.document_text(F.col("t")))] == ["a\nb\nc", "", "x"]
    assert table(spark, [("a\nb" * 200,)], "t string", x=F.length(text.preview(F.col("t")))) == [(300,)]


def test_translation_errors(spark):
    rows = [("fine",), ("  \n",), ("bad\x1b",), ("has ZZX900018XZZ",), ("--- GLOSSARY START ---",)]
    got = [g[0] for g in table(spark, rows, "t string", x=text.translation_error(F.col("t")))]
    assert got[0] is None and [bool(x) for x in got[1:]] == [True] * 4 and got[4].endswith("--- GLOSSARY START ---")


def test_passes_through(spark):
    rows = [("",), ("12/31 - 99",), ("Page 3 of 9",), ("ACME HOLDINGS S.A.",), ("ordinary words",), ("AB12-99",), ("12 de enero de 2024",)]
    assert [g[0] for g in table(spark, rows, "t string", x=text.passes_through(F.col("t")))] == [True, True, True, True, False, True, True]


def packed(lines, most):
    done, current = [], None
    for line in lines:
        if current is not None and len(current) + 1 + len(line) <= most:
            current += "\n" + line
        else:
            if current is not None:
                done.append(current)
            current = line
    return [c.strip() for c in [*done, current or ""] if c.strip()]


def test_packed_lines(spark):
    texts = ["\n".join("x" * n for n in sizes) for sizes in ([3, 4, 5], [30, 1, 1], [10, 10, 10, 10], [0], [19, 1])]
    got = [g[0] for g in table(spark, [(t,) for t in texts], "t string", x=text.packed_lines(F.col("t"), 20))]
    assert got == [packed(t.split("\n"), 20) for t in texts]


def test_within_budget(one):
    entries = F.array(*[F.lit(x) for x in ("aaaa", "b" * 30, "cc", "dd", "e")])
    assert one(text.within_budget(entries, 10, 3)) == ["aaaa", "cc", "dd"]


def test_language_codes(spark):
    names = {"spanish": "es", "english": "en", "french": "fr"}
    rows = [("Spanish; English",), (None,), ("French+french",)]
    assert [g[0] for g in table(spark, rows, "t string", x=text.language_codes(F.col("t"), names))] == [["es", "en"], ["es", "en"], ["fr", "en"]]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.dates(dt.date(2020, 1, 1), dt.date(2026, 1, 1)), st.integers(-5, 60)), min_size=40, max_size=60))
def test_business_days(spark, pairs):
    rows = [(d, d + dt.timedelta(days=n)) for d, n in pairs]
    days = dates.business_days_since(F.col("a"), F.col("b"))
    got = [g[0] for g in table(spark, rows, "a date, b date", x=days)]
    want = [max(0, sum((a + dt.timedelta(days=i)).weekday() < 5 for i in range((b - a).days + 1)) - 1) for a, b in rows]
    assert got == want


def test_other_dates(spark):
    assert table(spark, [(0,), (1,), (5,), (6,), (11,)], "d int", x=dates.notice_number(F.col("d"))) == [(1,), (1,), (1,), (2,), (3,)]
    days = [dt.date(2024, 1, 15), dt.date(2024, 1, 14), dt.date(2024, 1, 13), dt.date(2024, 1, 12)]
    assert [g[0].day for g in table(spark, [(d,) for d in days], "d date", x=dates.previous_business_day(F.col("d")))] == [12, 12, 12, 11]
    months = dates.month_series(F.col("a"), F.col("b"))
    got = table(spark, [(dt.date(2023, 11, 9), dt.date(2024, 1, 2)), (dt.date(2024, 2, 1), dt.date(2024, 1, 1))], "a date, b date", x=months)
    assert [len(g[0]) for g in got] == [3, 0]


def test_report_timestamps(spark):
    rows = [("2024-01-15T10:00:00Z",), ("2024-01-15T10:00:00-05:00",), ("20240115;101500",), ("20240115",), ("2024-01-15",), ("01/15/2024",), ("never",), (None,)]
    got = [str(g[0]) for g in table(spark, rows, "t string", x=dates.report_timestamp(F.col("t")))]
    assert got == ["2024-01-15 10:00:00", "2024-01-15 15:00:00", "2024-01-15 10:15:00", "2024-01-15 00:00:00", "2024-01-15 00:00:00", "2024-01-15 00:00:00", "None", "None"]


def test_file_names(spark):
    rows = [("111111_20240101_20240131.csv",), ("222222_20240229.csv",), ("plain.csv",)]
    got = table(spark, rows, "t string", a=dates.last_digits(F.col("t")), b=dates.nav_digits(F.col("t")), c=dates.third_part(F.col("t")))
    assert got == [("20240131", "20240101", "20240131"), ("20240229", "20240229", ""), (None, None, "")]


def test_ocr_scores(spark):
    columns = dict(zip("tcprel", ("t", "c", "p", "r", "e", "l"), strict=True))
    rows = [("x" * 40, None, 1, 0, 0, 0), ("x" * 100, 0.6, 2, 4, 1, 1), ("abc", None, 1, 0, 0, 0), ("  ", 0.9, 1, 0, 0, 0)]
    got = [g[0] for g in table(spark, rows, "t string, c double, p int, r int, e int, l int", a=ocr.assessed(*[F.col(c) for c in columns]))]
    assert [(g["score"], g["status"]) for g in got] == [(90.25, "high"), (57.75, "review"), (81.0, "high"), (0.0, "low")]
    assert got[2]["reasons"] == ["confidence_unavailable", "very_short_text"] and got[3]["reasons"] == ["no_text"]


def test_ocr_downgrade_and_geometry(spark, one):
    defect = "array<struct<type:string,confidence:double>>"
    rows = [("high", 0.9, []), ("high", 0.6, []), ("high", 0.3, []), ("high", 0.9, [("quality/defect_glare", 0.8)]), ("high", None, [("quality/defect_dark", 0.9), ("quality/defect_noisy", 0.86)])]
    got = table(spark, rows, f"s string, q double, d {defect}", x=ocr.downgraded(*map(F.col, "sqd")))
    assert [g[0] for g in got] == ["high", "review", "low", "review", "low"]
    words = F.from_json(F.lit('[{"polygon":[[1,1],[3,3]],"text":"in"},{"polygon":[[8,8],[9,9]],"text":"out"}]'), "array<struct<polygon:array<array<double>>,text:string>>")
    box = F.struct(F.lit(0).alias("left"), F.lit(0).alias("top"), F.lit(5).alias("right"), F.lit(5).alias("bottom"))
    assert [w["text"] for w in one(ocr.inside(words, box))] == ["in"]
    parts = F.from_json(F.lit('[{"text":"abcd","confidence":1.0},{"text":"","confidence":0.0},{"text":"zz"}]'), "array<struct<text:string,confidence:double>>")
    assert one(ocr.weighted_confidence(parts)) == 0.8


def test_page_chunks(spark):
    got = [g[0] for g in table(spark, [(0,), (1,), (15,), (31,)], "n int", x=ocr.page_chunks(F.col("n")))]
    assert got == [[], [[1]], [list(range(1, 16))], [list(range(1, 16)), list(range(16, 31)), [31]]]


def test_product_risk(spark):
    rows = [(0, [], None), (1, ["CRYPTO FUND"], None), (1, ["CFD"], None), (1, ["STK"] * 5, None), (1, ["OPT"], "MARGIN"), (1, ["OPT"], None), (1, ["STK", "ETF"], "Cash"), (1, [], None)]
    got = table(spark, rows, "n int, p array<string>, m string", x=risk.product_risk(*map(F.col, "npm")))
    assert [g[0] for g in got] == [3, 9, 7, 5, 5, 3, 1, 3]


def test_customer_risk(spark):
    flags = list(itertools.product(["INDIVIDUAL", "JOINT", "ORG"], [False, True], [False, True]))
    got = table(spark, flags, "k string, a boolean, x boolean", r=risk.customer_risk(F.col("k"), F.col("a"), F.col("x"), F.lit(None).cast("boolean"), F.col("x"), F.lit(0), F.lit(False), F.lit(False)))
    want = [9 if a else {"INDIVIDUAL": 3 if x else 1, "JOINT": 3, "ORG": 7 if x else 5}[k] for k, a, x in flags]
    assert [g[0] for g in got] == want


def test_customer_types_and_fatf(spark):
    got = table(spark, [(None, "organization"), ("weird", "joint"), ("weird", None), (None, None)], "a string, b string", x=risk.customer_type([F.col("a"), F.col("b")]))
    assert [g[0] for g in got] == ["ORG", "JOINT", "WEIRD", ""]
    assert [g[0] for g in table(spark, [("ven",), ("Côte d'Ivoire",), ("USA",), (None,)], "c string", x=risk.fatf_status(F.col("c")))] == ["Listed", "Listed", None, None]
