"""Scalar rules on their edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S

NUMBERS = {"1 200 000,00 руб.": 1200000, "1500000.75": 1500000.75, "1,234.56": 1234.56, "1.200.000,00": 1200000, "12 %": 12, "(500)": -500, "−7": -7, "1,234": 1.234, "1,234,567": 1234567, "1.2.3": 1.23, "abc": None, "": None, ".": None, "12-5": None, "1'000'000": 1000000, None: None}
DATES = {"2026/02/01": dt.date(2026, 2, 1), "1.02.2026": dt.date(2026, 2, 1), "01.02.26": dt.date(2026, 2, 1), "1 февраля 2026 г.": dt.date(2026, 2, 1), "30.02.2026": None, "01.02.49": dt.date(2049, 2, 1), "01.02.50": dt.date(1950, 2, 1), "2026-13-01": None, "x": None, None: None}


@pytest.mark.parametrize("cases,parse", [(NUMBERS, S.parse_number), (DATES, S.parse_date)])
def test_parsing(spark, cases, parse):
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r.x: r.y for r in df.select("x", parse("x").alias("y")).collect()} == cases


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_tolerance_is_relative_to_the_second_and_inclusive(spark):
    assert one(spark, S.close(F.lit(100.0), F.lit(101.0))) and not one(spark, S.close(F.lit(100.0), F.lit(101.1)))
    assert one(spark, S.close(F.lit(995.0), F.lit(1000.0))) and not one(spark, S.close(F.lit(995.0), F.lit(1000.0), 1.0, None))
    assert one(spark, S.close(F.lit(None).cast("double"), F.lit(1.0))) is False


def test_small_ones(spark):
    assert [S.col_letter(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert one(spark, S.money(F.lit(-13589.04))) == "−13 589,04 ₽" and one(spark, S.money(F.lit(None).cast("double"))) == "—"
    assert [one(spark, S.plural(F.lit(n), "a", "b", "c")) for n in (1, 2, 5, 11, 21, 112)] == ["1 a", "2 b", "5 c", "11 c", "21 a", "112 c"]
    assert one(spark, S.resolve_party(F.lit(""), F.lit("оплата по счёту «Ромашка»"))) == "Ромашка"
    assert one(spark, S.resolve_party(F.lit(""), F.lit("ИНН 7707083893 за товар"))) == "ИНН 7707083893"
    assert one(spark, S.parse_queue(F.lit(""), F.lit("ООО Первая"))) == "перв" and one(spark, S.parse_queue(F.lit("III"), F.lit("первая"))) == "трет"
    assert one(spark, S.percent_decode(F.lit("a%20b+c%ZZ"))) == "a%20b+c%ZZ"
    assert one(spark, S.compare_field(F.lit("1 200,50"), F.lit("1200.5"))) == "match"


def test_months_back_holds_the_day(spark):
    assert one(spark, S.months_back(F.lit("2026-03-31").cast("date"), 1)) == dt.date(2026, 2, 28)
