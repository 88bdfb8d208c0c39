"""The profiles on small sheets with planted defects, and on clean ones."""

from collections import Counter

import pytest

from ledgerlens.plans import profiles as P

GOOD = 1_000_000 * 0.16 * 31 / 365


def sheet(spark, name, first_row, rows):
    data = [("f.xlsx", name, first_row + i, [None if c is None else str(c) for c in r]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "file string, sheet string, row_no int, cells array<string>")


def codes(df, severity=None):
    return Counter(r.code for r in df.collect() if severity in (None, r.severity))


DEBT = ["Сумма долга", "Дата с", "Дата по", "Дней", "Ставка", "Пени"]


def test_debt_with_planted_defects(spark):
    g = round(GOOD, 2)
    rows = [(1000000, "2026-01-15", "2026-02-14", 31, 16, g), (1000000, "2026-02-12", "2026-03-14", 31, 16, g), (1000000, "2026-03-15", "2026-04-14", 30, 16, g), (1000000, "2026-04-15", "2026-05-15", 31, 16, g + 5000), (None, None, None, None, "ИТОГО", 4 * g + 15000)]
    got = P.analyze(sheet(spark, "Расчёт", 4, rows), DEBT, "debt").cache()
    assert codes(got, "error") == {"period-overlap": 1, "days-mismatch": 1, "row-arithmetic": 2, "total-mismatch": 1}
    over = got.where("code = 'period-overlap'").first()
    assert over.numbers["overlap_days"] == 3 and over.cells == ["Расчёт!C4", "Расчёт!B5"]


def test_debt_clean_in_a_leap_year_and_across_years(spark):
    leap = [(500000, "2024-01-10", "2024-02-09", 31, 16, 500000 * 0.16 * 31 / 366), (500000, "2024-02-10", "2024-03-10", 30, 16, 500000 * 0.16 * 30 / 366), (500000, "2024-03-11", "2024-04-10", 31, 16, 500000 * 0.16 * 31 / 366)]
    leap.append((None, None, None, None, "Итого", sum(r[5] for r in leap)))
    assert not codes(P.analyze(sheet(spark, "S", 2, leap), DEBT, "debt"), "error")
    years = [(2000000, f"{y}-{m:02d}-01", f"{y}-{m:02d}-{d}", d, 21, 2000000 * 0.21 * d / k) for y, m, d, k in ((2024, 11, 30, 366), (2024, 12, 31, 366), (2025, 1, 31, 365), (2025, 2, 28, 365))]
    assert not codes(P.analyze(sheet(spark, "S", 2, years), DEBT, "debt"), "error")


def test_debt_without_columns_refuses(spark):
    assert codes(P.analyze(sheet(spark, "S", 2, [("x", "y")]), ["a", "b"], "debt")) == {"columns-missing": 1}


STATEMENT = ["Дата", "Контрагент", "Назначение платежа", "Приход", "Списание", "Остаток"]


def test_statement_with_planted_defects(spark):
    b, rows = 5_000_000, []
    for date, party, debit, hidden in (("2026-02-03", "Поставщик", 300000, 0), ("2026-02-10", "Ромашка", 400000, 0), ("2026-02-10", "Ромашка", 400000, 0), ("2026-02-10", "Ромашка", 400000, 0), ("2026-02-11", "Ромашка", 400000, 0), ("2026-03-01", "Прочий", 100000, 2000000)):
        b -= debit + hidden
        rows.append((date, party, "оплата", None, debit, b))
    rows.append(("ИТОГО", None, None, None, 1000000, None))
    got = P.analyze(sheet(spark, "Обороты", 5, rows), STATEMENT, "statement").cache()
    assert codes(got, "error") == {"balance-break": 1, "total-mismatch": 1}
    assert got.where("code = 'balance-break'").first().numbers["gap"] == -2000000
    split = got.where("code = 'payment-splitting'").collect()
    assert len(split) == 1 and split[0].numbers == {"count": 4.0, "total": 1600000.0}
    assert codes(got)["duplicate-in-splitting"] == 1 and "duplicate-operation" not in codes(got)


PAYMENTS = ["Дата", "Контрагент", "ИНН", "Назначение", "Сумма"]
PAID = [("2026-06-01", "Ромашка", "7707083893", "x", 1200000), ("2026-05-16", "Лютик", "7712345678", "x", 500000), ("2026-01-10", "Пион", "7799999999", "x", 2000000), ("2024-03-03", "Старый", "7788888888", "x", 5000000), ("2022-01-01", "Древний", "7766666666", "x", 900000)]


def test_payments_with_and_without_an_anchor(spark):
    s = sheet(spark, "P", 2, PAID)
    assert codes(P.analyze(s, PAYMENTS, "payments"), "error") == {"anchor-missing": 1}
    got = P.analyze(s, PAYMENTS, "payments", anchor="2026-06-15").cache()
    assert codes(got) == {"near-period-border": 1, "outside-periods": 1, "easiest-composition": 1}
    assert got.where("code = 'easiest-composition'").first().numbers == {"count": 2.0, "total": 1700000.0}


def test_payments_cumulative(spark):
    from pyspark.sql import functions as F

    from ledgerlens.operators import payments

    rows = P.typed(sheet(spark, "P", 2, PAID), P.bind(PAYMENTS, "payments"), "payments")
    bands = payments.by_band(payments.classify(rows, F.lit("2026-06-15").cast("date")), [])
    assert {r.period: (r.n, r.total) for r in payments.cumulative(bands, []).collect()} == {"1m": (2, 1.7e6), "6m": (3, 3.7e6), "1y": (3, 3.7e6), "3y": (4, 8.7e6)}


@pytest.mark.parametrize("head,rows", [
    (["Кредитор", "ИНН", "Очередь", "Основной долг", "Неустойка"], [("Наш клиент", "7701111111", "третья", 50000000, 10000000), ("Банк (ПАО)", "7702222222", "третья", 120000000, 0), ("ФНС России", "7703333333", "третья", 30000000, 5000000), ("Работники", None, "вторая", 3000000, 0), ("Банк (ООО)", "7702222222", "третья", 20000000, 0)]),
    (["Кредитор", "ИНН", "Очередь", "Сумма требования", "в т.ч. неустойка"], [("Наш клиент", "7701111111", "3", 60000000, 10000000), ("Банк", "7702222222", "III", 140000000, 0), ("ФНС", "7703333333", "третья", 35000000, 5000000)]),
])
def test_registry_share(spark, head, rows):
    got = P.analyze(sheet(spark, "R", 2, rows), head, "registry", our="наш клиент").cache()
    assert got.where("code = 'voting-share'").first().numbers["share_percent"] == 22.73
    assert codes(got).get("creditor-duplicate", 0) == (1 if len(rows) == 5 else 0)


def test_registry_missing_claim(spark):
    got = P.analyze(sheet(spark, "R", 2, [("Банк", "7702222222", "3", 10, 0)]), ["Кредитор", "ИНН", "Очередь", "Сумма", "Пени"], "registry", our="нет такого")
    assert codes(got, "error") == {"our-claim-missing": 1}
