"""Whole reports over the sheets of the profile tests."""

import datetime as dt

from test_profiles import DEBT, GOOD, PAID, PAYMENTS, STATEMENT, sheet

from ledgerlens.plans import reports as R

day = dt.date.fromisoformat


def test_debt_report(spark):
    g = round(GOOD, 2)
    rows = [(1000000, "2026-01-15", "2026-02-14", 31, 16, g), (1000000, "2026-02-12", "2026-03-14", 31, 16, g), (1000000, "2026-03-15", "2026-04-14", 30, 16, g), (1000000, "2026-04-15", "2026-05-15", 31, 16, g + 5000), (None, None, None, None, "ИТОГО", 4 * g + 15000)]
    two = sheet(spark, "Расчёт", 4, rows).unionByName(sheet(spark, "Второй", 4, rows[:1]))
    got = {r.sheet: r for r in R.reports(two, DEBT, "debt", most=3).collect()}
    r = got["Расчёт"]  # its lists are cut at three entries, its figures are whole
    assert (r.profile, r.columns, r.errors, r.n_rows) == ("debt", {"base": "A", "date_from": "B", "date_to": "C", "days": "D", "rate": "E", "amount": "F"}, 5, 4)
    assert r.formula.accepted and r.formula.total == 4 and [x.row for x in r["rows"]] == [4, 5, 6] and [x.ok for x in r["rows"]] == [True, True, False]
    assert r["rows"][0].date_from == day("2026-01-15") and r["rows"][0].amount == g
    assert r.periods.checked and [(x["rows"], x.days) for x in r.periods.overlaps] == [([4, 5], 3)] and not r.periods.gaps
    assert (r.totals.stated_total_row, r.totals.delta) == (8, 10000.0) and [x.rate for x in r.rates] == [16.0] * 3
    assert [f.code for f in r.findings] == ["days-mismatch", "period-overlap", "row-arithmetic"] and r.n_findings > 5
    assert not got["Второй"].periods.checked and got["Второй"].totals.stated_total is None


def test_statement_report(spark):
    b, rows = 5_000_000, []
    for date, party, debit, hidden in (("2026-02-03", "Поставщик", 300000, 0), ("2026-02-10", "Ромашка", 400000, 0), ("2026-02-10", "Ромашка", 400000, 0), ("2026-02-10", "Ромашка", 400000, 0), ("2026-02-11", "Ромашка", 400000, 0), ("2026-03-01", "Прочий", 100000, 2000000)):
        b -= debit + hidden
        rows.append((date, party, "оплата", None, debit, b))
    rows.append(("ИТОГО", None, None, None, 1000000, None))
    many = [(f"2026-01-{d:02d}", "Ромашка", "оплата", None, 10 + d, None) for d in range(1, 29)]
    got = {x.sheet: x for x in R.reports(sheet(spark, "Обороты", 5, rows).unionByName(sheet(spark, "S", 2, many)), STATEMENT, "statement").collect()}
    r, s = got["Обороты"], got["S"]
    assert (r.turnover.operations, r.turnover.debit_total, r.turnover.period_from, r.turnover.period_to) == (6, 2_000_000.0, day("2026-02-03"), day("2026-03-01"))
    assert r.balance_check.checked and r.balance_check.coverage == 1.0 and [(x["rows"], x.gap) for x in r.balance_check.breaks] == [([9, 10], -2_000_000.0)]
    assert [(x.party, x["rows"], x["count"], x.total) for x in r.splitting] == [("Ромашка", [6, 7, 8, 9], 4, 1_600_000.0)]
    assert [(x.party, x.debit_total, x.operations, x["rows"]) for x in r.top_parties] == [("Ромашка", 1_600_000.0, 4, [6, 7, 8, 9]), ("Поставщик", 300_000.0, 1, [5]), ("Прочий", 100_000.0, 1, [10])]
    assert not r.duplicates and not r.date_gaps and (r.stated.row, r.stated.debit) == (11, 1_000_000.0) and r.errors == 2
    assert [(x.operations, x["rows"]) for x in s.top_parties] == [(28, [2, 3, 4, 5, 6])] and s.splitting[0]["rows"] == [2, 3, 4]
    assert s.balance_check.skipped_reason == "few-balances" and not s.balance_check.breaks


def test_payments_report(spark):
    r = R.reports(sheet(spark, "P", 2, PAID), PAYMENTS, "payments", anchor="2026-06-15").first()
    assert r.anchor == day("2026-06-15") and r.bounds["1m"] == day("2026-05-15") and r.bounds["3y"] == day("2023-06-15")
    assert [(x.band, x["count"]) for x in r.by_band] == [("1m", 2), ("6m", 1), ("3y", 1), ("outside", 1)]
    assert [(x.period, x["count"], x.total) for x in r.cumulative] == [("1m", 2, 1.7e6), ("6m", 3, 3.7e6), ("1y", 3, 3.7e6), ("3y", 4, 8.7e6)]
    assert [(x.row, x.band, x.border, x.border_days) for x in r.payments] == [(2, "1m", None, None), (3, "1m", "1m", 1), (4, "6m", None, None), (5, "3y", None, None), (6, "outside", None, None)]
    assert (r.stats.rows_total, r.stats.rows_used, r.stats.rows_skipped) == (5, 5, 0)
    bare = R.reports(sheet(spark, "P", 2, PAID), PAYMENTS, "payments").first()
    assert bare.anchor is None and bare.bounds is None and bare.by_band == [] and bare.errors == 1


def test_registry_report(spark, tmp_path):
    head = ["Кредитор", "ИНН", "Очередь", "Основной долг", "Неустойка"]
    rows = [("Наш клиент", "7701111111", "третья", 50000000, 10000000), ("Банк (ПАО)", "7702222222", "третья", 120000000, 0), ("ФНС России", "7703333333", "третья", 30000000, 5000000), ("Работники", None, "вторая", 3000000, 0), ("Банк (ООО)", "7702222222", "третья", 20000000, 0)]
    df = R.reports(sheet(spark, "R", 2, rows), head, "registry", our="наш клиент")
    r = df.first()
    assert (r.creditors_count, r.total, r.share.share_percent, r.our_rows) == (5, 223_000_000.0, 22.73, [2])
    assert sorted((x.queue, x["count"], x.total, x.penalty) for x in r.queues) == [("втор", 1, 3e6, 0.0), ("трет", 4, 2.2e8, 1.5e7)]
    assert [f.code for f in r.findings if f.severity == "warn"] == ["creditor-duplicate"]
    R.write_reports(df, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").first().share.share_percent == 22.73
