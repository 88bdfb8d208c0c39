"""The four table profiles over sheets, and their findings.

A sheet relation has a row a sheet row: (file, sheet, row_no, cells array<string>), row_no counted as in the file.
Sheets with the same header are one job: the header is bound to roles on the driver (a header is a short
list), the cells become typed columns in one projection, written once as every check reads them, and each check is a plan over
those columns keyed by (file, sheet). Findings of all checks are one long relation; a check that could not run says so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.functions.kept import kept
from ledgerlens.operators import debt, payments, register, statement

KEYS = ["file", "sheet"]
FINDING = "file string, sheet string, code string, severity string, message string, cells array<string>, numbers map<string,double>"

#: Marks of column roles in headers, in the order in which roles take columns.
MARKERS = {
    "debt": {
        "amount": ("пени", "неустойка", "сумма пени", "начислено", "к взысканию", "итого по строке", "сумма процентов", "размер пени", "проценты"),
        "base": ("сумма долга", "задолженность", "основной долг", "сумма задолж", "недоимка", "сумма основного", "остаток долга", "база", "долг"),
        "days": ("дней", "дни", "кол-во дней", "количество дней", "число дней", "период просрочки", "просрочка"),
        "rate": ("ставка", "ключевая", "рефинанс", "%", "процент годовых"),
        "date_from": ("дата с", "период с", "с даты", "дата начала", "начало периода", "начало", "дата от"),
        "date_to": ("дата по", "период по", "по дату", "дата окончания", "конец периода", "окончание", "конец"),
        "paid": ("оплачено", "погашено", "платеж", "платёж", "оплата", "внесено"),
    },
    "statement": {
        "date": ("дата", "дата операции", "дата проводки", "дата документа"),
        "debit": ("списание", "расход", "дебет", "по дебету", "уменьшение"),
        "credit": ("приход", "поступление", "кредит", "по кредиту", "зачисление", "увеличение"),
        "amount": ("сумма", "сумма операции", "сумма по операции"),
        "party": ("контрагент", "плательщик", "получатель", "наименование", "корреспондент", "бенефициар"),
        "inn": ("инн",),
        "purpose": ("назначение", "назначение платежа", "основание", "содержание операции"),
        "balance": ("остаток", "сальдо", "исходящий остаток", "баланс"),
    },
    "payments": {
        "date": ("дата", "дата платежа", "дата операции", "дата сделки"),
        "amount": ("сумма", "размер", "сумма платежа", "сумма сделки"),
        "party": ("контрагент", "получатель", "кредитор", "наименование", "сторона"),
        "inn": ("инн",),
        "purpose": ("назначение", "основание", "содержание", "предмет"),
        "affiliated": ("аффилирован", "заинтересован", "связанн"),
    },
    "registry": {
        "party": ("кредитор", "наименование", "заявитель", "фио"),
        "inn": ("инн",),
        "amount": ("сумма", "размер требования", "включено", "основной долг", "требование"),
        "queue": ("очередь", "очередность", "реестр"),
        "penalty": ("неустойка", "пени", "штраф", "финансовые санкции"),
        "date": ("дата", "определение", "дата включения"),
        "voting": ("голос", "голосующие", "% голосов"),
    },
}
#: Headers that must be equal, not contained.
EXACT = {"debt": {"date_from": ("с", "от", "с:"), "date_to": ("по", "по:")}}


def bind(header: list[str | None], profile: str) -> dict[str, int]:
    """Role -> column: roles in order, each takes the first free column that its marks name."""
    heads, found = [S.norm_header(h) for h in header], {}
    for role, marks in MARKERS[profile].items():
        exact = EXACT.get(profile, {}).get(role, ())
        free = (i for i, h in enumerate(heads) if h and i not in found.values() and (h in exact or any(m in h for m in marks)))
        if (i := next(free, None)) is not None:
            found[role] = i
    return found


def date_columns(sheets: DataFrame, width: int, third: bool) -> list[int]:
    """Columns in which dates prevail, from the values: over half of the non-empty cells, or a third of all rows."""
    cell = lambda i: F.get("cells", F.lit(i))
    counts = [x for i in range(width) for x in (F.count_if(S.parse_date(cell(i)).isNotNull()).alias(f"d{i}"), F.count_if(F.coalesce(F.trim(cell(i)), F.lit("")) != "").alias(f"n{i}"))]
    row = sheets.agg(F.count("*").alias("rows"), *counts).first()
    least = lambda i: max(2, (row["rows"] // 3) if third else row[f"n{i}"] // 2)
    return [i for i in range(width) if row[f"d{i}"] >= least(i)]


def typed(sheets: DataFrame, columns: dict[str, int], profile: str) -> DataFrame:
    """One projection: cells to typed roles, with the row's joined text and total mark."""
    text = lambda r: F.trim(F.get("cells", F.lit(columns[r]))) if r in columns else F.lit(None).cast("string")
    number, date = lambda r: S.parse_number(text(r)), lambda r: S.parse_date(text(r))
    joined = F.lower(F.array_join(F.filter("cells", lambda c: F.coalesce(F.trim(c), F.lit("")) != ""), " "))
    out = [*KEYS, "row_no", joined.alias("row_text"), S.is_total_row(joined, "register" if profile == "registry" else "calc").alias("is_total"), (joined == "").alias("is_empty")]
    numbers = {"debt": ("base", "rate", "days", "amount", "paid"), "statement": ("debit", "credit", "amount", "balance"), "payments": ("amount",), "registry": ("amount", "penalty")}[profile]
    dates = {"debt": ("date_from", "date_to")}.get(profile, ("date",))
    out += [number(r).alias(r) for r in numbers] + [date(r).alias(r) for r in dates]
    if profile in ("statement", "payments"):
        out += [S.resolve_party(text("party"), text("purpose")).alias("party"), F.coalesce(text("inn"), F.lit("")).alias("inn")]
    if profile == "registry":
        out += [F.coalesce(text("party"), F.lit("")).alias("party"), F.coalesce(text("inn"), F.lit("")).alias("inn"), S.parse_queue(text("queue"), joined).alias("queue")]
    rows = sheets.select(*out)
    if profile == "statement" and not {"debit", "credit"} <= columns.keys():
        rows = statement.signed_split(rows)
    return rows


def found(df: DataFrame, code: str, severity: str, message, cells: list[Column] = (), **numbers) -> DataFrame:
    pairs = [x for k, v in numbers.items() for x in (F.lit(k), (F.col(v) if isinstance(v, str) else v).cast("double"))]
    return df.select(*KEYS, F.lit(code).alias("code"), F.lit(severity).alias("severity"), (message if isinstance(message, Column) else F.lit(message)).alias("message"), (F.array(*cells) if cells else F.array().cast("array<string>")).alias("cells"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")).alias("numbers"))


def first_ten(df: DataFrame, order: str = "row_no", k: int = 10) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*KEYS).orderBy(order))).where(F.col("_k") <= k)


def _addr(columns: dict[str, int], role: str, row: str = "row_no") -> Column:
    return S.address("sheet", row, columns.get(role, 0))


def _missing(sheets: DataFrame, roles: list[str], severity: str) -> DataFrame:
    return found(sheets.select(*KEYS).distinct(), "columns-missing", severity, "roles without a column: " + ", ".join(roles))


def _totals(rows: DataFrame, columns: dict[str, int], which: str, many: bool) -> list[DataFrame]:
    data, total_rows = rows.where("not is_total and amount is not null"), rows.where("is_total")
    t = debt.totals(data, total_rows, KEYS, which)
    out = [found(t.where(F.col("stated").isNotNull() & ~S.close("stated", "rows_sum")), "total-mismatch", "error", F.concat(F.lit("stated "), S.money("stated"), F.lit(", rows "), S.money("rows_sum")), [S.address("sheet", "stated_row", columns["amount"])], stated="stated", rows_sum="rows_sum")]
    if many:
        n = total_rows.groupBy(*KEYS).agg(F.count("*").alias("n")).where("n > 1")
        out.append(found(n, "intermediate-totals", "info", "several total rows; the last one counts", n="n"))
    return out


def debt_findings(sheets: DataFrame, columns: dict[str, int]) -> list[DataFrame]:
    rows = kept(typed(sheets, columns, "debt"))
    data = debt.scaled_rates(rows.where("base is not null and amount is not null and not is_total"), KEYS)
    missing = [r for r in ("base", "rate", "days", "amount") if r not in columns]
    out = []
    if missing:
        out.append(_missing(sheets, missing, "error"))
    if "amount" not in columns or "base" not in columns:
        return out
    out.append(found(data.where("rescaled").select(*KEYS).distinct(), "rate-percent-format", "info", "rates kept as fractions were taken as per cent"))
    if not missing:
        chosen = debt.choose_model(debt.model_scores(data, KEYS), KEYS)
        out.append(found(chosen.where("not accepted and total >= 2"), "formula-unknown", "warn", F.concat(F.lit("no model fits; best: "), F.col("model")), matched="matched", rows="total"))
        errors = debt.row_errors(data, chosen, KEYS)
        out.append(found(errors, "row-arithmetic", "error", F.concat(F.lit("stated "), S.money("amount"), F.lit(", by formula "), S.money("expected")), [_addr(columns, "amount")], stated="amount", expected="expected", delta="delta"))
    if {"date_from", "date_to"} <= columns.keys():
        days = debt.day_errors(data, debt.day_convention(data, KEYS), KEYS)
        out.append(found(days.where("convention is not null"), "days-mismatch", "error", "days against the sheet's own convention", [_addr(columns, "days")], stated="stated", expected="expected"))
        out.append(found(days.where("convention is null"), "days-unverifiable", "warn", "no convention of counting days is confirmed", [_addr(columns, "days")], stated="stated"))
        p = debt.periods(data, KEYS)
        out.append(found(p.where("kind = 'overlap'"), "period-overlap", "error", "periods overlap", [_addr(columns, "date_to", "prev_row"), _addr(columns, "date_from")], overlap_days="days"))
        out.append(found(p.where("kind = 'gap'"), "period-gap", "info", "days between periods", [_addr(columns, "date_from")], gap_days="days"))
    out += _totals(rows.where("is_total or base is not null"), columns, "last", True)
    out.append(found(data.where("rate is not null").groupBy(*KEYS).agg(F.countDistinct("rate").alias("n")), "rates-to-verify", "info", "rates to hold against their publication", distinct_rates="n"))
    if "paid" in columns:
        out.append(found(data.where("paid <> 0").groupBy(*KEYS).agg(F.count("*").alias("n")), "partial-payments", "warn", "payments: check the order in which they were set off", n="n"))
    return out


def statement_findings(sheets: DataFrame, columns: dict[str, int]) -> list[DataFrame]:
    rows, out = kept(typed(sheets, columns, "statement")), []
    if "date" not in columns:
        out.append(_missing(sheets, ["date"], "warn"))
    if not ({"debit", "credit"} <= columns.keys() or "amount" in columns):
        out.append(_missing(sheets, ["debit", "credit", "amount"], "warn"))
    ops = rows.where("not is_total and (date is not null or debit is not null or credit is not null)")
    state = statement.balance_state(ops, KEYS)
    out.append(found(state.where("skipped_reason in ('low-coverage', 'descending')"), "balance-not-checked", "info", F.concat(F.lit("the chain of balances was not checked: "), F.col("skipped_reason")), coverage="coverage"))
    breaks = statement.balance_breaks(ops, KEYS).join(state.where("skipped_reason is null").select(*KEYS), KEYS, "left_semi")
    out.append(found(first_ten(breaks), "balance-break", "error", F.concat(F.lit("expected "), S.money("expected"), F.lit(", stated "), S.money("balance")), [_addr(columns, "balance")], expected="expected", stated="balance", gap="gap"))
    out.append(found(breaks.groupBy(*KEYS).agg(F.count("*").alias("n")).where("n > 10"), "balance-break-many", "error", "more breaks than shown", breaks="n"))
    groups = statement.split_groups(ops, KEYS)
    out.append(found(first_ten(groups, "date_from"), "payment-splitting", "warn", F.concat(F.col("party"), F.lit(": "), S.plural("n", "платёж", "платежа", "платежей"), F.lit(", "), S.money("total")), count="n", total="total"))
    pairs = statement.duplicates(ops, KEYS, statement.in_split(ops, groups, KEYS))
    shown = pairs.where("not suppressed")
    out.append(found(first_ten(shown), "duplicate-operation", "warn", "same date, amount and party", [_addr(columns, "date", "first_row"), _addr(columns, "date")]))
    out.append(found(shown.groupBy(*KEYS).agg(F.count("*").alias("n")).where("n > 10"), "duplicate-operation-many", "warn", "more repeats than shown", duplicates="n"))
    out.append(found(pairs.where("suppressed").groupBy(*KEYS).agg(F.count("*").alias("n")), "duplicate-in-splitting", "info", "repeats inside split groups are not flagged again", suppressed="n"))
    gaps = statement.date_gaps(ops, KEYS).join(state.where("skipped_reason is not null").select(*KEYS), KEYS, "left_semi")
    out.append(found(first_ten(gaps, k=5), "date-gap", "info", "no operations between two dates", [_addr(columns, "date")], gap_days="days"))
    n = rows.where("is_total").groupBy(*KEYS).agg(F.count("*").alias("n"))
    out.append(found(n.where("n > 1"), "intermediate-totals", "info", "several total rows; the last one counts", n="n"))
    turnover = statement.turnover(ops, KEYS)
    for role in ("debit", "credit"):
        if role in columns:
            last = rows.where("is_total").groupBy(*KEYS).agg(F.max_by(role, "row_no").alias("stated"), F.max("row_no").alias("row_no"))
            t = last.where("stated is not null").join(turnover.select(*KEYS, F.col(f"{role}_total").alias("computed")), KEYS)
            out.append(found(t.where(~S.close("stated", "computed")), "total-mismatch", "error", F.concat(F.lit(f"{role}: stated "), S.money("stated"), F.lit(", computed "), S.money("computed")), [_addr(columns, role)], stated="stated", computed="computed"))
    return out


def payments_findings(sheets: DataFrame, columns: dict[str, int], anchor: str | None) -> list[DataFrame]:
    missing, out = [r for r in ("date", "amount") if r not in columns], []
    if missing:
        out.append(_missing(sheets, missing, "error"))
    if anchor is None:
        out.append(found(sheets.select(*KEYS).distinct(), "anchor-missing", "error", "no anchor date: the periods were NOT computed"))
    rows = kept(typed(sheets, columns, "payments"))
    used = rows.where("not is_total and date is not null and amount is not null")
    if anchor is not None and not missing:
        at = F.lit(anchor).cast("date")
        bands = payments.by_band(payments.classify(used, at), KEYS)
        near = payments.near_border(used, at)
        out.append(found(near, "near-period-border", "warn", F.concat(F.lit("days to the bound of "), F.col("bound")), [_addr(columns, "date")], days_to_border="days"))
        out.append(found(bands.where("band = 'outside'"), "outside-periods", "info", "outside all periods", count="n", total="total"))
        out.append(found(payments.easiest(bands, KEYS), "easiest-composition", "info", "a month before the anchor, and after it", count="n", total="total"))
    if "inn" in columns:
        out.append(found(payments.names_by_id(used, KEYS), "inn-name-mismatch", "warn", F.concat(F.col("inn"), F.lit(": "), F.array_join("names", ", ")), names="n_names"))
    out.append(found(payments.skipped(rows, KEYS).where("rows_skipped > 0"), "rows-skipped", "warn", "rows without a date or an amount", rows_total="rows_total", rows_used="rows_used", rows_skipped="rows_skipped"))
    return out


def registry_findings(sheets: DataFrame, columns: dict[str, int], our: str | None, principal: bool) -> list[DataFrame]:
    out = []
    if "amount" not in columns:
        out.append(_missing(sheets, ["amount"], "warn"))
    rows = kept(typed(sheets, columns, "registry"))
    creditors = rows.where("not is_total and (amount is not null or party <> '')")
    if our:
        ours = F.lower("party").contains(our.strip().lower()) | (F.col("inn") == our.strip().lower())
        v = register.voting_share(creditors, KEYS, ours, deduct_penalty="penalty" in columns and not principal)
        severity = {"our-claim-missing": "error", "third-queue-missing": "warn", "voting-base-empty": "warn", "voting-base-negative": "warn"}
        out += [found(v.where(F.col("reason") == code), code, s, "no share was computed") for code, s in severity.items()]
        out.append(found(v.where("reason is null"), "voting-share", "info", "share of the third queue", share_percent="share_percent"))
    out.append(found(register.repeated(creditors, KEYS), "creditor-duplicate", "warn", F.concat(F.lit("tax id "), F.col("inn")), rows="n", total="total"))
    if "amount" in columns:
        out += _totals(rows, columns, "first", False)
    return out


def bound(sheets: DataFrame, header: list[str], profile: str) -> dict[str, int]:
    """bind(), with columns of dates told from the values where no header names them."""
    columns = bind(header, profile)
    if profile == "debt" and not {"date_from", "date_to"} <= columns.keys():
        dated = [i for i in date_columns(sheets, len(header), False)]
        columns |= {r: i for r, i in zip(("date_from", "date_to"), dated) if r not in columns}
    elif profile in ("statement", "payments") and "date" not in columns and (dated := date_columns(sheets, len(header), True)):
        columns["date"] = dated[0]
    return columns


def is_principal(header: list[str], columns: dict[str, int]) -> bool:
    """Whether the amounts of a registry are principal debts, without penalties."""
    head = S.norm_header(header[columns["amount"]]) if "amount" in columns else ""
    return "основн" in head or "тело" in head or ("долг" in head and "требован" not in head.split("долг", 1)[1])


def analyze(sheets: DataFrame, header: list[str], profile: str, anchor: str | None = None, our: str | None = None) -> DataFrame:
    """Findings of a profile over all sheets that share a header."""
    columns = bound(sheets, header, profile)
    if profile == "registry":
        parts = registry_findings(sheets, columns, our, is_principal(header, columns))
    else:
        run: dict[str, Callable] = {"debt": debt_findings, "statement": statement_findings, "payments": lambda s, c: payments_findings(s, c, anchor)}
        parts = run[profile](sheets, columns)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
