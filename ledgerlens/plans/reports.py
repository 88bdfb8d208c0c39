"""Whole reports: one nested record for each sheet, by profile.

A record holds figures of the whole sheet, and lists for a reader. Lists hold at most `most` entries each (the reference's own
lists are cut at 50 and less), beside their whole counts; every row is in the relations that they are taken from. Lists are
gathered from rows already limited in each task, and joined by (file, sheet). Typed rows and findings are written once, as all
parts of a record read them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.kept import kept
from ledgerlens.operators import debt, payments, register, statement
from ledgerlens.operators.samples import first_of

from . import profiles
from .profiles import KEYS, typed

#: How many entries the lists of a report hold.
LISTED, FIRST_ROWS = 50, 5


def _letter(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def _columns(columns: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for r, i in sorted(columns.items()) for x in (r, _letter(i))]).alias("columns")


def _assembled(sheets: DataFrame, profile: str, columns: dict[str, int], parts: list[DataFrame], findings: DataFrame, most: int) -> DataFrame:
    """The parts by sheet, with its columns, counts of findings by severity and the first findings."""
    f = findings.groupBy(*KEYS).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"), F.count("*").alias("n_findings"))
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    shown = first_of(findings, KEYS, [rank, "code", "message"], most, F.struct("code", "severity", "message", "cells", "numbers"), "findings")
    base = sheets.select(*KEYS).distinct().withColumn("profile", F.lit(profile)).withColumn("columns", _columns(columns))
    out = reduce(lambda a, b: a.join(kept(b), KEYS, "left"), [*parts, f, shown], kept(base))
    return out.fillna(0, ["errors", "warnings", "n_findings"])


def _none_where_null(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.coalesce(n, F.array().cast(df.schema[n].dataType)))
    return df


def debt_report(sheets: DataFrame, columns: dict[str, int], findings: DataFrame, most: int) -> DataFrame:
    rows = kept(typed(sheets, columns, "debt"))
    data = kept(debt.scaled_rates(rows.where("base is not null and amount is not null and not is_total"), KEYS))
    chosen = kept(debt.choose_model(debt.model_scores(data, KEYS), KEYS))
    conventions = debt.day_convention(data, KEYS)
    bad = debt.row_errors(data, chosen, KEYS).select(*KEYS, "row_no").unionByName(debt.day_errors(data, conventions, KEYS).where("convention is not null").select(*KEYS, "row_no")).distinct()
    marked = data.join(bad.withColumn("bad", F.lit(True)), [*KEYS, "row_no"], "left")
    row = F.struct(F.col("row_no").alias("row"), "base", "rate", "days", "amount", "date_from", "date_to", F.col("bad").isNull().alias("ok"))
    p = debt.periods(data, KEYS)
    pair = F.struct(F.array("prev_row", "row_no").alias("rows"), "days")
    spans = data.where("date_from is not null and date_to is not null").groupBy(*KEYS).agg((F.count("*") >= 2).alias("periods_checked"))
    t = debt.totals(data, rows.where("is_total"), KEYS).select(*KEYS, F.struct("rows_sum", F.col("stated").alias("stated_total"), F.col("stated_row").alias("stated_total_row"), "delta").alias("totals"))
    rates = data.where("rate is not null")
    parts = [
        chosen.select(*KEYS, F.struct("model", "matched", "total", "accepted").alias("formula")),
        data.groupBy(*KEYS).agg(F.count("*").alias("n_rows")), first_of(marked, KEYS, ["row_no"], most, row, "rows"),
        spans, first_of(p.where("kind = 'overlap'"), KEYS, ["row_no"], most, pair, "overlaps"), first_of(p.where("kind = 'gap'"), KEYS, ["row_no"], most, pair, "gaps"),
        t, first_of(rates, KEYS, ["row_no"], most, F.struct(F.col("row_no").alias("row"), "rate", "date_from", "date_to"), "rates"),
    ]
    out = _none_where_null(_assembled(sheets, "debt", columns, parts, findings, most), "rows", "overlaps", "gaps", "rates", "findings")
    return out.withColumn("periods", F.struct(F.coalesce("periods_checked", F.lit(False)).alias("checked"), "overlaps", "gaps")).drop("periods_checked", "overlaps", "gaps")


def split_rows(ops: DataFrame, groups: DataFrame, keys: list[str], most: int) -> DataFrame:
    """groups with the first rows of each: groups span few days, so their rows are found by day."""
    days = groups.select(*keys, "party", "date_from", F.explode(F.sequence("date_from", "date_to")).alias("date"))
    mine = ops.where("debit <> 0").select(*keys, "party", "date", "row_no").join(days, [*keys, "party", "date"])
    return groups.join(first_of(mine, [*keys, "party", "date_from"], ["date", "row_no"], most, F.col("row_no"), "rows"), [*keys, "party", "date_from"], "left")


def party_rows(ops: DataFrame, top: DataFrame, keys: list[str], k: int = FIRST_ROWS) -> DataFrame:
    """The leading parties with the first rows of each."""
    paid = ops.where("debit <> 0 and party <> '' and date is not null")
    return top.join(first_of(paid.join(top.select(*keys, "party"), [*keys, "party"], "left_semi"), [*keys, "party"], ["date", "row_no"], k, F.col("row_no"), "rows"), [*keys, "party"], "left")


def statement_report(sheets: DataFrame, columns: dict[str, int], findings: DataFrame, most: int) -> DataFrame:
    rows = kept(typed(sheets, columns, "statement"))
    ops = rows.where("not is_total and (date is not null or debit is not null or credit is not null)")
    turnover = statement.turnover(ops, KEYS)
    state = kept(statement.balance_state(ops, KEYS))
    breaks = statement.balance_breaks(ops, KEYS).join(state.where("skipped_reason is null").select(*KEYS), KEYS, "left_semi")
    groups = kept(statement.split_groups(ops, KEYS))
    pairs = statement.duplicates(ops, KEYS, statement.in_split(ops, groups, KEYS)).where("not suppressed")
    gaps = statement.date_gaps(ops, KEYS).join(state.where("skipped_reason is not null").select(*KEYS), KEYS, "left_semi")
    split = F.struct("party", "rows", F.col("n").alias("count"), "total", F.col("date_from").alias("from"), F.col("date_to").alias("to"))
    parts = [
        turnover.select(*KEYS, F.struct("operations", "credit_total", "debit_total", "period_from", "period_to").alias("turnover")),
        state.select(*KEYS, F.col("skipped_reason").isNull().alias("checked"), "coverage", "skipped_reason"),
        first_of(breaks, KEYS, ["row_no"], most, F.struct(F.array("prev_row", "row_no").alias("rows"), "expected", F.col("balance").alias("stated"), "gap"), "breaks"),
        first_of(pairs, KEYS, ["row_no"], most, F.struct(F.array("first_row", "row_no").alias("rows"), F.coalesce(F.when(F.col("debit") != 0, F.col("debit")), F.col("credit")).alias("amount"), "party"), "duplicates"),
        first_of(split_rows(ops, groups, KEYS, most), KEYS, ["date_from", "party"], most, split, "splitting"),
        first_of(party_rows(ops, statement.top_parties(ops, KEYS), KEYS), KEYS, ["rank"], statement.TOP, F.struct("party", "debit_total", "operations", "rows"), "top_parties"),
        first_of(gaps, KEYS, ["row_no"], most, F.struct(F.array("prev_row", "row_no").alias("rows"), "days"), "date_gaps"),
        rows.where("is_total").groupBy(*KEYS).agg(F.max_by(F.struct(F.col("row_no").alias("row"), "debit", "credit"), "row_no").alias("stated")),
    ]
    out = _none_where_null(_assembled(sheets, "statement", columns, parts, findings, most), "breaks", "duplicates", "splitting", "top_parties", "date_gaps", "findings")
    return out.withColumn("balance_check", F.struct("checked", "breaks", "coverage", "skipped_reason")).drop("checked", "breaks", "coverage", "skipped_reason")


def payments_report(sheets: DataFrame, columns: dict[str, int], findings: DataFrame, most: int, anchor: str | None) -> DataFrame:
    rows = kept(typed(sheets, columns, "payments"))
    used = rows.where("not is_total and date is not null and amount is not null")
    at = F.lit(anchor).cast("date")
    dealt = payments.classify(used, at)
    bands = kept(payments.by_band(dealt, KEYS))
    entries = lambda df, order, what: df.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*what).alias("what")))), lambda x: x["what"]))
    six = entries(bands, "depth", ["band", "article", F.col("n").alias("count"), "total"])  # at most one entry a band
    four = entries(payments.cumulative(bands, KEYS).withColumn("depth", F.array_position(F.array(*[F.lit(k) for k in payments.PERIODS]), F.col("period"))), "depth", ["period", F.col("n").alias("count"), "total"])
    near = payments.near_border(used, at).groupBy(*KEYS, "row_no").agg(F.min(F.struct("days", "bound")).alias("near"))
    each = dealt.join(near, [*KEYS, "row_no"], "left")
    parts = [
        payments.skipped(rows, KEYS).select(*KEYS, F.struct("rows_total", "rows_used", "rows_skipped").alias("stats")),
        six.toDF(*KEYS, "by_band"), four.toDF(*KEYS, "cumulative"),
        first_of(each, KEYS, ["row_no"], most, F.struct(F.col("row_no").alias("row"), "date", "party", "inn", "amount", "band", "article", F.col("near.bound").alias("border"), F.col("near.days").alias("border_days")), "payments"),
    ]
    out = _none_where_null(_assembled(sheets, "payments", columns, parts, findings, most), "by_band", "cumulative", "payments", "findings")
    limits = F.struct(*[b.alias(k) for k, b in payments.bounds(at).items()])
    return out.withColumn("anchor", at).withColumn("bounds", F.when(at.isNotNull(), limits))


def registry_report(sheets: DataFrame, columns: dict[str, int], findings: DataFrame, most: int, our: str | None, principal: bool) -> DataFrame:
    rows = kept(typed(sheets, columns, "registry"))
    creditors = rows.where("not is_total and (amount is not null or party <> '')")
    queues = register.queue_totals(creditors, KEYS)  # a handful of queues a sheet
    named = queues.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("queue", F.lit("")).alias("queue"), F.col("n").alias("count"), "total", "penalty"))), lambda x: x).alias("queues"))
    sums = queues.groupBy(*KEYS).agg(F.sum("n").alias("creditors_count"), F.sum(F.col("total").cast("decimal(28,2)")).cast("double").alias("total"))
    stated = debt.totals(creditors, rows.where("is_total"), KEYS, "first").select(*KEYS, F.struct(F.col("stated").alias("stated_total"), F.col("stated_row").alias("stated_total_row")).alias("totals"))
    parts = [sums, named, stated]
    if our:
        mine = F.lower("party").contains(our.strip().lower()) | (F.col("inn") == our.strip().lower())
        v = register.voting_share(creditors, KEYS, mine, deduct_penalty="penalty" in columns and not principal)
        parts += [v.select(*KEYS, F.struct("our_total", "voting_base", "our_voting_amount", "share_percent", "reason").alias("share")), first_of(creditors.where(mine), KEYS, ["row_no"], most, F.col("row_no"), "our_rows")]
    return _none_where_null(_assembled(sheets, "registry", columns, parts, findings, most), "queues", "findings")


def reports(sheets: DataFrame, header: list[str], profile: str, anchor: str | None = None, our: str | None = None, most: int = LISTED) -> DataFrame:
    """One record for each sheet of those that share a header: (file, sheet, profile, columns, ..., errors, warnings, n_findings,
    findings), with the parts of its profile."""
    findings = kept(profiles.analyze(sheets, header, profile, anchor, our))
    columns = profiles.bound(sheets, header, profile)
    if profile == "debt":
        return debt_report(sheets, columns, findings, most)
    if profile == "statement":
        return statement_report(sheets, columns, findings, most)
    if profile == "payments":
        return payments_report(sheets, columns, findings, most, anchor)
    return registry_report(sheets, columns, findings, most, our, profiles.is_principal(header, columns))


def write_reports(records: DataFrame, path: str) -> None:
    """Reports as JSON, one line a sheet, in folders by profile."""
    records.write.mode("overwrite").partitionBy("profile").json(path)
