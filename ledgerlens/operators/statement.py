"""Account statements: turnover, balance chain, split payments, duplicates, gaps.

Every window is partitioned by the statement's key; a row number carries the file order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import close

SPLIT_LEAST, SPLIT_DAYS, TOP = 3, 2, 10
_MONEY = "decimal(18,2)"


def _sum(c: str):
    return F.coalesce(F.sum(F.col(c).cast(_MONEY)), F.lit(0).cast(_MONEY)).cast("double")


def signed_split(rows: DataFrame, amount: str = "amount") -> DataFrame:
    """One signed column as debit and credit: negative is a debit."""
    a = F.col(amount)
    return rows.withColumn("debit", F.when(a < 0, -a)).withColumn("credit", F.when(a >= 0, a))


def turnover(ops: DataFrame, keys: list[str]) -> DataFrame:
    return ops.groupBy(*keys).agg(F.count("*").alias("operations"), _sum("credit").alias("credit_total"), _sum("debit").alias("debit_total"), F.min("date").alias("period_from"), F.max("date").alias("period_to"), F.round(F.avg(F.col("balance").isNotNull().cast("int")), 3).alias("coverage"))


def balance_state(ops: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the chain of balances can be checked, and why not."""
    w = Window.partitionBy(*keys).orderBy("row_no")
    dated = ops.withColumn("_before", F.max_by("date", F.when(F.col("date").isNotNull(), F.col("row_no"))).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    s = dated.groupBy(*keys).agg(F.count_if(F.col("balance").isNotNull()).alias("n_balance"), F.count("*").alias("n"), F.count("date").alias("n_dates"), F.coalesce(F.bool_and(F.col("date") <= F.col("_before")), F.lit(True)).alias("falling"))
    reason = F.when(F.col("n_balance") < 3, "few-balances").when(F.col("n_balance") / F.col("n") < 0.95, "low-coverage").when((F.col("n_dates") >= 3) & F.col("falling"), "descending")
    return s.select(*keys, F.round(F.col("n_balance") / F.col("n"), 3).alias("coverage"), reason.alias("skipped_reason"))


def balance_breaks(ops: DataFrame, keys: list[str], abs_tol: float = 1.0, rel_tol: float | None = 0.005, strict: bool = False) -> DataFrame:
    """Rows whose balance does not follow from the one before, among rows with a balance. strict: amounts
    of rows without a balance are carried along."""
    w = Window.partitionBy(*keys).orderBy("row_no")
    move = F.coalesce(F.col("credit"), F.lit(0.0)) - F.coalesce(F.col("debit"), F.lit(0.0))
    rows = ops.withColumn("_move", F.sum(move).over(w) if strict else move).where("balance is not null")
    rows = rows.withColumn("prev_row", F.lag("row_no").over(w)).withColumn("_prev", F.lag("balance").over(w))
    step = F.col("_move") - F.lag("_move").over(w) if strict else F.col("_move")
    rows = rows.withColumn("expected", F.col("_prev") + step)
    return rows.where(F.col("prev_row").isNotNull() & ~close("expected", "balance", abs_tol, rel_tol)).select(*keys, "prev_row", "row_no", F.round("expected", 2).alias("expected"), "balance", F.round(F.col("balance") - F.col("expected"), 2).alias("gap"))


def split_groups(ops: DataFrame, keys: list[str], least: int = SPLIT_LEAST, days: int = SPLIT_DAYS) -> DataFrame:
    """Greedy groups of `least` or more debits to one party within `days` of the first. Days are
    pre-aggregated (rows of one day are never parted by the greedy walk), so what one task folds for a
    party is its distinct days, however many rows it has."""
    by_day = ops.where("debit <> 0 and party <> '' and date is not null").groupBy(*keys, "party", "date").agg(F.count("*").alias("n"), F.sum(F.col("debit").cast(_MONEY)).alias("t"))
    series = by_day.groupBy(*keys, "party").agg(F.sort_array(F.collect_list(F.struct("date", "n", "t"))).alias("d"))
    group = "struct<first:date,last:date,n:bigint,total:decimal(28,2)>"
    # open: the days of the group being gathered. Where it turns out too small, its days that still lie
    # within reach of the next one stay.
    walk = F.expr(f"""aggregate(d, struct(cast(array() as array<{group}>) as done, cast(array() as array<struct<date:date,n:bigint,t:decimal(28,2)>>) as open),
      (a, x) -> case when size(a.open) = 0 or datediff(x.date, a.open[0].date) <= {days}
        then struct(a.done as done, array_append(a.open, named_struct('date', x.date, 'n', x.n, 't', cast(x.t as decimal(28,2)))) as open)
        when aggregate(a.open, 0L, (s, y) -> s + y.n) >= {least}
        then struct(array_append(a.done, named_struct('first', a.open[0].date, 'last', element_at(a.open, -1).date, 'n', aggregate(a.open, 0L, (s, y) -> s + y.n), 'total', aggregate(a.open, cast(0 as decimal(28,2)), (s, y) -> cast(s + y.t as decimal(28,2))))) as done, array(named_struct('date', x.date, 'n', x.n, 't', cast(x.t as decimal(28,2)))) as open)
        else struct(a.done as done, array_append(filter(a.open, y -> datediff(x.date, y.date) <= {days}), named_struct('date', x.date, 'n', x.n, 't', cast(x.t as decimal(28,2)))) as open) end,
      a -> case when aggregate(a.open, 0L, (s, y) -> s + y.n) >= {least} then array_append(a.done, named_struct('first', a.open[0].date, 'last', element_at(a.open, -1).date, 'n', aggregate(a.open, 0L, (s, y) -> s + y.n), 'total', aggregate(a.open, cast(0 as decimal(28,2)), (s, y) -> cast(s + y.t as decimal(28,2))))) else a.done end)""")
    out = series.select(*keys, "party", F.explode(walk).alias("g"))
    return out.select(*keys, "party", F.col("g.first").alias("date_from"), F.col("g.last").alias("date_to"), F.col("g.n").alias("n"), F.col("g.total").cast("double").alias("total"))


def in_split(ops: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row_no) of rows in a split group; a group spans few days, so it is joined by day."""
    days = groups.select(*keys, "party", F.explode(F.sequence("date_from", "date_to")).alias("date"))
    return ops.where("debit <> 0").join(days, [*keys, "party", "date"], "left_semi").select(*keys, "row_no")


def duplicates(ops: DataFrame, keys: list[str], split_rows: DataFrame | None = None) -> DataFrame:
    """Repeats of (date, debit, credit, party), each paired with the first; pairs inside split groups are
    marked suppressed."""
    same = [*keys, "date", "debit", "credit", "party"]
    good = ops.where("date is not null and party <> '' and (debit is not null or credit is not null)")
    first = good.groupBy(*same).agg(F.min("row_no").alias("first_row"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    cond = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in same]
    pairs = good.alias("a").join(first.alias("b"), cond).where("a.row_no <> b.first_row").select(*[F.col(f"a.{c}") for c in same], "b.first_row", "a.row_no")
    if split_rows is None:
        return pairs.withColumn("suppressed", F.lit(False))
    s = split_rows.select(*keys, F.col("row_no").alias("_s"))
    one = pairs.join(s.withColumn("_one", F.lit(True)).withColumnRenamed("_s", "row_no"), [*keys, "row_no"], "left")
    two = one.join(s.withColumn("_two", F.lit(True)).withColumnRenamed("_s", "first_row"), [*keys, "first_row"], "left")
    return two.withColumn("suppressed", F.coalesce(F.col("_one") & F.col("_two"), F.lit(False))).drop("_one", "_two")


def top_parties(ops: DataFrame, keys: list[str], k: int = TOP) -> DataFrame:
    """The k parties of a key with most debits, ties to the one seen first."""
    t = ops.where("debit <> 0 and party <> '' and date is not null").groupBy(*keys, "party").agg(_sum("debit").alias("debit_total"), F.count("*").alias("operations"), F.min("row_no").alias("first_row"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("debit_total"), "first_row"))
    return t.withColumn("rank", rank).where(F.col("rank") <= k)


def date_gaps(ops: DataFrame, keys: list[str], least: int = 31) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("date", "row_no")
    rows = ops.where("date is not null").withColumn("prev_date", F.lag("date").over(w)).withColumn("prev_row", F.lag("row_no").over(w))
    return rows.withColumn("days", F.datediff("date", "prev_date")).where(F.col("days") >= least).select(*keys, "prev_row", "row_no", "prev_date", "date", "days")
