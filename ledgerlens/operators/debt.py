"""Accrual schedules: which formula fits, which rows break it, periods, day counts, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import cents, close, days_in_year

#: The models in order of preference, with their yearly divisor (None: see expected()).
MODELS = {"annual/by-row": None, "annual/actual": None, "annual/365": 365, "annual/366": 366, "annual/300": 300, "daily-percent": None, "daily-fraction": None}
LEAST_ROWS, SHARE = 2, 0.6


def expected(model: str, base: Column, rate: Column, days: Column, row_year_days: Column, anchor_days: Column) -> Column:
    share = base * (rate / 100.0) * days
    if model == "annual/by-row":
        return share / F.coalesce(row_year_days, anchor_days)
    if model == "annual/actual":
        return share / anchor_days
    if model == "daily-percent":
        return share
    if model == "daily-fraction":
        return base * rate * days
    return share / float(MODELS[model])


def scaled_rates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rates kept as fractions throughout a key (all of 0 < |r| < 1) as per cent; marks them in `rescaled`,
    and adds the key's anchor (date_from of its first dated row)."""
    r = F.abs(F.col("rate"))
    facts = rows.groupBy(*keys).agg(F.coalesce(F.bool_and(F.when(F.col("rate").isNotNull(), (r > 0) & (r < 1))), F.lit(False)).alias("rescaled"), F.min_by("date_from", F.when(F.col("date_from").isNotNull(), F.col("row_no"))).alias("anchor"), F.count("*").alias("key_rows"))
    out = rows.join(facts, keys)
    return out.withColumn("rate", F.when(F.col("rescaled"), F.col("rate") * 100.0).otherwise(F.col("rate")))


def _all_models(rows: DataFrame) -> Column:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    own, anchor = days_in_year("date_from"), days_in_year(F.coalesce("anchor", F.lit("2026-01-01").cast("date")))
    return F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(m).alias("model"), expected(m, F.col("base"), zero("rate"), zero("days"), own, anchor).alias("expected")) for i, m in enumerate(MODELS)])


def model_scores(rows: DataFrame, keys: list[str], abs_tol: float = 1.0, rel_tol: float | None = 0.005) -> DataFrame:
    """Rows that each model matches, from scaled_rates(); the sevenfold rows exist only before the partial sums."""
    each = rows.select(*keys, "amount", "key_rows", F.explode(_all_models(rows)).alias("m"))
    return each.groupBy(*keys, F.col("m.ord").alias("ord"), F.col("m.model").alias("model")).agg(F.count_if(close("m.expected", "amount", abs_tol, rel_tol)).alias("matched"), F.max("key_rows").alias("total"))


def choose_model(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The best model of a key and whether it is accepted (three fifths of the rows, of two at least)."""
    best = scores.groupBy(*keys).agg(F.max_by(F.struct("model", "matched", "total"), F.struct("matched", -F.col("ord"))).alias("b")).select(*keys, "b.*")
    ok = (F.col("matched") >= F.greatest(F.lit(1), F.floor(F.col("total") * SHARE))) & (F.col("total") >= LEAST_ROWS)
    return best.withColumn("accepted", ok)


def row_errors(rows: DataFrame, chosen: DataFrame, keys: list[str], abs_tol: float = 1.0, rel_tol: float | None = 0.005) -> DataFrame:
    """Rows off the accepted model of their key."""
    fits = rows.where("rate is not null and days is not null").join(chosen.where("accepted").select(*keys, "model"), keys)
    one = F.element_at(F.filter(_all_models(rows), lambda m: m["model"] == F.col("model")), 1)["expected"]
    return fits.withColumn("expected", one).where(~close("expected", "amount", abs_tol, rel_tol)).select(*keys, "row_no", "model", "amount", cents("expected").alias("expected"), cents(F.col("amount") - F.col("expected")).alias("delta"))


def day_convention(rows: DataFrame, keys: list[str]) -> DataFrame:
    incl, stated = F.datediff("date_to", "date_from") + 1, F.col("days").cast("int")
    good = rows.where("date_from is not null and date_to is not null and days is not null")
    s = good.groupBy(*keys).agg(F.count_if(stated == incl).alias("inclusive"), F.count_if(stated == incl - 1).alias("exclusive"), F.count_if((stated != incl) & (stated != incl - 1)).alias("other"))
    return s.withColumn("convention", F.when((F.col("inclusive") == 0) & (F.col("exclusive") == 0), F.lit(None).cast("string")).when(F.col("inclusive") >= F.col("exclusive"), "inclusive").otherwise("exclusive"))


def day_errors(rows: DataFrame, conventions: DataFrame, keys: list[str]) -> DataFrame:
    """Rows off their key's convention; without one, every row, as unverifiable."""
    good = rows.where("date_from is not null and date_to is not null and days is not null").join(conventions.select(*keys, "convention"), keys)
    incl, stated = F.datediff("date_to", "date_from") + 1, F.col("days").cast("int")
    want = F.when(F.col("convention") == "inclusive", incl).when(F.col("convention") == "exclusive", incl - 1)
    return good.withColumn("stated", stated).withColumn("expected", want).where(want.isNull() | (stated != want)).select(*keys, "row_no", "stated", "expected", incl.alias("by_dates"), "convention")


def periods(rows: DataFrame, keys: list[str], running: bool = False) -> DataFrame:
    """Overlaps and gaps against the period just before by start date; running: against the latest end so far."""
    w = Window.partitionBy(*keys).orderBy("date_from", "row_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    d = rows.where("date_from is not null and date_to is not null")
    d = d.withColumn("prev_row", F.max_by("row_no", F.struct("date_to", "row_no")).over(before) if running else F.lag("row_no").over(w)).withColumn("prev_to", F.max("date_to").over(before) if running else F.lag("date_to").over(w))
    apart = F.datediff("date_from", "prev_to")
    kind = F.when(apart <= 0, "overlap").when(apart > 1, "gap")
    return d.withColumn("kind", kind).where("kind is not null").select(*keys, "prev_row", "row_no", "kind", F.when(apart <= 0, 1 - apart).otherwise(apart - 1).alias("days"))


def totals(rows: DataFrame, total_rows: DataFrame, keys: list[str], which: str = "last") -> DataFrame:
    """Sum of rows against the stated total: the last (or first) total row with a figure."""
    pick = F.max_by if which == "last" else F.min_by
    stated = total_rows.where("amount is not null").groupBy(*keys).agg(pick("amount", "row_no").alias("stated"), pick("row_no", "row_no").alias("stated_row"), F.count("*").alias("n_totals"))
    s = rows.groupBy(*keys).agg(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("rows_sum"))
    return s.join(stated, keys, "left").withColumn("delta", F.round(F.col("stated") - F.col("rows_sum"), 2))


def checksums(rows: DataFrame, keys: list[str], levels: int = 2, tolerance: float = 0.005) -> DataFrame:
    """(keys, row_no, level, stated, units, below, state): a document's stated sums against its breakdown, level by level.
    rows: (keys, row_no, level, amount); level 0 are the units, and a row of a higher level states the sum of what stands since
    the last row of its level or a higher one. units is the sum of these units, below that of the sums stated one level
    lower (null where there are none). The state is agreed, units (the units do not add up to it), or below (the units do,
    the sums stated below do not, so one of these is wrong). Both figures are kept as they stand; nothing is smoothed.
    One sort of the rows serves all levels: sums run on over a document, and a stated row takes what they gained since the row
    before it that ended its stretch. Rows that come dealt by the keys are not dealt anew."""
    w = Window.partitionBy(*keys).orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    at, money = F.col("level"), F.col("amount").cast("decimal(18,2)")
    run = rows.where(at >= 0).select(*keys, "row_no", "level", money.alias("stated"))
    own = [F.when(at == i, F.col("stated")) for i in range(levels)]
    so_far = F.array(*[F.struct(F.coalesce(F.sum(x).over(w), F.lit(0).cast("decimal(28,2)")).alias("sum"), F.count(x).over(w).alias("n")) for x in own])
    run = run.withColumn("_now", so_far).where(at >= 1)
    # what a higher level ends, ends lower ones as well; the highest is ended by its own rows only
    ends = [at >= i if i < levels else at == i for i in range(1, levels + 1)]
    run = run.withColumn("_then", F.array(*[F.last(F.when(x, F.col("_now")), ignorenulls=True).over(w) for x in ends])).where(at <= levels)
    run = run.withColumn("_then", F.element_at("_then", at.cast("int")))

    def gained(i):
        now, then = F.element_at("_now", i), F.element_at("_then", i)
        return now["sum"] - F.coalesce(then["sum"], F.lit(0).cast("decimal(28,2)")), now["n"] - F.coalesce(then["n"], F.lit(0))

    below, n_below = gained(at.cast("int"))
    out = run.select(*keys, "row_no", "level", "stated", gained(F.lit(1))[0].alias("units"), F.when((at > 1) & (n_below > 0), below).alias("below"))
    off = lambda a: F.abs(F.col("stated") - F.col(a)) > tolerance
    state = F.when(off("units"), "units").when(F.col("below").isNotNull() & off("below"), "below").otherwise("agreed")
    return out.select(*keys, "row_no", at.cast("int").alias("level"), *[F.col(c).cast("double").alias(c) for c in ("stated", "units", "below")], state.alias("state"))


def split_by_rates(intervals: DataFrame, rates: DataFrame) -> DataFrame:
    """Each interval (date_from, date_to) cut at the rate changes inside it; rates(valid_from, valid_to, rate)
    is a published table of bounded length and is broadcast."""
    cond = (F.col("date_from") <= F.col("valid_to")) & (F.col("date_to") >= F.col("valid_from"))
    out = intervals.join(F.broadcast(rates), cond)
    return out.withColumn("part_from", F.greatest("date_from", "valid_from")).withColumn("part_to", F.least("date_to", "valid_to")).drop("valid_from", "valid_to")
