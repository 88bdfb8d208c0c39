"""Dated payments against nested look-back periods before an anchor date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import months_back

#: The periods by name and months; their order from the nearest outwards.
PERIODS = {"1m": 1, "6m": 6, "1y": 12, "3y": 36}
BANDS = ("after", *PERIODS, "outside")
ARTICLES = {"after": "61.3-2/61.2", "1m": "61.3-2", "6m": "61.3-3", "1y": "61.2-1", "3y": "61.2-2", "outside": "10/168"}
BORDER_DAYS = 5


def bounds(anchor) -> dict[str, Column]:
    return {k: months_back(anchor, n) for k, n in PERIODS.items()}


def band(date: Column, anchor) -> Column:
    """The innermost period: a when chain, so no range join. Null without a date or an anchor."""
    anchor = F.col(anchor) if isinstance(anchor, str) else anchor
    out = F.when(date >= anchor, "after")
    for k, b in bounds(anchor).items():
        out = out.when(date >= b, k)
    return F.when(date.isNotNull() & anchor.isNotNull(), out.otherwise("outside"))


def classify(payments: DataFrame, anchor, date: str = "date") -> DataFrame:
    """Adds band, article and depth (0 for after, up to 5 for outside)."""
    pairs = F.create_map(*[x for i, k in enumerate(BANDS) for x in (F.lit(k), F.struct(F.lit(ARTICLES[k]).alias("a"), F.lit(i).alias("d")))])
    rows = payments.withColumn("band", band(F.col(date), anchor))
    return rows.withColumn("article", pairs[F.col("band")]["a"]).withColumn("depth", pairs[F.col("band")]["d"])


def by_band(classified: DataFrame, keys: list[str], amount: str = "amount") -> DataFrame:
    total = F.sum(F.col(amount).cast("decimal(18,2)")).cast("double")
    return classified.where("band is not null").groupBy(*keys, "band", "article", "depth").agg(F.count("*").alias("n"), total.alias("total"))


def cumulative(bands: DataFrame, keys: list[str]) -> DataFrame:
    """Nested totals: a row for each period and key that has anything in it or nearer; «after» counts in all."""
    depths = F.explode(F.sequence(F.greatest("depth", F.lit(1)), F.lit(4)))
    inner = bands.where("depth <= 4").withColumn("within", depths)
    name = F.element_at(F.array(*[F.lit(k) for k in PERIODS]), F.col("within"))
    total = F.sum(F.col("total").cast("decimal(28,2)")).cast("double")
    return inner.groupBy(*keys, "within").agg(F.sum("n").alias("n"), total.alias("total")).withColumn("period", name).drop("within")


def near_border(payments: DataFrame, anchor, days: int = BORDER_DAYS, date: str = "date") -> DataFrame:
    """A row for each payment and period bound at most `days` apart (the anchor itself is no bound)."""
    anchor = F.col(anchor) if isinstance(anchor, str) else anchor
    each = F.array(*[F.struct(F.lit(k).alias("bound"), b.alias("bound_date"), F.abs(F.datediff(F.col(date), b)).alias("days")) for k, b in bounds(anchor).items()])
    near = F.filter(each, lambda x: x["days"] <= days)
    return payments.withColumn("near", F.explode(near)).select(*payments.columns, "near.*")


def easiest(bands: DataFrame, keys: list[str]) -> DataFrame:
    """What falls into the easiest ground: a month before the anchor, and after it."""
    total = F.sum(F.col("total").cast("decimal(28,2)")).cast("double")
    return bands.where(F.col("band").isin("after", "1m")).groupBy(*keys).agg(F.sum("n").alias("n"), total.alias("total"))


def names_by_id(rows: DataFrame, keys: list[str], inn: str = "inn", party: str = "party") -> DataFrame:
    """Ids that occur with more than one name. Distinct first, so a frequent id costs its distinct names."""
    names = rows.where((F.col(inn) != "") & (F.col(party) != "")).select(*keys, inn, party).distinct()
    return names.groupBy(*keys, inn).agg(F.count("*").alias("n_names"), F.array_sort(F.collect_list(party)).alias("names")).where("n_names > 1")


def skipped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of rows used and of non-empty rows without a date or amount."""
    used = F.col("date").isNotNull() & F.col("amount").isNotNull()
    return rows.groupBy(*keys).agg(F.count("*").alias("rows_total"), F.count_if(used & ~F.col("is_total")).alias("rows_used"), F.count_if(~used & ~F.col("is_total") & ~F.col("is_empty")).alias("rows_skipped"))

