"""Claim registers: totals by queue, voting share, repeated creditors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_M = "decimal(18,2)"


def _sum(c):
    return F.coalesce(F.sum(F.col(c).cast(_M)), F.lit(0).cast(_M)).cast("double")


def queue_totals(creditors: DataFrame, keys: list[str]) -> DataFrame:
    return creditors.groupBy(*keys, "queue").agg(F.count("*").alias("n"), _sum("amount").alias("total"), _sum("penalty").alias("penalty"))


def voting_share(creditors: DataFrame, keys: list[str], ours, deduct_penalty: bool = True) -> DataFrame:
    """Our share of the third queue; penalties are deducted only if the amounts include them. One pass of
    conditional sums; reason says why there is no share."""
    third = F.col("queue") == "трет"
    s = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c).cast(_M))), F.lit(0).cast(_M)).cast("double")
    t = creditors.groupBy(*keys).agg(s(third, "amount").alias("_t"), s(third, "penalty").alias("_tp"), s(ours, "amount").alias("our_total"), s(ours, "penalty").alias("_op"), F.count_if(ours).alias("our_rows"))
    base = F.round(F.col("_t") - F.col("_tp") if deduct_penalty else F.col("_t"), 2)
    mine = F.round(F.col("our_total") - F.col("_op") if deduct_penalty else F.col("our_total"), 2)
    reason = F.when(F.col("our_rows") == 0, "our-claim-missing").when(F.col("_t") == 0, "third-queue-missing").when(base <= 0, "voting-base-empty").when(mine < 0, "voting-base-negative")
    return t.select(*keys, "our_rows", "our_total", base.alias("voting_base"), mine.alias("our_voting_amount"), reason.alias("reason")).withColumn("share_percent", F.when(F.col("reason").isNull(), F.round(F.col("our_voting_amount") / F.when(F.col("voting_base") != 0, F.col("voting_base")) * 100, 2)))


def repeated(creditors: DataFrame, keys: list[str], key: str = "inn") -> DataFrame:
    return creditors.where(F.col(key) != "").groupBy(*keys, key).agg(F.count("*").alias("n"), _sum("amount").alias("total"), F.min("row_no").alias("first_row")).where("n > 1")
