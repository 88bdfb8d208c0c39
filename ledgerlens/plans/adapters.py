"""Profile-shaped relations over the star-schema tables, so that every operator runs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import cents

ANCHOR = "1998-01-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one task sorts at a time where a plan is dealt by spread().
ROWS_A_TASK = 500_000


def spread(spark: SparkSession, rows: int) -> int | None:
    """Partitions for so many rows, so that a task's share does not grow with the table; None where the session's number does."""
    need = -(-rows // ROWS_A_TASK)
    return need if need > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, parts: int | None, key: str) -> DataFrame:
    return df.repartition(parts, key) if parts else df.repartition(key)


def payments(spark, d):
    o = read(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("row_no"), F.col("o_custkey").alias("party"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("amount"))


def statement(spark, d):
    """Events as operations of accounts of five users each: purchases and the like credit, errors debit."""
    e = read(spark, d, "events")
    debit = F.when(F.col("event_type").isin("error", "click"), F.col("value"))
    return e.select(F.floor(F.col("user_id") / 5).alias("account"), F.col("event_id").alias("row_no"), F.col("ts").cast("date").alias("date"), F.when(debit.isNull(), F.col("value")).alias("credit"), debit.alias("debit"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("party"))


def with_balance(ops):
    """A running balance by account, with a planted gap of 100 000 after every 997th row."""
    from pyspark.sql import Window

    move = (F.coalesce("credit", F.lit(0.0)) - F.coalesce("debit", F.lit(0.0))).cast("decimal(18,2)")
    gap = F.when(F.col("row_no") % 997 == 0, F.lit(100000)).otherwise(F.lit(0)).cast("decimal(18,2)")
    w = Window.partitionBy("account").orderBy("row_no")
    return ops.withColumn("balance", F.sum(move + gap).over(w).cast("double"))


def accruals(spark, d):
    """Line items as accrual rows of a supplier's schedule; the amount follows one of three models, and
    rows numbered 7 are off."""
    li = read(spark, d, "lineitem")
    base, rate, days = F.col("l_extendedprice"), F.round(F.col("l_tax") * 100 + 5, 2), F.col("l_quantity")
    model = F.col("l_suppkey") % 3
    clean = base * (rate / 100.0) * days
    amount = F.when(model == 0, clean / 365.0).when(model == 1, clean).otherwise(clean / 300.0)
    planted = cents(amount) + F.when(F.col("l_linenumber") == 7, F.lit(5000.0)).otherwise(F.lit(0.0))
    start = F.col("l_shipdate").cast("date")
    to = F.date_add(start, days.cast("int") - F.when(F.col("l_linenumber") == 6, 0).otherwise(1))
    return li.select(F.col("l_suppkey").alias("sheet"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"), F.col("l_partkey").alias("part"), base.alias("base"), rate.alias("rate"), days.alias("days"), planted.alias("amount"), start.alias("date_from"), to.alias("date_to"))


ACCRUALS_SQL = """SELECT l_suppkey AS sheet, l_orderkey * 10 + l_linenumber AS row_no, l_partkey AS part, l_extendedprice AS base,
 ROUND(l_tax * 100 + 5, 2) AS rate, l_quantity AS days,
 FLOOR((CASE l_suppkey % 3 WHEN 0 THEN l_extendedprice * (ROUND(l_tax * 100 + 5, 2) / 100.0::DOUBLE) * l_quantity / 365.0::DOUBLE
   WHEN 1 THEN l_extendedprice * (ROUND(l_tax * 100 + 5, 2) / 100.0::DOUBLE) * l_quantity
   ELSE l_extendedprice * (ROUND(l_tax * 100 + 5, 2) / 100.0::DOUBLE) * l_quantity / 300.0::DOUBLE END) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE + CASE WHEN l_linenumber = 7 THEN 5000.0::DOUBLE ELSE 0.0::DOUBLE END AS amount,
 CAST(l_shipdate AS DATE) AS date_from,
 CAST(CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT) - CASE WHEN l_linenumber = 6 THEN 0 ELSE 1 END AS DATE) AS date_to FROM lineitem"""

STATEMENT_SQL = """SELECT user_id // 5 AS account, event_id AS row_no, CAST(ts AS DATE) AS date,
 CASE WHEN event_type IN ('error', 'click') THEN NULL ELSE value END AS credit,
 CASE WHEN event_type IN ('error', 'click') THEN value END AS debit, 'u' || user_id AS party FROM events"""


def register(spark, d):
    """Customers as creditors: the queue is spelled by segment, a nation's creditors share a tax id."""
    c = read(spark, d, "customer")
    queue = F.when(F.col("c_mktsegment") == "BUILDING", "3").when(F.col("c_mktsegment") == "MACHINERY", "III").when(F.col("c_mktsegment") == "FURNITURE", "третья").when(F.col("c_mktsegment") == "HOUSEHOLD", "вторая").otherwise("")
    return c.select(F.lit(1).alias("sheet"), F.col("c_custkey").alias("row_no"), F.col("c_name").alias("party"), F.format_string("77%08d", F.col("c_custkey") % 1000).alias("inn"), queue.alias("queue_cell"), F.greatest("c_acctbal", F.lit(0.0)).alias("amount"), cents(F.greatest("c_acctbal", F.lit(0.0)) * 0.1).alias("penalty"))


REGISTER_SQL = """SELECT 1 AS sheet, c_custkey AS row_no, c_name AS party, printf('77%08d', c_custkey % 1000) AS inn,
 CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN 'трет' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'втор' ELSE 'не указана' END AS queue,
 GREATEST(c_acctbal, 0.0::DOUBLE) AS amount, FLOOR(GREATEST(c_acctbal, 0.0::DOUBLE) * 0.1::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS penalty FROM customer"""
