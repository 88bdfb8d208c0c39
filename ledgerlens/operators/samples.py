"""The first rows of groups, as bounded arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, keys: list[str], order: list, k: int, what: Column, name: str) -> DataFrame:
    """(keys, name): `what` of the first k rows of each key, in order. Tasks keep k rows a key before the shuffle (the limit on the
    row number is pushed below it), so no group is gathered beyond that."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    some = rows.withColumn("_n", n).where(F.col("_n") <= k)
    return some.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", what.alias("what"))), lambda a, b: a["_n"] - b["_n"]), lambda x: x["what"]).alias(name))
