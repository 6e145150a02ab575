"""Bounded profiles of groups: the first distinct values in order, without collecting the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_distinct(rows: DataFrame, keys: list[str], value: str, order: str | Column, k: int, name: str) -> DataFrame:
    """keys and `name`: at most k distinct values of each group, in the order in which they first appear (ties by value). Nulls are skipped.

    The first place of each value is a minimum, so repeats fold before the shuffle; ranks are cut at k before theirs, and only k values meet.
    """
    place = F.col(order) if isinstance(order, str) else order
    first = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.min(place).alias("_at"))
    ranked = first.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_at", "_v"))).where(F.col("_n") <= k)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_v"))), lambda x: x["_v"])
    return ranked.groupBy(*keys).agg(listed.alias(name))
