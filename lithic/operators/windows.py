"""Window forms that Spark's SQL doesn't parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over_groups(df: DataFrame, value: Column, name: str, partition_by: list[str], order_by: str, before: int, after: int) -> DataFrame:
    """``value`` over a GROUPS frame: whole peer groups, ``before`` to ``after`` around the current one."""
    rank = F.dense_rank().over(Window.partitionBy(*partition_by).orderBy(order_by))
    ranked = df.withColumn("__g", rank)
    return ranked.withColumn(name, value.over(Window.partitionBy(*partition_by).orderBy("__g").rangeBetween(-before, after))).drop("__g")


def qualify(df: DataFrame, condition: Column) -> DataFrame:
    """Keep rows by a condition over window functions."""
    return df.withColumn("__q", condition).where("__q").drop("__q")
