"""As-of and range joins by equi-shuffles, never by comparing all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, take: list[str]) -> DataFrame:
    """Each left row with ``take`` of the last right row of its key that isn't later; null where there is none.

    Both sides are put in one order and the last right row is carried forward, one
    shuffle and sort by key and time.  ``take`` must not be columns of ``left``.
    """
    mine = left.select(F.col(by).alias("__k"), F.col(left_on).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType).alias("__found"))
    other = right.select(F.col(by).alias("__k"), F.col(right_on).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__row"), F.struct(*take).alias("__found"))
    order = Window.partitionBy("__k").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    carried = mine.unionByName(other).withColumn("__found", F.last("__found", ignorenulls=True).over(order))
    return carried.where("__side = 1").select("__row.*", *[F.col(f"__found.`{c}`").alias(c) for c in take])


def range_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: float) -> DataFrame:
    """Pairs with ``start <= at < end`` for numeric columns, joined on buckets of ``width``.

    A span is copied to each bucket it touches, so choose a width near the usual length of a span.
    """
    p = points.withColumn("__b", F.floor(F.col(at) / F.lit(width)))
    last = F.greatest(F.floor(F.col(start) / F.lit(width)), F.ceil(F.col(end) / F.lit(width)) - 1)
    s = spans.where(F.col(start) < F.col(end)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / F.lit(width)), last)))
    return p.join(s, "__b").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__b")
