"""Functions of other dialects as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_bin(seconds: int, ts: Column, origin: str = "1970-01-01 00:00:00") -> Column:
    """Start of the interval of ``seconds`` from ``origin`` that holds a timestamp without zone."""
    zero = F.lit(origin).cast("timestamp_ntz")
    gap = F.timestamp_diff("SECOND", zero, ts)
    whole = F.floor(gap / F.lit(seconds)) * F.lit(seconds)
    return F.timestamp_add("SECOND", whole.cast("int"), zero).cast("timestamp_ntz")


def trunc(x: Column) -> Column:
    """Towards zero."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by 96 Euclidean steps, enough for any two longs."""
    start = F.struct(F.abs(a).cast("bigint").alias("a"), F.abs(b).cast("bigint").alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("bigint")).otherwise(s["a"] % F.when(s["b"] != 0, s["b"])).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(96)), start, step, lambda s: s["a"])


def lcm(a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), F.lit(0).cast("bigint")).otherwise(F.abs(a * b) / gcd(a, b)).cast("bigint")


def strpos(text: Column, part: Column) -> Column:
    return F.locate(part, text) if isinstance(part, str) else F.position(part, text)
