"""Windows over event time and state per key, on batches and on streams alike.

Watermarks bound the state: rows later than ``late`` behind the newest time seen are
dropped by a stream, and windows are settled once the watermark has passed their end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Unsupported


def _timed(rows: DataFrame, time: str, late: str | None) -> DataFrame:
    """Event time as an instant of the session's zone, which Spark's windows and watermarks take."""
    if dict(rows.dtypes)[time] != "timestamp":
        rows = rows.withColumn(time, F.col(time).cast("timestamp"))
    return rows.withWatermark(time, late) if late else rows


def _plain(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz")


def windowed(rows: DataFrame, time: str, size: str, keys: list[str], aggs: list[Column], slide: str | None = None, late: str | None = None) -> DataFrame:
    """Aggregates by tumbling windows of ``size`` (with ``slide`` sliding ones): ``start, end``, keys and aggregates."""
    at = F.window(time, size, slide) if slide else F.window(time, size)
    out = _timed(rows, time, late).groupBy(at.alias("w"), *keys).agg(*aggs)
    return out.select(_plain("w.start").alias("start"), _plain("w.end").alias("end"), *[c for c in out.columns if c != "w"])


def sessions(rows: DataFrame, time: str, gap: str, keys: list[str], aggs: list[Column], late: str | None = None) -> DataFrame:
    """Aggregates by sessions: rows of a key less than ``gap`` apart."""
    out = _timed(rows, time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggs)
    return out.select(_plain("w.start").alias("start"), _plain("w.end").alias("end"), *[c for c in out.columns if c != "w"])


def running(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the rows so far and the largest value, kept as state: ``key, n, last`` whenever a key gets rows."""
    if not stream.isStreaming:
        return stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("last"))

    def update(key_: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, None)
        for p in parts:
            n += len(p)
            top = p[value].max()
            if not pd.isna(top):
                last = int(top) if last is None else max(last, int(top))
        state.update((n, last))
        yield pd.DataFrame({key: [key_[0]], "n": [n], "last": [last]})

    kind = dict(stream.dtypes)[key]
    return stream.select(key, value).groupBy(key).applyInPandasWithState(update, f"`{key}` {kind}, n bigint, last bigint", "n bigint, last bigint", "update", "NoTimeout")


def settled(stream: DataFrame, path: str, keys: list[str], mode: str = "update") -> DataFrame:
    """Run a stream over what is there now and give the last row of each key.

    Every micro-batch is written under its number, so one that is run again after a failure
    replaces itself; the newest number of a key wins.
    """
    if not stream.isStreaming:
        raise Unsupported("settled() takes a stream")
    out = f"{path}/out"

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(store).trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.option("recursiveFileLookup", "true").parquet(out)
    others = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "__batch").alias("r"))
    return last.select(*keys, "r.*")
