"""Change streams: debounced sessions, last event per path, incremental apply, token buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def with_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a zoned timestamp."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def debounce(events: DataFrame, key: str, gap: str, late: str | None = None, column: str = "ts") -> DataFrame:
    """(key, first_at, last_at, events): bursts of events of a key that are less than `gap` apart; batch or stream."""
    e = with_time(events, column)
    if late is not None:
        e = e.withWatermark(column, late)
    s = e.groupBy(F.session_window(column, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("events"), F.min(column).alias("first_at"), F.max(column).alias("last_at"))
    return s.select(key, "first_at", "last_at", "events")


def last_event(events: DataFrame, keys: list[str], op: str, column: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last operation of every key; ties in time go to the greater tie column."""
    return events.groupBy(*keys).agg(F.max_by(op, F.struct(column, tie)).alias(op))


def windowed_counts(events: DataFrame, length: str, key: str, late: str | None = None, column: str = "ts") -> DataFrame:
    """(start, key, events, total): tumbling windows; late data beyond the watermark is left out on streams."""
    e = with_time(events, column)
    if late is not None:
        e = e.withWatermark(column, late)
    g = e.groupBy(F.window(column, length).alias("w"), key).agg(F.count(F.lit(1)).alias("events"))
    return g.select(F.col("w.start").alias("start"), key, "events")


def apply_changes(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands every micro-batch to `apply(batch, id)`, which must be idempotent per id."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def token_bucket(events: DataFrame, key: str, rate: float, burst: float, column: str = "ts", late: str = "1 minute") -> DataFrame:
    """(key, event_id, allowed) for every event of a stream: a bucket per key refills `rate` tokens a second up to `burst`.

    A key's state leaves once the watermark is past the time at which its bucket is full again: a full bucket is what a
    key without state has, so nothing is lost.
    """
    full = int(1000 * burst / rate) + 1

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, at = state.get if state.exists else (burst, None)
        for pdf in frames:
            pdf = pdf.sort_values([column, "event_id"])
            out = []
            for t, e in zip(pdf[column], pdf["event_id"], strict=True):
                now = t.timestamp()
                if at is not None:
                    tokens = min(burst, tokens + max(0.0, now - at) * rate)
                at = now if at is None else max(at, now)
                allowed = tokens >= 1
                tokens -= 1 if allowed else 0
                out.append((k[0], e, allowed))
            state.update((tokens, at))
            yield pd.DataFrame(out, columns=[key, "event_id", "allowed"])
        if state.exists:
            state.setTimeoutTimestamp(max(int(1000 * state.get[1]) + full, state.getCurrentWatermarkMs() + 1))

    kind = dict(events.dtypes)[key]
    timed = with_time(events, column).withWatermark(column, late)
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event_id bigint, allowed boolean", "tokens double, at double", "append", GroupStateTimeout.EventTimeTimeout)
