"""Structured Streaming twins of the stateful operators.

Each takes a streaming DataFrame. State is keyed and expires by watermark, so it does not grow
with the stream's history. The two that can do without event time, ``gated_updates`` and
``running_ewma``, remember every key unless they are given ``late``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _event_time(stream: DataFrame, ts: str | None, late: str | None) -> tuple[DataFrame, str]:
    """The stream with its watermark and the timeout of its keys' state, if it has to expire."""
    if ts is None or late is None:
        return stream, GroupStateTimeout.NoTimeout
    return stream.withWatermark(ts, late), GroupStateTimeout.EventTimeTimeout


def _expire(state: GroupState, frames: list[pd.DataFrame], ts: str | None, timeout: str) -> None:
    """Let the state go once the watermark passes the key's last event."""
    if timeout == GroupStateTimeout.EventTimeTimeout:
        last = max((f[ts].max() for f in frames if len(f)), default=pd.NaT)
        at = 0 if pd.isna(last) else int(pd.Timestamp(last).timestamp() * 1000)
        state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs()) + 1)


def gated_updates(stream: DataFrame, key: str, version: str, payload: str, ts: str | None = None, late: str | None = None) -> DataFrame:
    """key, version and payload of each accepted update: its version exceeds the key's current one.

    Late and repeated updates change nothing, whatever order they come in; the last row of a
    key that is given out is its state. With ``ts`` and ``late`` a key is forgotten once the
    watermark passes its last update, after which any version counts as new.
    """
    kind = dict(stream.dtypes)
    stream, timeout = _event_time(stream, ts, late)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = state.get[0] if state.exists else None
        row, frames = None, list(frames)
        for f in frames:
            f = f.dropna(subset=[version])
            if len(f):
                i = f[version].idxmax()
                if best is None or f.at[i, version] > best:
                    best, row = int(f.at[i, version]), f.at[i, payload]
        if row is not None or best is not None:
            state.update((best,))
            _expire(state, frames, ts, timeout)
        if row is not None:
            yield pd.DataFrame({key: [k[0]], version: [best], payload: [row]})

    rows = stream.where(F.col(key).isNotNull()).select(key, version, payload, *([ts] if ts and ts not in (key, version, payload) else []))
    return rows.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind[key]}, `{version}` bigint, `{payload}` {kind[payload]}", "version bigint", "update", timeout)


def debounce(stream: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """key, start, end and n of each quiet-ended run of events; a run is given out once the watermark passes its end."""
    s = stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed_rate(stream: DataFrame, by: str, ts: str, length: str, late: str, slide: str | None = None) -> DataFrame:
    """by, start and n of event-time windows; late events within ``late`` still count."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    s = stream.withWatermark(ts, late).groupBy(by, w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select(by, F.col("w.start").alias("start"), "n")


def once(stream: DataFrame, ids: list[str], ts: str, late: str) -> DataFrame:
    """The first of each id; ids are forgotten after ``late``."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(ids)


def running_ewma(stream: DataFrame, key: str, ts: str, tie: str, value: str, alpha: float = 0.5, late: str | None = None) -> DataFrame:
    """key, n and ewma after each micro-batch; a batch's rows of a key fold in (ts, tie) order.

    With ``late`` a key is forgotten once the watermark passes its last event, and starts anew.
    """
    kind = dict(stream.dtypes)
    stream, timeout = _event_time(stream, ts, late)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, e = state.get if state.exists else (0, 0.0)
        parts = [f for f in frames if len(f)]
        if parts:
            for v in pd.concat(parts).sort_values([ts, tie])[value].dropna():
                e = float(v) if n == 0 else e * (1 - alpha) + float(v) * alpha
                n += 1
        state.update((n, e))
        _expire(state, parts, ts, timeout)
        yield pd.DataFrame({key: [k[0]], "n": [n], "ewma": [e]})

    rows = stream.where(F.col(key).isNotNull()).select(key, ts, tie, value)
    return rows.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind[key]}, n bigint, ewma double", "n bigint, ewma double", "update", timeout)


def flush(stream: DataFrame, path: str, checkpoint: str, merge: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None):
    """Write each micro-batch durably, once: its folder is named by the batch, so a repeated batch replaces itself.

    ``merge`` may change the batch, given (batch, None). Returns the started query, which ends
    when the input that is there has been read.
    """

    def write(batch: DataFrame, number: int) -> None:
        out = merge(batch, None) if merge else batch
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
