"""Lags and rolling statistics of a stream from per-city state.

``transformWithStateInPandas`` keeps, for every city, the hours that later
ones may still look back on, and the hours that wait for earlier ones to
arrive. An hour is final once the watermark has passed it; then its features
are computed from the buffer and emitted, in time order, so rows that arrive
out of order give the same features as sorted ones. What lies further back
than the largest lag or window is dropped, so a city's state is bounded by
``back`` final hours and those that are younger than the watermark.

An hour that arrives after the watermark has passed it is dropped, as Spark's
own windowed aggregates do; a repeated hour replaces its values while it waits.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: seconds since the epoch, value
_ROW = "t long, v double"


@dataclass(frozen=True)
class Trailing:
    """Row-based features of one value column (rolling ones need a full window)."""
    lags: tuple = (1, 2, 3, 6, 12, 24)
    windows: tuple = (3, 6, 12, 24)

    @property
    def back(self) -> int:
        """Rows before a row that its features need."""
        return max(*self.lags, *[w - 1 for w in self.windows])

    def names(self, col: str) -> list[str]:
        return [f"{col}_lag_{k}h" for k in self.lags] + [f"{col}_rolling_{s}_{w}h" for w in self.windows for s in ("mean", "min", "max")]

    def schema(self, col: str) -> str:
        return ", ".join(["city string", "timestamp timestamp", f"`{col}` double", *[f"`{n}` double" for n in self.names(col)], "buffered int"])

    def rows(self, past: Sequence[float | None], now: Sequence[float | None]) -> np.ndarray:
        """Features of the rows ``now`` that follow ``past``."""
        v = np.array([np.nan if x is None else x for x in [*past, *now]])
        at = np.arange(len(past), len(v))
        out = []
        for k in self.lags:
            out.append(np.where(at >= k, v[np.maximum(at - k, 0)], np.nan))
        for w in self.windows:
            frames = [v[max(0, i - w + 1):i + 1] for i in at]
            frames = [f[~np.isnan(f)] for f in frames]
            for stat in (np.mean, np.min, np.max):
                out.append([stat(f) if len(f) >= w else np.nan for f in frames])
        return np.array(out).T.reshape(len(now), -1)


class _Buffer(StatefulProcessor):
    def __init__(self, spec: Trailing, col: str):
        self.spec, self.col = spec, col

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getListState("done", _ROW)  # the newest final hours, in order
        self.waiting = handle.getListState("waiting", _ROW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() // 1000
        held = {t: v for t, v in self.waiting.get()}
        new = {}
        for part in rows:
            for t, v in zip(part["ets"].astype("datetime64[s]").astype("int64").tolist(), part[self.col].tolist()):
                if t > mark or mark <= 0:
                    new[t] = None if pd.isna(v) else float(v)
        if new:
            self.waiting.put(sorted((held | new).items()))
            self.handle.registerTimer(min(new) * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All hours that the watermark has passed, in one go; the timer of the
        earliest one that it has not passed stands for the others."""
        mark = timerValues.getCurrentWatermarkInMs() // 1000
        held = list(self.waiting.get())
        now, later = [x for x in held if x[0] <= mark], [x for x in held if x[0] > mark]
        if not now:
            return
        self.waiting.put(later) if later else self.waiting.clear()
        if later:
            self.handle.registerTimer(later[0][0] * 1000)
        past = list(self.done.get())
        got = self.spec.rows([v for _, v in past], [v for _, v in now])
        self.done.put([*past, *now][-self.spec.back:])
        out = pd.DataFrame(got, columns=self.spec.names(self.col))
        out.insert(0, "city", key[0])
        out.insert(1, "timestamp", pd.to_datetime([t for t, _ in now], unit="s"))
        out.insert(2, self.col, np.array([np.nan if v is None else v for _, v in now]))
        out["buffered"] = np.minimum(len(past) + 1 + np.arange(len(now)), self.spec.back).astype(np.int32)
        yield out.astype(object).where(out.notna(), None)

    def close(self) -> None:
        pass


def trailing_features(hours: DataFrame, col: str, spec: Trailing | None = None, delay: str = "0 seconds") -> DataFrame:
    """(city, timestamp, col, features, buffered) of a stream of (city,
    timestamp, col), one row per city and hour, emitted when the watermark
    (newest hour less ``delay``) passes the hour. ``buffered`` is the number
    of hours that the city's state keeps."""
    spec = spec or Trailing()
    hours.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    src = hours.select("city", F.col("timestamp").cast("timestamp").alias("ets"), F.col(col).cast("double").alias(col)) \
        .withWatermark("ets", delay)
    out = src.groupBy("city").transformWithStateInPandas(_Buffer(spec, col), spec.schema(col), "append", "EventTime")
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
