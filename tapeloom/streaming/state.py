"""Stateful streams with timers: ticks in event-time order, trailing stops, exponential means that expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR, DAY = 3_600_000, 86_400_000
#: Share of its peak by which a price falls before a position is stopped.
STOP = 0.25
STOP_SCHEMA = "symbol string, day date, entry double, peak double, exit_at timestamp, exit double, ticks long, reason string"


class OrderedTicks(StatefulProcessor):
    """Holds ticks until the watermark has passed their hour, then hands them on in order of time and id.

    A timer stands at the end of each hour with ticks; ticks of an hour that the watermark has passed are late and are dropped.
    So what a subclass sees does not depend on how the stream is cut into batches. `step` takes an hour's ticks, `end` is told
    that an hour is over; both give rows.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "hour long", "at array<bigint>, id array<bigint>, value array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(rows))
        at = x["ts"].astype("datetime64[us]").astype("int64")
        mark = timerValues.getCurrentWatermarkInMs()
        for hour, own in x.assign(at=at, hour=at // 1000 // HOUR * HOUR).groupby("hour"):
            if hour + HOUR <= mark:
                continue
            old = self.waiting.getValue((hour,)) if self.waiting.containsKey((hour,)) else ([], [], [])
            new = (own["at"].tolist(), own["event_id"].tolist(), own["value"].astype(float).tolist())
            self.waiting.updateValue((hour,), tuple(list(a) + b for a, b in zip(old, new)))
            for at in (hour + HOUR, *self.timers(hour)):
                self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        hour, rows = (end - HOUR,), []
        if self.waiting.containsKey(hour):
            ticks = sorted(zip(*self.waiting.getValue(hour)))
            self.waiting.removeKey(hour)
            rows += self.step(key, ticks)
        rows += self.end(key, end)
        if rows:
            yield self.frame(rows)

    def timers(self, hour: int) -> tuple[int, ...]:
        """Further ends that a tick of this hour brings about. (A timer that is set while timers fire waits for the next batch.)"""
        return ()

    def step(self, key, ticks: list[tuple]) -> list[tuple]:
        return []

    def end(self, key, at: int) -> list[tuple]:
        return []

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


class TrailingStop(OrderedTicks):
    """A position opens at the first tick of a day. It is stopped at the first tick a share of `stop` below the peak so far, else
    closed at the day's end, which a timer of its own tells."""

    def __init__(self, stop: float = STOP):
        self.stop = stop

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.position = handle.getValueState("position", "day long, entry double, peak double, last_at long, last double, n long, open boolean")

    def timers(self, hour):
        return (hour // DAY * DAY + DAY,)

    def step(self, key, ticks):
        out = []
        state = tuple(self.position.get()) if self.position.exists() else None
        for at, _, value in ticks:
            day = at // 1000 // DAY * DAY
            if state is None or state[0] != day:
                state = (day, value, value, at, value, 0, True)
            _, entry, peak, _, _, n, is_open = state
            if is_open:
                peak = max(peak, value)
                is_open = value > peak * (1 - self.stop)
                state = (day, entry, peak, at, value, n + 1, is_open)
                if not is_open:
                    out.append(self._row(key, state, "stop"))
        if state is not None:
            self.position.update(state)
        return out

    def end(self, key, at):
        if not self.position.exists():
            return []
        state = tuple(self.position.get())
        if state[0] + DAY > at:
            return []
        self.position.clear()
        return [self._row(key, state, "close")] if state[6] else []

    @staticmethod
    def _row(key, state, reason):
        return (key[0], pd.Timestamp(state[0], unit="ms").date(), state[1], state[2], pd.Timestamp(state[3], unit="us"), state[4], state[5], reason)

    def frame(self, rows):
        return pd.DataFrame(rows, columns=["symbol", "day", "entry", "peak", "exit_at", "exit", "ticks", "reason"])


class ExponentialMean(StatefulProcessor):
    """One number and a count for each key, updated in time order within a batch; a key that is not seen for TTL is forgotten."""

    ALPHA, TTL = 0.1, 30 * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mean = handle.getValueState("mean", "n long, mean double", ttlDurationMs=self.TTL)

    def handleInputRows(self, key, rows, timerValues):
        n, mean = self.mean.get() if self.mean.exists() else (0, 0.0)
        for v in pd.concat(list(rows)).sort_values(["ts", "event_id"])["value"].tolist():
            n, mean = n + 1, v if n == 0 else mean * (1 - self.ALPHA) + v * self.ALPHA
        self.mean.update((n, mean))
        yield pd.DataFrame({"symbol": [key[0]], "n": [n], "ewma": [mean]})

    def close(self) -> None:
        pass


def trailing_stops(stream: DataFrame, stop: float = STOP, late: str = "1 hour") -> DataFrame:
    """(symbol, day, entry, peak, exit_at, exit, ticks, reason) of each symbol's positions."""
    x = stream.withWatermark("ts", late).select(F.col("event_type").alias("symbol"), "ts", "event_id", "value").where("ts IS NOT NULL AND value IS NOT NULL")
    return x.groupBy("symbol").transformWithStateInPandas(TrailingStop(stop), outputStructType=STOP_SCHEMA, outputMode="Append", timeMode="EventTime")


def ewma(stream: DataFrame) -> DataFrame:
    """(symbol, n, ewma): exponential mean of each type's values."""
    x = stream.select(F.col("event_type").alias("symbol"), "ts", "event_id", "value").where("value IS NOT NULL")
    return x.groupBy("symbol").transformWithStateInPandas(ExponentialMean(), outputStructType="symbol string, n long, ewma double", outputMode="Update", timeMode="ProcessingTime")


def sliding(stream: DataFrame, width: str = "1 day", slide: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Volatility and turnover of each type in windows that overlap."""
    x = stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), F.col("event_type").alias("symbol"))
    return x.agg(F.stddev_samp("value").alias("vol"), F.sum("value").alias("total"), F.count("*").alias("n"))
