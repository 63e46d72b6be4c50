"""Silence and error detectors on a stream (D6, D2, R4) with event-time state.

Rows are counted first, per source and hour (per hour for error rates), by a
windowed aggregate with map-side partial counts; a window that the watermark has
passed leaves one row.  What is stateful per key then sees one row an hour,
however many rows a source has: a source that holds a third of all rows costs its
state no more than any other.

* *Silence*: a source's state holds its counts of the last 24 hours and one timer,
  two whole hours after its last row.  A row in time moves the timer; when the
  watermark passes it, the rule of the batch detector is applied (10 rows in 24
  hours, a mean over the earlier hours above 5) and an anomaly leaves.
* *Error rate*: the state holds the rates of the last 24 hours; each new hour is
  tested against the mean of those before it, as the batch detector tests its last
  hour.

No stored logs are read again and no batch waits for a clock.  The state store has
to be the RocksDB one (``configure_state``).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import constants as K

HOUR_MS = 3_600_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = ("timestamp timestamp, anomaly_type string, severity string, description string, log_count bigint, "
       "score double, source string")


def configure_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _time(ms: int) -> dt.datetime:
    """A naive time in UTC, as the session's zone is."""
    return dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in OUT.split(", ")])


class Silence(StatefulProcessor):
    def __init__(self, hours: int = 24):
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "hour bigint", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for hour, n in zip(pdf["hour_ms"], pdf["n"]):
                self.counts.updateValue((int(hour),), (int(n),))
        last = max(h for (h,) in self.counts.keys())
        for old in [h for (h,) in self.counts.keys() if h <= last - self.hours * HOUR_MS]:
            self.counts.removeKey((old,))
        # the last row's hour and two whole ones without any
        due = last + (1 + K.SILENCE_RECENT_HOURS) * HOUR_MS
        for at in list(self.handle.listTimers()):
            if at != due:
                self.handle.deleteTimer(at)
        self.handle.registerTimer(due)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        held = {h: n for (h,), (n,) in self.counts.iterator()}
        # a row came meanwhile: the timer that belongs to it is still to come
        if not held or max(held) + (1 + K.SILENCE_RECENT_HOURS) * HOUR_MS != due:
            return iter([])
        inside = {h: n for h, n in held.items() if h >= due - self.hours * HOUR_MS}
        total = sum(inside.values())
        n_hours = min(self.hours, (due - min(held)) // HOUR_MS)
        mean = total / (n_hours - K.SILENCE_RECENT_HOURS) if n_hours > K.SILENCE_RECENT_HOURS else 0.0
        if total < K.SILENCE_MIN_ROWS or mean <= K.SILENCE_MIN_MEAN:
            return iter([])
        source = key[0]
        return iter([_frame([(
            _time(due), "SOURCE_SILENCE", "MEDIUM",
            f"Source '{source}' has gone silent (usually produces {mean:.1f} logs/hour)", 0, mean, source)])])

    def close(self) -> None:
        pass


class ErrorRate(StatefulProcessor):
    def __init__(self, hours: int = 24):
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rates = handle.getMapState("rates", "hour bigint", "rate double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = []
        new = sorted((int(h), int(n), int(e)) for pdf in rows for h, n, e in zip(pdf["hour_ms"], pdf["n"], pdf["errors"]))
        for hour, n, errors in new:
            rate = errors / (n + K.EPSILON)
            before = {h: r for (h,), (r,) in self.rates.iterator()}
            past = [r for h, r in before.items() if hour - self.hours * HOUR_MS < h < hour]
            baseline = sum(past) / len(past) if past else 0.0
            if rate > K.ERROR_RATE_THRESHOLD and rate > 2 * baseline:
                found.append((_time(hour), "HIGH_ERROR_RATE", "CRITICAL" if rate > K.ERROR_RATE_CRITICAL else "HIGH",
                              f"High error rate detected: {100 * rate:.2f}% ({errors} errors out of {n} logs)", n, rate, None))
            self.rates.updateValue((hour,), (rate,))
            for old in [h for h in before if h <= hour - self.hours * HOUR_MS]:
                self.rates.removeKey((old,))
        return iter([_frame(found)] if found else [])

    def close(self) -> None:
        pass


def _hourly(logs: DataFrame, watermark: str, *keys: str) -> DataFrame:
    window = F.window("timestamp", "1 hour").alias("w")
    errors = F.count_if(F.col("level").isin(*K.ERROR_RATE_LEVELS))
    counts = (logs.select("timestamp", "level", *keys).withWatermark("timestamp", watermark).groupBy(window, *keys)
              .agg(F.count(F.lit(1)).alias("n"), errors.alias("errors")))
    return counts.select(*keys, F.window_time("w").alias("at"), "n", "errors",
                         (F.unix_millis(F.col("w.start"))).alias("hour_ms"))


def silence_stream(logs: DataFrame, hours: int = 24, watermark: str = "10 minutes") -> DataFrame:
    """D6 on a stream of log rows (timestamp, level, source)."""
    configure_state(logs.sparkSession)
    rows = _hourly(logs.where(F.col("source").isNotNull()), watermark, "source")
    return rows.groupBy("source").transformWithStateInPandas(Silence(hours), OUT, "append", "eventtime")


def error_rate_stream(logs: DataFrame, hours: int = 24, watermark: str = "10 minutes") -> DataFrame:
    """D2 on a stream of log rows: one row an hour reaches the one key."""
    configure_state(logs.sparkSession)
    rows = _hourly(logs, watermark).withColumn("all", F.lit(0))
    return rows.groupBy("all").transformWithStateInPandas(ErrorRate(hours), OUT, "append", "eventtime")
