"""Anomaly detectors (D1-D4, D6-D8) as Spark plans.

Each detector is ``(logs, as_of, ...) -> DataFrame`` in the anomaly layout
(see ``logsift.schema.ANOMALY_SCHEMA``) plus its detail columns.  ``as_of``
replaces the wall clock so runs repeat.

Scale: the heavy work is always a partial ``groupBy`` of the log rows (per
hour, per template, per source-hour).  Windows over the hourly series run per
block of hours with a halo of the rows before; single numbers (a percentile, the
last hour, a baseline) are scalar subqueries.
"""

from __future__ import annotations

import logging
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..schema import ANOMALY_COLUMNS
from .stats import hour_calendar, hour_level_counts, with_halo


def _ts(v) -> Column:
    return F.lit(v).cast("timestamp") if isinstance(v, str) else F.lit(v)


def fmt(x: Column, decimals: int) -> Column:
    """Fixed-point text of a double, ties to even (as Python's format)."""
    return F.format_string(f"%.{decimals}f", F.bround(x, decimals))


def recent_logs(logs: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Rows of the last ``hours`` hours (partition-pruned on event_date),
    only the columns the detectors read."""
    since = _ts(as_of) - F.make_interval(hours=F.lit(hours))
    cols = [c for c in ("timestamp", "level", "message", "source", "template_id", "template",
                        "ingest_seq") if c in logs.columns]
    pred = F.col("timestamp") >= since
    if "event_date" in logs.columns:
        pred = pred & (F.col("event_date") >= F.to_date(since))
    return logs.where(pred).select(*cols)


def _details(**cols: Column) -> Column:
    kv = []
    for k, v in cols.items():
        kv += [F.lit(k), v.cast("string")]
    return F.create_map(*kv)


def as_anomalies(df: DataFrame) -> DataFrame:
    """Keep only the stored anomaly columns."""
    return df.select(*ANOMALY_COLUMNS)


# --------------------------------------------------------------- D1 volume --
def hourly_volume(recent: DataFrame) -> DataFrame:
    """Rows per hour from the first to the last hour, empty hours = 0; with
    the hour's ``index`` and ``n_hours``."""
    counts = (recent.groupBy(F.date_trunc("hour", "timestamp").alias("hour"))
              .agg(F.count(F.lit(1)).alias("n")))
    cal = hour_calendar(counts, "hour")
    return cal.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"), "index", "n_hours")


def rolling_z(series: DataFrame, value: str = "n", max_window: int = K.VOLUME_MAX_WINDOW,
              exclude_current: bool = False) -> DataFrame:
    """Trailing mean and sample std over w = min(24, rows - 1) rows
    (NULL until w rows exist) and z = (x - mean) / (std + 1e-6).

    ``series`` is dense and carries ``index`` and ``n_hours``.  The frame is the
    fixed last ``max_window`` rows, with ``exclude_current`` those before the
    tested one (so that |z| is not bounded by the window's length, Q11); the last
    w of them are taken from that bounded array, so w can depend on the series'
    length.  Windows run per block of hours with a halo of the rows before it:
    a series of any length spreads over the cluster.
    """
    back = max_window if exclude_current else max_window - 1
    frame = Window.partitionBy("block").orderBy("index").rowsBetween(-back, -1 if exclude_current else 0)
    s = (with_halo(series, back).withColumn("_arr", F.collect_list(F.col(value).cast("double")).over(frame))
         .where(~F.col("halo")).drop("block", "halo")
         .withColumn("w", F.least(F.lit(max_window), F.col("n_hours") - 1).cast("int")))
    seen = F.col("index") + (0 if exclude_current else 1)
    full = (F.col("w") >= 2) & (seen >= F.col("w"))
    last = F.when(full, F.slice("_arr", -F.col("w"), F.col("w")))
    mean = F.aggregate(last, F.lit(0.0), lambda a, x: a + x) / F.col("w")
    s = s.withColumn("rolling_mean", F.when(full, mean))
    var = F.aggregate(last, F.lit(0.0), lambda a, x: a + (x - F.col("rolling_mean")) * (x - F.col("rolling_mean"))) / (F.col("w") - 1)
    s = s.withColumn("rolling_std", F.when(full, F.sqrt(var)))
    s = s.withColumn("z", (F.col(value) - F.col("rolling_mean")) / (F.col("rolling_std") + K.EPSILON))
    return s.drop("_arr", "index")


def detect_volume(logs: DataFrame, as_of, hours: int = 24, exclude_current: bool = False) -> DataFrame:
    """VOLUME_SPIKE / VOLUME_DROP where |z| > 3 (needs >= 3 hourly rows)."""
    z = rolling_z(hourly_volume(recent_logs(logs, as_of, hours)), exclude_current=exclude_current)
    z = z.where((F.col("n_hours") >= 3) & (F.abs(F.col("z")) > K.VOLUME_Z_THRESHOLD))
    spike = F.col("z") > 0
    return z.select(
        F.col("hour").alias("timestamp"),
        F.when(spike, "VOLUME_SPIKE").otherwise("VOLUME_DROP").alias("anomaly_type"),
        F.when(F.abs(F.col("z")) > K.VOLUME_HIGH_Z, "HIGH").otherwise("MEDIUM").alias("severity"),
        F.concat(F.when(spike, F.lit("Unusual spike")).otherwise(F.lit("Unusual drop")),
                 F.lit(" in log volume: "), F.col("n").cast("string"),
                 F.lit(" logs (z-score: "), fmt(F.col("z"), 2), F.lit(")")).alias("description"),
        F.array().cast("array<string>").alias("affected_templates"),
        F.col("n").cast("bigint").alias("log_count"),
        F.abs(F.col("z")).alias("score"),
        _details(z_score=F.col("z"),
                 expected_range=F.concat(fmt(F.col("rolling_mean"), 1), F.lit(" ± "),
                                         fmt(F.col("rolling_std"), 1)),
                 actual_count=F.col("n")).alias("details"),
        F.col("z").alias("z_score"), F.col("rolling_mean"), F.col("rolling_std"))


# ----------------------------------------------------------- D2 error rate --
def detect_error_rate(logs: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Per observed hour, errors / (total + 1e-6) > 0.1 and > 2 x the mean
    rate of all hours but the last (N4)."""
    hl = hour_level_counts(recent_logs(logs, as_of, hours), K.ERROR_RATE_LEVELS)
    errors = sum((F.col(f"n_{lv}") for lv in K.ERROR_RATE_LEVELS), F.lit(0))
    hl = hl.select("hour", "total", errors.alias("errors"))
    hl = hl.withColumn("rate", F.col("errors") / (F.col("total") + K.EPSILON))
    last = hl.agg(F.max("hour")).scalar()
    baseline = hl.where(F.col("hour") < last).agg(F.avg("rate")).scalar()
    hl = hl.withColumn("baseline_rate", F.coalesce(baseline, F.lit(0.0)))
    hit = hl.where((F.col("rate") > K.ERROR_RATE_THRESHOLD) & (F.col("rate") > F.col("baseline_rate") * 2))
    return hit.select(
        F.col("hour").alias("timestamp"),
        F.lit("HIGH_ERROR_RATE").alias("anomaly_type"),
        F.when(F.col("rate") > K.ERROR_RATE_CRITICAL, "CRITICAL").otherwise("HIGH").alias("severity"),
        F.concat(F.lit("High error rate detected: "), fmt(F.col("rate") * 100, 2), F.lit("% ("),
                 F.col("errors").cast("string"), F.lit(" errors out of "),
                 F.col("total").cast("string"), F.lit(" logs)")).alias("description"),
        F.array().cast("array<string>").alias("affected_templates"),
        F.col("total").cast("bigint").alias("log_count"),
        F.col("rate").alias("score"),
        _details(error_rate=F.col("rate"), error_count=F.col("errors"),
                 total_count=F.col("total"), baseline_rate=F.col("baseline_rate")).alias("details"),
        F.col("errors").alias("error_count"), F.col("baseline_rate"))


# -------------------------------------------------------- D3 new templates --
def new_templates(logs: DataFrame, templates: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Templates seen in the window whose first sighting (over the whole
    history, from the templates table) is within the last 24 h; one row each."""
    rec = recent_logs(logs, as_of, hours)
    seen = (rec.where(F.col("template_id").isNotNull()).groupBy("template_id")
            .agg(F.count(F.lit(1)).alias("count"),
                 F.min_by("template", "ingest_seq").alias("template")))
    hist = templates.select("template_id", "first_seen")
    since = _ts(as_of) - F.make_interval(hours=F.lit(24))
    return (seen.join(hist, "template_id", "left")
            .withColumn("is_new", F.col("first_seen") >= since))


def detect_new_templates(logs: DataFrame, templates: DataFrame, as_of, hours: int = 24,
                         list_ids: bool = False, threshold: float = K.NEW_TEMPLATE_THRESHOLD) -> DataFrame:
    """D3: one NEW_TEMPLATE_SURGE row when the share of new templates among the
    window's templates is above 5 %.  The new templates themselves are in
    ``new_templates(...)`` (a table, not one ever-growing list in one row);
    ``list_ids`` puts their ids into ``affected_templates`` too, for mined
    templates, of which there are few."""
    t = new_templates(logs, templates, as_of, hours)
    ids = F.array_sort(F.collect_list(F.when(F.col("is_new"), F.col("template_id")))) if list_ids else \
        F.first(F.array().cast("array<string>"))
    agg = t.agg(ids.alias("ids"), F.count(F.lit(1)).alias("total_templates"),
                F.count_if("is_new").alias("new_templates"),
                F.coalesce(F.sum(F.when(F.col("is_new"), F.col("count"))), F.lit(0)).alias("new_rows"))
    ratio = F.col("new_templates") / F.greatest(F.col("total_templates"), F.lit(1))
    agg = agg.withColumn("ratio", ratio).where(F.col("ratio") > threshold)
    return agg.select(
        _ts(as_of).alias("timestamp"),
        F.lit("NEW_TEMPLATE_SURGE").alias("anomaly_type"),
        F.when(F.col("ratio") > K.NEW_TEMPLATE_HIGH, "HIGH").otherwise("MEDIUM").alias("severity"),
        F.concat(F.lit("Unusual number of new log templates: "),
                 F.col("new_templates").cast("string"), F.lit(" new templates ("),
                 fmt(F.col("ratio") * 100, 1), F.lit("% of total)")).alias("description"),
        F.coalesce("ids", F.array().cast("array<string>")).alias("affected_templates"),
        F.col("new_rows").cast("bigint").alias("log_count"),
        F.col("ratio").alias("score"),
        _details(new_template_count=F.col("new_templates"),
                 total_template_count=F.col("total_templates"),
                 ratio=F.col("ratio")).alias("details"),
        F.col("new_templates").alias("new_template_count"),
        F.col("total_templates").alias("total_template_count"))


# ------------------------------------------------------- D4 rare templates --
def detect_rare_templates(logs: DataFrame, as_of, hours: int = 24,
                          history_days: int = 7, recent_hours: int = 2, history_before: bool = False) -> DataFrame:
    """Templates whose 7-day count is at most the 5th percentile of 7-day
    counts (A16, A22) and that occur more than 3 x that in the last 2 hours.

    As written, the tested hours are part of the history, so that no template can
    qualify; with ``history_before`` the history ends where they begin.  One
    aggregate of the rows serves both counts (J1 and J2 without a join)."""
    a = _ts(as_of)
    week = a - F.make_interval(days=F.lit(history_days))
    since = a - F.make_interval(hours=F.lit(min(hours, recent_hours)))
    recent = F.col("timestamp") >= since
    past = ~recent if history_before else F.lit(True)
    pred = F.col("timestamp") >= week
    if "event_date" in logs.columns:
        pred = pred & (F.col("event_date") >= F.to_date(week))
    counts = (logs.where(pred).groupBy("template_id", "template")
              .agg(F.count_if(past).alias("hist"), F.count_if(recent).alias("new"),
                   F.min(F.when(recent, F.col("ingest_seq"))).alias("seq"))
              .groupBy("template_id")
              .agg(F.sum("hist").alias("hist_count"), F.sum("new").alias("recent_count"),
                   F.min_by("template", "seq").alias("template")))
    counts = counts.where("hist_count > 0")
    p5 = counts.agg(F.percentile("hist_count", K.RARE_TEMPLATE_PERCENTILE / 100.0)).scalar()
    act = (counts.withColumn("rare_threshold", p5).withColumn("historical_avg", F.col("hist_count"))
           .where((F.col("hist_count") <= F.col("rare_threshold")) & F.col("template_id").isNotNull()))
    hit = act.where(F.col("recent_count") > F.col("rare_threshold") * K.RARE_RECENT_FACTOR)
    return hit.select(
        a.alias("timestamp"),
        F.lit("RARE_TEMPLATE_ACTIVITY").alias("anomaly_type"),
        F.lit("MEDIUM").alias("severity"),
        F.concat(F.lit("Unusual activity in rare template: '"), F.substring("template", 1, 100),
                 F.lit("...' ("), F.col("recent_count").cast("string"),
                 F.lit(" occurrences)")).alias("description"),
        F.array("template_id").alias("affected_templates"),
        F.col("recent_count").cast("bigint").alias("log_count"),
        (F.col("recent_count") / F.col("rare_threshold")).alias("score"),
        _details(template_id=F.col("template_id"), template=F.col("template"),
                 recent_count=F.col("recent_count"),
                 historical_avg=F.col("historical_avg").cast("double"),
                 rare_threshold=F.col("rare_threshold")).alias("details"),
        "template_id", "recent_count", F.col("historical_avg").cast("double").alias("historical_avg"),
        "rare_threshold")


# ------------------------------------------------------ D6 source silence --
def detect_source_silence(logs: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Per source with >= 10 rows: no rows in the last 2 observed hours
    while the mean over the earlier observed hours is above 5 (N5, A19).

    Hours are those observed in any source; a source's missing hours count 0,
    so the mean is (its rows in earlier hours) / (number of earlier hours) and
    no source x hour matrix is built.
    """
    rec = recent_logs(logs, as_of, hours).where(F.col("source").isNotNull())
    sh = (rec.groupBy("source", F.date_trunc("hour", "timestamp").alias("hour"))
          .agg(F.count(F.lit(1)).alias("n")))
    hours_df = sh.select("hour").distinct()
    latest = hours_df.orderBy(F.col("hour").desc()).limit(K.SILENCE_RECENT_HOURS).agg(F.min("hour")).scalar()
    late = F.col("hour") >= latest
    per = (sh.groupBy("source")
           .agg(F.sum("n").alias("total"), F.sum(F.when(late, F.col("n")).otherwise(0)).alias("recent"),
                F.sum(F.when(late, F.lit(0)).otherwise(F.col("n"))).alias("earlier"))
           .withColumn("n_hours", hours_df.agg(F.count(F.lit(1))).scalar()))
    avg = F.when(F.col("n_hours") > K.SILENCE_RECENT_HOURS,
                 F.col("earlier") / (F.col("n_hours") - K.SILENCE_RECENT_HOURS)).otherwise(F.lit(0.0))
    per = per.withColumn("historical_avg", avg.cast("double"))
    hit = per.where((F.col("total") >= K.SILENCE_MIN_ROWS) & (F.col("recent") == 0)
                    & (F.col("historical_avg") > K.SILENCE_MIN_MEAN))
    return hit.select(
        _ts(as_of).alias("timestamp"),
        F.lit("SOURCE_SILENCE").alias("anomaly_type"),
        F.lit("MEDIUM").alias("severity"),
        F.concat(F.lit("Source '"), F.col("source"), F.lit("' has gone silent (usually produces "),
                 fmt(F.col("historical_avg"), 1), F.lit(" logs/hour)")).alias("description"),
        F.array().cast("array<string>").alias("affected_templates"),
        F.lit(0).cast("bigint").alias("log_count"),
        F.col("historical_avg").alias("score"),
        _details(source=F.col("source"), historical_avg=F.col("historical_avg"),
                 silent_hours=F.lit(K.SILENCE_RECENT_HOURS)).alias("details"),
        "source", "historical_avg")


# -------------------------------------------------------------- D7 all ------
class DetectionRun(NamedTuple):
    written: list[str]
    failed: list[str]


def run_detection(logs: DataFrame, templates: DataFrame, as_of, hours: int = 24,
                  include_ml: bool = True, sink=None, only=None):
    """All detectors (or those named in ``only``).

    Without a sink: their union in the anomaly layout, one lazy plan in which an
    error of any detector is an error of the whole.  With a ``sink(name, df)``
    each detector is planned and written on its own; one that fails is logged
    and does not stop the others.  Then a ``DetectionRun`` with the names that
    were written and those that failed is returned.
    """
    parts = {
        "volume": lambda: detect_volume(logs, as_of, hours),
        "error_rate": lambda: detect_error_rate(logs, as_of, hours),
        "new_templates": lambda: detect_new_templates(logs, templates, as_of, hours),
        "rare_templates": lambda: detect_rare_templates(logs, as_of, hours),
        "source_silence": lambda: detect_source_silence(logs, as_of, hours),
    }
    if include_ml:
        from .iforest import detect_ml
        parts["ml"] = lambda: detect_ml(logs, as_of, hours)
    parts = {n: build for n, build in parts.items() if only is None or n in only}
    if sink is None:
        return reduce(DataFrame.unionByName, [as_anomalies(build()) for build in parts.values()])
    written, failed = [], []
    for name, build in parts.items():
        try:
            sink(name, as_anomalies(build()))
            written.append(name)
        except Exception as exc:  # noqa: BLE001 - isolation per detector
            logging.getLogger(__name__).error("detector %s failed: %s", name, exc)
            failed.append(name)
    return DetectionRun(written, failed)


def anomalies_by_day(logs: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Per day, log rows, anomalies and the highest severity that day."""
    sev_rank = (F.when(F.col("severity") == "CRITICAL", 4).when(F.col("severity") == "HIGH", 3)
                .when(F.col("severity") == "MEDIUM", 2).otherwise(1))
    a = (anomalies.groupBy(F.to_date("timestamp").alias("date"))
         .agg(F.count(F.lit(1)).alias("anomalies"), F.max(sev_rank).alias("_sev")))
    n = logs.groupBy(F.to_date("timestamp").alias("date")).agg(F.count(F.lit(1)).alias("normal"))
    sev_name = (F.when(F.col("_sev") == 4, "critical").when(F.col("_sev") == 3, "high")
                .when(F.col("_sev") == 2, "medium").when(F.col("_sev") == 1, "low"))
    return (n.join(a, "date", "full_outer")
            .select("date", F.coalesce("normal", F.lit(0)).alias("normal"),
                    F.coalesce("anomalies", F.lit(0)).alias("anomalies"),
                    sev_name.alias("severity")))


def recent_anomalies(anomalies: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Anomalies of the last ``hours`` hours, newest first."""
    since = _ts(as_of) - F.make_interval(hours=F.lit(hours))
    return anomalies.where(F.col("timestamp") >= since).orderBy(F.col("timestamp").desc(),
                                                               F.col("anomaly_type"))


def report_order(anomalies: DataFrame) -> DataFrame:
    """Console report order, severity text descending."""
    return anomalies.orderBy(F.col("severity").desc(), F.col("timestamp"), F.col("anomaly_type"))
