"""Aggregations over the logs table.

All of them are ``groupBy``/``agg`` plans: Spark aggregates partially inside
each task before the shuffle, so a key that holds a third of all rows still
sends one partial row per task.  Distinct counts over exploded arrays use the
same two-phase distinct aggregation; ``approx=True`` swaps in HyperLogLog++.
Top-k lists are ``orderBy(count desc, key).limit(k)`` (a TakeOrderedAndProject,
k rows per task), with the key as tie-break so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import hour_bucket_text, hour_label, is_error


def _ts(v) -> Column:
    return F.lit(v).cast("timestamp") if isinstance(v, str) else F.lit(v)


def totals(logs: DataFrame) -> DataFrame:
    """A1: total logs, distinct templates, distinct files (one row)."""
    return logs.agg(F.count(F.lit(1)).alias("total_logs"),
                    F.countDistinct("template_id").alias("total_templates"),
                    F.countDistinct("file_id").alias("total_files"))


def count_by(logs: DataFrame, key: str, top: int | None = None) -> DataFrame:
    """A2/A3/A4: rows per key, most frequent first; NULL is a group."""
    out = (logs.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
           .orderBy(F.col("count").desc(), F.col(key).asc_nulls_first()))
    return out.limit(top) if top else out


def top_files(logs: DataFrame, k: int = 10) -> DataFrame:
    """A5: rows per filename among rows that came from a file, top k."""
    return count_by(logs.where(F.col("file_id").isNotNull()), "filename", k)


def network_summary(logs: DataFrame, approx: bool = False) -> DataFrame:
    """Rows with network facts and distinct IPs over all rows (one row).

    One pass: each row is exploded into its IPs (a row without IPs stays as
    one row with position NULL); position 0/NULL marks the row once.
    """
    e = logs.select(F.col("network_info").isNotNull().alias("has_net"),
                    F.posexplode_outer(F.col("network_info.ip_addresses")).alias("pos", "ip"))
    first = F.col("pos").isNull() | (F.col("pos") == 0)
    distinct_ips = F.approx_count_distinct("ip") if approx else F.countDistinct("ip")
    return e.agg(F.count_if(first & F.col("has_net")).alias("logs_with_network_info"),
                 distinct_ips.alias("unique_ips"))


def top_protocols(logs: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent protocols over all rows."""
    p = logs.select(F.explode(F.col("network_info.protocols")).alias("protocol"))
    return count_by(p, "protocol", k)


def hourly_activity(logs: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Rows per 'YYYY-MM-DD HH:00' over the last ``hours`` hours."""
    since = _ts(as_of) - F.make_interval(hours=F.lit(hours))
    return (logs.where((F.col("timestamp") >= since) & (F.col("event_date") >= F.to_date(since)))
            .groupBy(hour_bucket_text(F.col("timestamp")).alias("hour"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy("hour"))


def file_distribution(logs: DataFrame, key: str) -> DataFrame:
    """Per file, rows per level (or log_type), all files in one pass."""
    return (logs.groupBy("file_id", key).agg(F.count(F.lit(1)).alias("count"))
            .orderBy("file_id", F.col("count").desc(), F.col(key).asc_nulls_first()))


def file_network(logs: DataFrame, approx: bool = False) -> DataFrame:
    """Per file, rows with network facts, distinct protocols, distinct IPs."""
    n = logs.where(F.col("network_info").isNotNull())
    rows = n.groupBy("file_id").agg(F.count(F.lit(1)).alias("logs_with_network_info"))

    def distinct_of(field, name):
        e = n.select("file_id", F.explode(F.col(f"network_info.{field}")).alias("v"))
        agg = F.approx_count_distinct("v") if approx else F.countDistinct("v")
        return e.groupBy("file_id").agg(agg.alias(name))

    return (rows.join(distinct_of("protocols", "unique_protocols"), "file_id", "left")
            .join(distinct_of("ip_addresses", "unique_ips"), "file_id", "left")
            .fillna(0, ["unique_protocols", "unique_ips"]))


def file_date_range(logs: DataFrame) -> DataFrame:
    """A10: earliest and latest event time per file."""
    return logs.groupBy("file_id").agg(F.min("timestamp").alias("earliest"),
                                       F.max("timestamp").alias("latest"))


def file_error_rate(logs: DataFrame) -> DataFrame:
    """Per file total rows, ERROR rows, error rate in percent (all
    rows, not a sample), rows with and without network facts."""
    return (logs.groupBy("file_id")
            .agg(F.count(F.lit(1)).alias("total_logs"),
                 F.count_if(F.col("level").isin(*K.CLIENT_ERROR_LEVELS)).alias("error_count"),
                 F.count_if(F.col("network_info").isNotNull()).alias("with_network_info"))
            .withColumn("without_network_info", F.col("total_logs") - F.col("with_network_info"))
            .withColumn("error_rate", F.round(100.0 * F.col("error_count") / F.col("total_logs"), 2))
            .withColumn("error_alarm", F.col("error_rate") > 5))


def file_sources(logs: DataFrame) -> DataFrame:
    """Per file, rows per source."""
    return logs.groupBy("file_id", "source").agg(F.count(F.lit(1)).alias("count"))


def file_hour_of_day(logs: DataFrame) -> DataFrame:
    """Per file, rows per hour of day 'HH:00'."""
    return (logs.groupBy("file_id", hour_label(F.col("timestamp")).alias("hour"))
            .agg(F.count(F.lit(1)).alias("count")))


def error_rate_from_levels(level_counts: DataFrame) -> DataFrame:
    """Error share (ERROR rows / all rows, percent, 2 decimals) from a
    level distribution (level, count); alarm above 5."""
    return (level_counts.agg(F.sum(F.when(F.col("level") == "ERROR", F.col("count"))
                                   .otherwise(0)).alias("errors"),
                             F.sum("count").alias("total"))
            .select(F.when(F.col("total") > 0,
                           F.round(100.0 * F.col("errors") / F.col("total"), 2))
                    .otherwise(F.lit(0.0)).alias("error_rate"))
            .withColumn("error_alarm", F.col("error_rate") > 5))


def template_summary(templates: DataFrame, as_of, anomalous_ids: DataFrame | None = None) -> DataFrame:
    """Template count, active in the last 24 h, anomalous, mean count."""
    since = _ts(as_of) - F.make_interval(hours=F.lit(24))
    t = templates
    if anomalous_ids is not None:
        t = t.join(anomalous_ids.select("template_id").distinct()
                   .withColumn("_anom", F.lit(True)), "template_id", "left")
    else:
        t = t.withColumn("_anom", F.lit(None).cast("boolean"))
    return t.agg(F.count(F.lit(1)).alias("total_templates"),
                 F.count_if(F.col("last_seen") >= since).alias("active_templates"),
                 F.count_if(F.col("_anom")).alias("anomalous_templates"),
                 F.round(F.avg("count")).cast("bigint").alias("avg_count"))


def files_summary(files: DataFrame) -> DataFrame:
    """Total size, processed and failed lines over all files."""
    return files.agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"),
                     F.coalesce(F.sum("processed_logs"), F.lit(0)).alias("total_processed"),
                     F.coalesce(F.sum("failed_logs"), F.lit(0)).alias("total_failed"),
                     F.count(F.lit(1)).alias("total_files"))


def hour_level_counts(logs: DataFrame, levels=K.ERROR_RATE_LEVELS) -> DataFrame:
    """Per observed hour, total rows and rows of each given level
    (absent levels count 0), as conditional counts in one aggregate."""
    return (logs.groupBy(F.date_trunc("hour", "timestamp").alias("hour"))
            .agg(F.count(F.lit(1)).alias("total"),
                 *[F.count_if(F.col("level") == lv).alias(f"n_{lv}") for lv in levels]))


def hourly_features(logs: DataFrame) -> DataFrame:
    """Per hour bucket between the first and the last row: rows, error
    rows, distinct templates, distinct sources, hour of day, day of week;
    gap hours give 0 (hour and day come from the bucket itself)."""
    h = F.date_trunc("hour", "timestamp")
    counts = (logs.groupBy(h.alias("hour"))
              .agg(F.count("level").alias("n_logs"),
                   F.sum(is_error(F.col("level"))).alias("n_errors"),
                   F.countDistinct("template_id").alias("n_templates"),
                   F.countDistinct("source").alias("n_sources")))
    cal = hour_calendar(counts, "hour")
    return (cal.join(counts, "hour", "left")
            .select("hour",
                    F.coalesce("n_logs", F.lit(0)).alias("n_logs"),
                    F.coalesce("n_errors", F.lit(0)).alias("n_errors"),
                    F.coalesce("n_templates", F.lit(0)).alias("n_templates"),
                    F.coalesce("n_sources", F.lit(0)).alias("n_sources"),
                    F.hour("hour").alias("hour_of_day"),
                    F.weekday("hour").alias("day_of_week")))


HOURS_PER_BLOCK = 4096
HOUR = 3600


def hour_calendar(hourly: DataFrame, col: str = "hour") -> DataFrame:
    """Every hour from the first to the last bucket of an hourly aggregate
    (N1 gap filling), with ``index`` (from 0) and ``n_hours``.

    The span is laid out as blocks of hours, and each block fills in its own: no
    row holds more than a block, so one line with a date of the year 1 or 9999
    makes many rows but no large one.
    """
    span = hourly.agg(F.floor(F.unix_seconds(F.min(col)) / HOUR).alias("lo"),
                      F.floor(F.unix_seconds(F.max(col)) / HOUR).alias("hi")).where(F.col("lo").isNotNull())
    size = F.lit(HOURS_PER_BLOCK)
    blocks = span.select("lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))).alias("block"))
    hours = blocks.select("lo", "hi", F.explode(F.sequence(
        F.greatest("lo", F.col("block") * size), F.least(F.col("hi"), F.col("block") * size + size - 1))).alias("h"))
    return hours.select(F.timestamp_seconds(F.col("h") * HOUR).alias(col), (F.col("h") - F.col("lo")).alias("index"),
                        (F.col("hi") - F.col("lo") + 1).alias("n_hours"))


def with_halo(series: DataFrame, back: int, index: str = "index") -> DataFrame:
    """``series`` with a ``block`` of rows by ``index``, each block preceded by the
    last ``back`` rows of the one before (``halo`` true): windows over the last
    ``back`` rows can be partitioned by ``block``."""
    size = max(HOURS_PER_BLOCK, back)
    block = F.floor(F.col(index) / size)
    late = F.col(index) % size >= size - back
    copies = F.when(late, F.array(F.struct(block.alias("block"), F.lit(False).alias("halo")),
                                  F.struct((block + 1).alias("block"), F.lit(True).alias("halo")))).otherwise(
        F.array(F.struct(block.alias("block"), F.lit(False).alias("halo"))))
    return series.select("*", F.explode(copies).alias("_c")).select(
        *series.columns, F.col("_c.block").alias("block"), F.col("_c.halo").alias("halo"))


def error_categories(logs: DataFrame, levels=K.CLIENT_ERROR_LEVELS) -> DataFrame:
    """Error rows by keyword category with their share in percent."""
    msg = F.lower(F.col("message"))
    cat = None
    for name, words in K.ERROR_CATEGORIES:
        cond = None
        for w in words:
            c = msg.contains(w)
            cond = c if cond is None else (cond | c)
        cat = F.when(cond, F.lit(name)) if cat is None else cat.when(cond, F.lit(name))
    cat = cat.otherwise(F.lit("other"))
    per = (logs.where(F.col("level").isin(*levels))
           .groupBy(cat.alias("category")).agg(F.count(F.lit(1)).alias("count")))
    share = 100.0 * F.col("count") / per.agg(F.sum("count")).scalar()
    return per.select("category", "count", F.round(share, 2).alias("percentage"))


def error_trend(logs: DataFrame, levels=K.CLIENT_ERROR_LEVELS) -> DataFrame:
    """C4: per day, error rows and error rate in percent."""
    return (logs.groupBy(F.to_date("timestamp").alias("date"))
            .agg(F.count(F.lit(1)).alias("total"),
                 F.count_if(F.col("level").isin(*levels)).alias("errors"))
            .withColumn("error_rate", F.round(100.0 * F.col("errors") / F.col("total"), 2)))


def level_share(logs: DataFrame) -> DataFrame:
    """Rows per level with their share in percent."""
    per = logs.groupBy("level").agg(F.count(F.lit(1)).alias("count"))
    share = 100.0 * F.col("count") / per.agg(F.sum("count")).scalar()
    return per.select("level", "count", F.round(share, 2).alias("percentage"))


# our rule: a duration written as 'took <n> ms' in a message is a response time
RESPONSE_TIME_RE = r"took (\d+) ms"


def performance_buckets(logs: DataFrame, bucket_hours: int = 4) -> DataFrame:
    """Per time-of-day bucket ('00:00', '04:00', ...): mean response time
    (ms, from messages that state one), rows, error rows."""
    b = (F.floor(F.hour("timestamp") / bucket_hours) * bucket_hours).cast("int")
    label = F.concat(F.lpad(b.cast("string"), 2, "0"), F.lit(":00"))
    rt = F.regexp_extract(F.col("message"), RESPONSE_TIME_RE, 1).try_cast("double")
    return (logs.groupBy(label.alias("time"))
            .agg(F.round(F.avg(rt), 6).alias("response_time"),
                 F.count(F.lit(1)).alias("throughput"),
                 F.count_if(F.col("level").isin(*K.CLIENT_ERROR_LEVELS)).alias("errors")))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation; NaN where one of the two never changes, so that its
    spread is zero (the built-in one stops with a division by zero there)."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spreads = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spreads == 0, F.lit(float("nan"))).otherwise(F.covar_pop(x, y) / spreads)


def metric_correlation(hourly: DataFrame) -> DataFrame:
    """Pearson correlation of hourly volume and of hourly source count
    with the hourly error rate (one row)."""
    rate = F.col("n_errors") / F.col("n_logs")
    h = hourly.where(F.col("n_logs") > 0).withColumn("error_rate", rate)
    return h.agg(correlation(F.col("n_logs"), F.col("error_rate")).alias("corr_volume_error_rate"),
                 correlation(F.col("n_sources"), F.col("error_rate")).alias("corr_sources_error_rate"))


def network_split(logs: DataFrame) -> DataFrame:
    """Rows with and without network facts (one row)."""
    return logs.agg(F.count_if(F.col("network_info").isNotNull()).alias("with_network_info"),
                    F.count_if(F.col("network_info").isNull()).alias("without_network_info"))


def period_growth(logs: DataFrame) -> DataFrame:
    """Per day, logs, templates, files and error rate, with the growth in
    percent over the previous day (NULL for the first day).  The window runs
    over the per-day rows only (one row per day)."""
    daily = (logs.groupBy(F.to_date("timestamp").alias("date"))
             .agg(F.count(F.lit(1)).alias("logs"),
                  F.countDistinct("template_id").alias("templates"),
                  F.countDistinct("file_id").alias("files"),
                  (100.0 * F.count_if(F.col("level").isin(*K.CLIENT_ERROR_LEVELS))
                   / F.count(F.lit(1))).alias("error_rate")))
    w = Window.orderBy("date")
    out = daily
    for c in ("logs", "templates", "files", "error_rate"):
        prev = F.lag(c).over(w)
        out = out.withColumn(f"{c}_growth", F.round(100.0 * (F.col(c) - prev) / prev, 6))
    return out.withColumn("error_rate", F.round("error_rate", 6))


TREND_BAND = 0.1  # our rule: rows/day of slope that counts as a trend


def template_trend(logs: DataFrame) -> DataFrame:
    """Per template, least-squares slope of its daily row counts over the
    days it occurs; increasing / decreasing beyond +-0.1 rows per day."""
    daily = (logs.groupBy("template_id", F.to_date("timestamp").alias("date"))
             .agg(F.count(F.lit(1)).alias("n")))
    slope = (daily.groupBy("template_id")
             .agg(F.regr_slope(F.col("n").cast("double"),
                               F.unix_date("date").cast("double")).alias("slope"),
                  F.count(F.lit(1)).alias("days")))
    # a slope needs two days
    slope = slope.withColumn("slope", F.when(F.col("days") >= 2, F.col("slope")))
    trend = (F.when(F.col("slope") > TREND_BAND, "increasing")
             .when(F.col("slope") < -TREND_BAND, "decreasing").otherwise("stable"))
    return slope.select("template_id", "days", F.round("slope", 6).alias("slope"),
                        trend.alias("trend"))
