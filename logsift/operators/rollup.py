"""Mergeable hourly rollups (A2, A6, A8, A9, A11, A20): counts and sketches per
(hour, file, level), merged at query time.

``build`` makes the rollup in one pass over the logs: exact counts and HyperLogLog
sketches of templates, sources, addresses and protocols; ``build_latency`` a
histogram of the stated response times in bins of two percent.  Statistics over
any range of hours, files or levels are then sums and sketch unions over the
rollup, whose size is hours x files x levels, not rows.  Rollups of batches merge
by union: counts add up, sketches unite, so a rollup is a table that grows by
appending.

Counts are exact.  Distinct counts have a relative standard error of about
1.04 / sqrt(2^LG_K) (0.8 % at 14), quantiles are at most one percent off; the
exact forms are in ``operators.stats``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from .stats import RESPONSE_TIME_RE, hour_calendar

LG_K = 14
BIN = 1.02              # ratio of the bins of response times
KEYS = ("event_date", "hour", "file_id", "level")


def build(logs: DataFrame) -> DataFrame:
    """event_date, hour, file_id, level, rows, with_network, first_ts, last_ts and
    the sketches."""
    net = F.col("network_info")
    # one pass: a row is exploded into its addresses and protocols, once at least
    facts = F.concat(
        F.transform(F.coalesce(net["ip_addresses"], F.array().cast("array<string>")),
                    lambda x: F.struct(F.lit("ip").alias("kind"), x.alias("value"))),
        F.transform(F.coalesce(net["protocols"], F.array().cast("array<string>")),
                    lambda x: F.struct(F.lit("protocol").alias("kind"), x.alias("value"))))
    rows = logs.select(
        F.to_date("timestamp").alias("event_date"), F.date_trunc("hour", "timestamp").alias("hour"), "file_id", "level",
        "timestamp", "template_id", "source", net.isNotNull().alias("net"),
        F.posexplode_outer(facts).alias("pos", "fact"))
    first = F.col("pos").isNull() | (F.col("pos") == 0)

    def once(c: Column) -> Column:
        return F.when(first, c)

    def of(kind: str) -> Column:
        return F.when(F.col("fact.kind") == kind, F.col("fact.value"))

    return rows.groupBy(*KEYS).agg(
        F.count_if(first).alias("rows"), F.count_if(first & F.col("net")).alias("with_network"),
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
        F.hll_sketch_agg(once(F.col("template_id")), LG_K).alias("templates"),
        F.hll_sketch_agg(once(F.col("source")), LG_K).alias("sources"),
        F.hll_sketch_agg(of("ip"), LG_K).alias("ips"), F.hll_sketch_agg(of("protocol"), LG_K).alias("protocols"))


def build_latency(logs: DataFrame) -> DataFrame:
    """event_date, hour, file_id, bin, n, ms_sum of the stated response times."""
    ms = F.regexp_extract("message", RESPONSE_TIME_RE, 1).try_cast("double")
    rows = logs.select(F.to_date("timestamp").alias("event_date"), F.date_trunc("hour", "timestamp").alias("hour"),
                       "file_id", ms.alias("ms")).where("ms is not null")
    place = F.when(F.col("ms") > 0, F.floor(F.ln("ms") / F.lit(math.log(BIN)))).cast("int")    # null: zero
    return rows.groupBy("event_date", "hour", "file_id", place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("ms").alias("ms_sum"))


def _distinct(sketch: str) -> Column:
    return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(sketch)), F.lit(0)).cast("bigint")


def level_counts(rollup: DataFrame, *by: str) -> DataFrame:
    """Rows per level, of the whole or by hour, file or date."""
    return rollup.groupBy(*by, "level").agg(F.sum("rows").alias("count"))


def file_network(rollup: DataFrame) -> DataFrame:
    """A9 from the rollup: per file, rows with network facts (exact), distinct
    protocols and addresses (estimates)."""
    return (rollup.groupBy("file_id")
            .agg(F.sum("with_network").alias("logs_with_network_info"), _distinct("protocols").alias("unique_protocols"),
                 _distinct("ips").alias("unique_ips")).where("logs_with_network_info > 0"))


def network_summary(rollup: DataFrame) -> DataFrame:
    """A6 from the rollup (one row)."""
    return rollup.agg(F.coalesce(F.sum("with_network"), F.lit(0)).alias("logs_with_network_info"),
                      _distinct("ips").alias("unique_ips"))


def file_stats(rollup: DataFrame) -> DataFrame:
    """A8-A12 in one pass over the rollup: per file rows, errors, error rate,
    first and last time, distinct templates and sources."""
    errors = F.sum(F.when(F.col("level").isin(*K.CLIENT_ERROR_LEVELS), F.col("rows")).otherwise(0))
    return (rollup.groupBy("file_id")
            .agg(F.sum("rows").alias("total_logs"), errors.alias("error_count"), F.min("first_ts").alias("earliest"),
                 F.max("last_ts").alias("latest"), _distinct("templates").alias("unique_templates"),
                 _distinct("sources").alias("unique_sources"))
            .withColumn("error_rate", F.round(100.0 * F.col("error_count") / F.col("total_logs"), 2)))


def hourly_features(rollup: DataFrame) -> DataFrame:
    """A20 from the rollup: the features of the isolation forest, distinct counts
    as estimates."""
    errors = F.sum(F.when(F.col("level").isin(*K.ML_ERROR_LEVELS), F.col("rows")).otherwise(0))
    counts = rollup.groupBy("hour").agg(
        F.sum(F.when(F.col("level").isNotNull(), F.col("rows")).otherwise(0)).alias("n_logs"), errors.alias("n_errors"),
        _distinct("templates").alias("n_templates"), _distinct("sources").alias("n_sources"))
    names = ("n_logs", "n_errors", "n_templates", "n_sources")
    return (hour_calendar(counts, "hour").join(counts, "hour", "left")
            .select("hour", *[F.coalesce(n, F.lit(0)).alias(n) for n in names],
                    F.hour("hour").alias("hour_of_day"), F.weekday("hour").alias("day_of_week")))


def response_times(latency: DataFrame, *by: str, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """C1 and more: number, mean (exact) and quantiles (the middle of their bin) of
    the response times, of the whole or by hour, file or date.  A window holds the
    bins of one group, some hundreds."""
    key = [F.lit(0).alias("_all")] if not by else [F.col(c) for c in by]
    bins = latency.groupBy(*key, "bin").agg(F.sum("n").alias("n"), F.sum("ms_sum").alias("ms_sum"))
    names = list(by) or ["_all"]
    own = Window.partitionBy(*names)
    upto = own.orderBy(F.col("bin").asc_nulls_first())
    bins = bins.withColumns({"total": F.sum("n").over(own), "upto": F.sum("n").over(upto)})
    middle = F.when(F.col("bin").isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(BIN), F.col("bin") + 0.5))
    out = bins.groupBy(*names).agg(
        F.sum("n").alias("timed"), (F.sum("ms_sum") / F.sum("n")).alias("mean_ms"),
        *[F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * q), middle)).alias(f"p{round(100 * q)}_ms") for q in quantiles])
    return out if by else out.drop("_all")
