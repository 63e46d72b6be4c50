"""Structured inputs: single entries (S5), collector records (S6), the
collector's JSON/container/syslog parsers (S10-S12).

One parse path for all sources (Q15): the text goes through the same line
parser as uploaded files; fields given by the caller win over parsed ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import iso_time, json_object
from ..operators.parse import parse_lines
from ..operators.templates import assign_exact_templates


def entries_to_logs(entries: DataFrame, ingest_ts: Column | None = None) -> DataFrame:
    """Entries (timestamp?, level?, message, source?, metadata?) -> logs.

    Given timestamp, level, source and metadata win over parsed values.
    """
    ingest_ts = ingest_ts if ingest_ts is not None else F.current_timestamp()
    # arrival order: given, else row ids (batch) or the arrival time (stream)
    if "ingest_seq" in entries.columns:
        seq = F.col("ingest_seq")
    elif entries.isStreaming:
        seq = F.unix_micros(F.current_timestamp())
    else:
        seq = F.monotonically_increasing_id()
    raw = entries.select(
        F.col("message").alias("line"), F.col("source").alias("source"),
        F.coalesce(F.col("timestamp"), ingest_ts).alias("ingest_ts"),
        F.col("timestamp").alias("_given_ts"), F.col("level").alias("_given_level"),
        F.col("metadata").alias("_given_meta"),
        seq.alias("ingest_seq"))
    parsed = parse_lines(raw)
    out = parsed.select(
        "ingest_seq",
        F.coalesce("_given_ts", "timestamp").alias("timestamp"),
        F.coalesce("_given_level", "level").alias("level"),
        "message", "source", "log_type", "network_info", "parsed_fields",
        F.when(F.col("_given_meta").isNull(), F.col("metadata"))
        .otherwise(F.map_concat(F.map_filter("metadata", lambda k, v: ~F.map_contains_key(
            F.col("_given_meta"), k)), F.col("_given_meta"))).alias("metadata"),
        F.col("ingest_ts").alias("created_at"))
    return assign_exact_templates(out).withColumn("event_date", F.to_date("timestamp"))


def collector_to_entries(records: DataFrame, ingest_ts: Column | None = None) -> DataFrame:
    """Collector records (log, time?, tag?, source?) -> entries.

    A bad ``time`` only defaults that field (per-record isolation): the time
    is the record's time if it parses, else the ingest time; source is the
    record's source, else its tag, else 'fluent-bit'; the tag goes to metadata.
    """
    ingest_ts = ingest_ts if ingest_ts is not None else F.current_timestamp()
    tag = F.col("tag")
    rest = [c for c in records.columns if c not in ("log", "time", "tag", "source")]
    return records.select(*rest,
        F.coalesce(iso_time(F.col("time")), ingest_ts).alias("timestamp"),
        F.lit(None).cast("string").alias("level"),
        F.col("log").alias("message"),
        F.coalesce(F.col("source"), tag, F.lit(K.COLLECTOR_DEFAULT_SOURCE)).alias("source"),
        F.when(tag.isNotNull(), F.create_map(F.lit("tag"), tag)).alias("metadata"))


def json_log_filter(records: DataFrame, key: str = "log") -> DataFrame:
    """Records as map<string,string>; when ``key`` holds a JSON object its
    fields are added to the record (parsed fields win), the key is kept."""
    rec = F.col("record")
    parsed = json_object(rec[key])
    merged = F.when(parsed.isNull(), rec).otherwise(
        F.map_concat(F.map_filter(rec, lambda k, v: ~F.map_contains_key(parsed, k)), parsed))
    return records.withColumn("record", merged)


def container_time(record: Column, key: str = "time") -> Column:
    """The container parser's time key, '%Y-%m-%dT%H:%M:%S.%L' (time kept)."""
    return F.try_to_timestamp(F.substring(record[key], 1, 23), F.lit(K.CONTAINER_TIME_FORMAT))


def parse_syslog_pri(lines: DataFrame, line: str = "line", ingest_ts: str | None = None) -> DataFrame:
    """S12 + F7: '<pri>time host ident[pid]: message' -> pri, time, host, ident,
    pid, message, facility = pri div 8, severity = pri mod 8, level."""
    L = F.col(line)
    cols = {}
    for i, g in enumerate(K.SYSLOG_PRI_GROUPS, 1):
        v = F.regexp_extract(L, K.SYSLOG_PRI_RE, i)
        cols[g] = F.nullif(v, F.lit("")) if g in ("pid",) else F.when(L.rlike(K.SYSLOG_PRI_RE), v)
    pri = cols["pri"].try_cast("int")
    sev = F.create_map(*[x for k, v in K.SEVERITY_LEVELS.items() for x in (F.lit(int(k)), F.lit(v))])
    out = lines.select("*", *[c.alias(g) for g, c in cols.items() if g != "pri"],
                       pri.alias("pri"))
    out = (out.withColumn("facility", F.floor(F.col("pri") / 8).cast("int"))
           .withColumn("severity", F.pmod(F.col("pri"), F.lit(8)))
           .withColumn("level", sev[F.col("severity")]))
    if ingest_ts:
        norm = F.regexp_replace(F.col("time"), r"\s+", " ")
        year = F.year(F.col(ingest_ts)).cast("string")
        out = out.withColumn("parsed_time", F.try_to_timestamp(F.concat(year, F.lit(" "), norm),
                                                               F.lit("yyyy MMM d HH:mm:ss")))
    return out
