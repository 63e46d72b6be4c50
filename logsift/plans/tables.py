"""The stored tables, derived by Spark from the driver's tables.

``build_logs(spark, sf_dir)`` is the ingest plan: raw lines from ``events`` ->
parse -> exact templates, one narrow stage with no shuffle.  ``logs(...)``
writes it once as parquet partitioned by ``event_date`` into the shared
checkpoint folder (``spark.checkpoint.dir``) and serves every query from that
table, so queries get partition pruning, pushed filters and pruned columns
instead of re-running the regular expressions (parse once, query many).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parse import parse_lines
from ..operators.templates import assign_exact_templates
from ..session import configure, ensure_checkpoint_dir
from ..sources.event_lines import raw_lines, spread

# metadata keys surfaced as flat columns (name -> (log_type, key))
META_COLUMNS = {
    "syslog__hostname": "hostname", "syslog__program": "program", "syslog__pid": "pid",
    "apache_access__method": "method", "apache_access__url": "url",
    "apache_access__status": "status", "apache_access__size": "size",
    "apache_access__referer": "referer", "apache_access__user_agent": "user_agent",
    "firewall__action": "action", "cisco_syslog__timezone": "timezone",
    "cisco_syslog__facility": "facility", "cisco_syslog__severity": "severity",
    "cisco_syslog__mnemonic": "mnemonic", "windows_event__event_id": "event_id",
    "windows_event__source": "source", "docker__container_id": "container_id",
}


# bump when the parsed table's content or layout changes
LOGS_VERSION = "10"


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _input_signature(spark: SparkSession, path: str) -> str:
    """What changes when a file, or any file of a folder, is replaced."""
    fs, p = _fs_path(spark, path)
    st = fs.getFileStatus(p)
    size, latest, n = st.getLen(), st.getModificationTime(), 1
    if st.isDirectory():
        files, n = fs.listFiles(p, True), 0
        while files.hasNext():
            f = files.next()
            size, latest, n = size + f.getLen(), max(latest, f.getModificationTime()), n + 1
    return f"{st.getPath().toString()}:{size}:{latest}:{n}"


def stored_logs_path(spark: SparkSession, sf_dir: str) -> str:
    sig = _input_signature(spark, f"{sf_dir}/events.parquet") + ":" + LOGS_VERSION
    key = hashlib.sha1(sig.encode()).hexdigest()[:16]
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/logsift/logs-{key}"


def stored(spark: SparkSession, name: str, inputs: list[str], build, partition_by=None) -> DataFrame:
    """A table derived by Spark from ``inputs``, written once into the shared
    checkpoint folder (keyed by the inputs' path/size/mtime and LOGS_VERSION)
    and read back, so later plans start from a stored table."""
    configure(spark)
    sig = "|".join(_input_signature(spark, p) for p in inputs) + ":" + LOGS_VERSION + ":" + name
    key = hashlib.sha1(sig.encode()).hexdigest()[:16]
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/logsift/{name}-{key}"
    fs, p = _fs_path(spark, path + "/_SUCCESS")
    if not fs.exists(p):
        w = build().write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(partition_by)
        w.parquet(path)
    return spark.read.parquet(path)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored parsed-logs table for ``sf_dir`` (built on first use)."""
    configure(spark)
    path = stored_logs_path(spark, sf_dir)
    fs, p = _fs_path(spark, path + "/_SUCCESS")
    if not fs.exists(p):
        write_logs(build_logs(spark, sf_dir), path)
    return spark.read.parquet(path)


def mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored message -> mined template table for ``sf_dir``, with the
    statistics of each message (``operators.mining.mine_messages``)."""
    from ..operators.mining import mine_messages, message_stats
    return stored(spark, "mined", [f"{sf_dir}/events.parquet"],
                  lambda: mine_messages(message_stats(logs(spark, sf_dir))))


def mined_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log rows with mined template id, text and cluster size in place of
    the exact ones."""
    from ..operators.mining import assign_mined_templates
    rows = assign_mined_templates(logs(spark, sf_dir), mined(spark, sf_dir))
    return (rows.drop("template_id", "template").withColumnRenamed("mined_template_id", "template_id")
            .withColumnRenamed("mined_template", "template"))


def replayed(logs_df: DataFrame, day: str) -> DataFrame:
    """An incident made from all log rows, for the detectors of the last hours:
    every row at its time of day on ``day``; host-3 falls silent at 22:00 (its
    later rows come 12 hours earlier); the network devices' rows but the first two
    pour in from 23:00 (host-3's came ten days before); at 20:00 most rows are
    errors."""
    ts, seq = F.col("timestamp"), F.col("event_id")
    start = F.lit(day).cast("timestamp")
    at = start + (ts - F.date_trunc("day", ts))
    minute = F.make_interval(mins=F.pmod(seq, F.lit(60)).cast("int"))
    device = (F.col("log_type") == "cisco_syslog") & (seq >= 16)
    at = (F.when(device & (F.col("source") == "host-3"), at - F.expr("INTERVAL 240 HOURS"))
          .when(device, start + F.expr("INTERVAL 23 HOURS") + minute).otherwise(at))
    at = F.when((F.col("source") == "host-3") & (F.hour(at) >= 22), at - F.expr("INTERVAL 12 HOURS")).otherwise(at)
    level = (F.when((F.hour("timestamp") == 20) & (seq % 10 < 7), "ERROR").when(seq % 25 == 0, "WARN").otherwise("INFO"))
    return (logs_df.withColumn("timestamp", at).withColumn("level", level)
            .withColumn("event_date", F.to_date("timestamp")))


def replayed_sql(day: str) -> str:
    """The same rows in DuckDB SQL, as a CTE ``logs_r`` over ``logs_n``."""
    return f"""r0 AS (SELECT *, CASE WHEN log_type = 'cisco_syslog' AND event_id >= 16 AND source = 'host-3'
    THEN TIMESTAMP '{day}' + (timestamp - date_trunc('day', timestamp)) - INTERVAL 240 HOUR
    WHEN log_type = 'cisco_syslog' AND event_id >= 16 THEN TIMESTAMP '{day}' + INTERVAL 23 HOUR + to_minutes(event_id % 60)
    ELSE TIMESTAMP '{day}' + (timestamp - date_trunc('day', timestamp)) END AS moved FROM logs_n),
r1 AS (SELECT * EXCLUDE (timestamp, moved), CASE WHEN source = 'host-3' AND hour(moved) >= 22 THEN moved - INTERVAL 12 HOUR ELSE moved END AS timestamp FROM r0),
logs_r AS (SELECT * EXCLUDE (level), CASE WHEN hour(timestamp) = 20 AND event_id % 10 < 7 THEN 'ERROR'
    WHEN event_id % 25 = 0 THEN 'WARN' ELSE 'INFO' END AS level FROM r1)"""


def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored hourly rollup of the logs (``operators.rollup``)."""
    from ..operators.rollup import build
    return stored(spark, "rollup", [f"{sf_dir}/events.parquet"], lambda: build(logs(spark, sf_dir)), "event_date")


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored hourly histogram of response times."""
    from ..operators.rollup import build_latency
    return stored(spark, "latency", [f"{sf_dir}/events.parquet"], lambda: build_latency(logs(spark, sf_dir)), "event_date")


def text_index(spark: SparkSession, sf_dir: str):
    """The trigram index of the stored logs' messages and sources, up to date."""
    from ..operators.text_index import TextIndex
    logs(spark, sf_dir)
    path = stored_logs_path(spark, sf_dir)
    index = TextIndex(spark, path, path + "-text", ("message", "source"))
    index.refresh()
    return index


def write_logs(df: DataFrame, path: str) -> None:
    """Append-free full write, partitioned by event date; rows are
    sorted by time inside each file so parquet min/max statistics make time
    predicates skip row groups."""
    (df.sortWithinPartitions("event_date", "timestamp")
     .write.mode("overwrite").partitionBy("event_date").parquet(path))


def build_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed logs from ``events``: one row per non-blank line (lazy plan)."""
    configure(spark)
    raw = raw_lines(spark, sf_dir).drop("ts")
    parsed = parse_lines(raw)
    out = assign_exact_templates(parsed)
    return out.select(
        F.concat(F.col("file_id"), F.lit("-"), F.col("ingest_seq").cast("string")).alias("log_id"),
        "event_id", "ingest_seq", "timestamp", "level", "message", "source", "log_type",
        "network_info", "parsed_fields", "metadata", "template_id", "template",
        "file_id", "filename", F.col("ingest_ts").alias("created_at"),
        F.to_date("timestamp").alias("event_date"))


def flat(logs_df: DataFrame) -> DataFrame:
    """Logs with network facts and format fields as plain columns."""
    n = F.col("network_info")
    md = F.col("metadata")
    extra = []
    for col, key in META_COLUMNS.items():
        t = col.split("__")[0]
        extra.append(F.when(F.col("log_type") == t, md[key]).alias(col))
    return logs_df.select(
        "log_id", "event_id", "ingest_seq", "timestamp", "level", "message", "source",
        "log_type", "file_id", "filename", "template_id", "template",
        n["ip_addresses"].alias("ip_addresses"), n["src_ip"].alias("src_ip"),
        n["dst_ip"].alias("dst_ip"), n["ip_address"].alias("ip_address"),
        n["src_port"].alias("src_port"), n["dst_port"].alias("dst_port"),
        n["protocol"].alias("protocol"), n["ports"].alias("ports"),
        n["protocols"].alias("protocols"), n["mac_addresses"].alias("mac_addresses"),
        n.isNotNull().alias("has_network_info"), *extra,
        # Q8: access lines with an agent keep the one label
        ((F.col("log_type") == "apache_access") & md["user_agent"].isNotNull()).alias("has_user_agent"))
