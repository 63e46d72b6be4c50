"""Search filters (W1-W13) and exports (S21) on a small parsed table."""
import datetime as dt
import os

from pyspark.sql import functions as F

from logsift.operators import query as Q
from logsift.operators.parse import parse_lines
from logsift.operators.templates import assign_exact_templates
from logsift.sources import sinks

LINES = [
    '1.2.3.4 - - [10/Oct/2023:13:55:36 +0000] "GET /a HTTP/1.1" 500 12',
    '1.2.3.5 - - [10/Oct/2023:13:56:36 +0000] "POST /b HTTP/1.1" 200 12',
    "fw DENY SRC=10.0.0.1 DST=10.0.0.2 PROTO=17 SPT=5 DPT=53",
    "Dec  1 10:00:00 web1 cron: job ok",
]


def _logs(spark):
    rows = [(i, line, dt.datetime(2023, 12, 2), "h") for i, line in enumerate(LINES)]
    df = spark.createDataFrame(rows, "ingest_seq long, line string, ingest_ts timestamp, source string")
    out = assign_exact_templates(parse_lines(df))
    return (out.withColumn("log_id", F.col("ingest_seq").cast("string"))
            .withColumn("event_date", F.to_date("timestamp")).withColumn("file_id", F.lit("f"))
            .withColumn("filename", F.lit("a.log")))


def test_filters(spark):
    logs = _logs(spark)

    def ids(**kw):
        return sorted(r["log_id"] for r in Q.query_logs(logs, Q.LogQuery(**kw)).collect())

    assert ids(fields={"status": "500"}) == ["0"]
    assert ids(protocol="17") == ["2"]  # the list found in text; the field maps 17 -> UDP
    assert ids(protocol="udp") == []
    assert ids(ip_address="10.0.0.2") == ["2"]
    assert ids(has_network_info=False) == ["3"]
    assert ids(message_contains="JOB") == ["3"]
    assert ids(levels=("WARN", "ERROR"), limit=10) == ["2"]
    assert ids(start_time="2023-10-10 13:56:00", end_time="2023-10-10 14:00:00") == ["1"]
    assert ids(limit=2, offset=1, sort_by="log_type", sort_desc=False) == ["1", "2"]
    assert Q.total_count(logs, Q.LogQuery(source="^H$")).first()["total_count"] == 4


def test_exports(spark, tmp_dir):
    logs = _logs(spark)
    sinks.export(logs.select("log_id", "network_info", "level"), os.path.join(tmp_dir, "csv"), "csv")
    back = spark.read.option("header", "true").csv(os.path.join(tmp_dir, "csv"))
    assert back.count() == 4 and "network_info" in back.columns
    sinks.export(logs.select("log_id", "level"), os.path.join(tmp_dir, "json"), "json")
    assert spark.read.json(os.path.join(tmp_dir, "json")).count() == 4
