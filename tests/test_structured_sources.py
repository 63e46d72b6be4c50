"""Single entries (S5), collector JSON filter (S10), container time (S11) and
the priority syslog parser (S12)."""
import datetime as dt

from pyspark.sql import functions as F

from logsift.schema import ENTRY_SCHEMA
from logsift.sources import structured as ST


def test_entries_given_fields_win(spark):
    rows = [(dt.datetime(2024, 1, 1, 5), "DEBUG", "Dec  1 10:00:00 web1 cron: job failed", "api",
             {"k": "v"}),
            (None, None, "fw DENY SRC=1.2.3.4 DST=5.6.7.8", None, None)]
    df = spark.createDataFrame(rows, ENTRY_SCHEMA)
    out = {r["message"]: r for r in ST.entries_to_logs(
        df, ingest_ts=F.lit("2024-02-01 00:00:00").cast("timestamp")).collect()}
    a = out["job failed"]
    assert a["level"] == "DEBUG" and a["timestamp"] == dt.datetime(2024, 1, 1, 5)
    assert a["source"] == "api" and a["metadata"]["k"] == "v" and a["log_type"] == "syslog"
    b = out["fw DENY SRC=1.2.3.4 DST=5.6.7.8"]
    assert b["level"] == "WARN" and b["timestamp"] == dt.datetime(2024, 2, 1)
    assert b["network_info"]["src_ip"] == "1.2.3.4"


def test_json_log_filter_and_container_time(spark):
    rows = [({"log": '{"msg": "hi", "time": "2024-01-01T00:00:01.250Z"}', "stream": "stdout"},),
            ({"log": "plain text", "stream": "stderr"},)]
    df = spark.createDataFrame(rows, "record map<string,string>")
    out = ST.json_log_filter(df).select(
        "record", ST.container_time(F.col("record")).alias("t")).collect()
    r0, r1 = out[0], out[1]
    assert r0["record"]["msg"] == "hi" and r0["record"]["stream"] == "stdout" and "log" in r0["record"]
    assert r0["t"] == dt.datetime(2024, 1, 1, 0, 0, 1, 250000)
    assert r1["record"] == {"log": "plain text", "stream": "stderr"} and r1["t"] is None


def test_priority_syslog(spark):
    df = spark.createDataFrame([("<34>Oct 11 22:14:15 mymachine su[230]: 'su root' failed",),
                                ("no priority here",)], "line string")
    r = ST.parse_syslog_pri(df).orderBy("line").collect()
    hit = [x for x in r if x["pri"] is not None][0]
    assert (hit["pri"], hit["facility"], hit["severity"], hit["level"]) == (34, 4, 2, "CRITICAL")
    assert (hit["host"], hit["ident"], hit["pid"]) == ("mymachine", "su", "230")
    assert hit["message"] == "'su root' failed"
    miss = [x for x in r if x["pri"] is None][0]
    assert miss["host"] is None
