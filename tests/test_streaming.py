"""Streaming jobs over files written to a temporary folder."""
import glob
import json
import os

from pyspark.sql import functions as F

from logsift.streaming import streams as R


def test_collector_stream_to_table_and_counts(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    recs = [
        {"log": "Dec  1 10:00:00 web1 sshd[42]: Failed password from 10.0.0.1", "time": "2024-01-01T10:00:00Z",
         "tag": "file.auth"},
        {"log": '{"message": "ok", "level": "info"}', "time": "bad time", "source": "api"},
        {"log": "fw DENY SRC=1.2.3.4 DST=5.6.7.8", "time": "2024-01-01T10:30:00Z"},
    ]
    with open(os.path.join(src, "batch1.json"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in recs) + "\n")
    logs_stream = R.collector_stream(spark, src)
    table = os.path.join(tmp_dir, "logs")
    q = R.start_logs_sink(logs_stream, table, os.path.join(tmp_dir, "ck1"), {"availableNow": True})
    q.awaitTermination()
    rows = {r["message"]: r for r in spark.read.parquet(table).collect()}
    assert rows["Failed password from 10.0.0.1"]["source"] == "file.auth"
    assert rows["Failed password from 10.0.0.1"]["level"] == "ERROR"
    assert rows["ok"]["source"] == "api"
    assert rows["fw DENY SRC=1.2.3.4 DST=5.6.7.8"]["source"] == "fluent-bit"
    assert rows["fw DENY SRC=1.2.3.4 DST=5.6.7.8"]["level"] == "WARN"

    # streaming hourly counts equal the batch counts over the same rows
    stream = spark.readStream.schema(spark.read.parquet(table).schema).parquet(table)
    out = os.path.join(tmp_dir, "hourly")
    q2 = R.start_table_sink(R.hourly_level_counts(stream), out, os.path.join(tmp_dir, "ck2"),
                            "complete", {"availableNow": True})
    q2.awaitTermination()
    got = {(r["hour"], r["level"], r["count"]) for r in spark.read.parquet(out).collect()}
    batch = (spark.read.parquet(table)
             .groupBy(F.date_trunc("hour", "timestamp").alias("hour"), "level").count().collect())
    assert got == {(r["hour"], r["level"], r["count"]) for r in batch}


def test_file_tail_stream(spark, tmp_dir):
    d = os.path.join(tmp_dir, "var")
    os.makedirs(d)
    with open(os.path.join(d, "app.log"), "w") as f:
        f.write("2024-01-01 00:00:00 ERROR 4004 svc-a failed\n\n<131>disk\n")
    s = R.file_tail_stream(spark, d, host="host-x")
    out = os.path.join(tmp_dir, "t")
    q = R.start_logs_sink(s, out, os.path.join(tmp_dir, "ck"), {"availableNow": True})
    q.awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted(r["log_type"] for r in rows) == ["unknown", "windows_event"]
    assert {r["source"] for r in rows} == {"host-x"}


def test_live_feed_dedupes_and_keeps_newest(spark, tmp_dir):
    import datetime as dt
    src = os.path.join(tmp_dir, "feed_in")
    os.makedirs(src)
    base = dt.datetime(2024, 1, 1, 12, 0, 0)
    rows = [{"log_id": f"id{i % 25}", "timestamp": (base + dt.timedelta(seconds=i % 25)).isoformat(),
             "level": "INFO", "message": f"m{i % 25}", "source": "s"} for i in range(40)]
    with open(os.path.join(src, "a.json"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows) + "\n")
    schema = "log_id string, timestamp timestamp, level string, message string, source string"
    stream = spark.readStream.schema(schema).json(src)
    out = os.path.join(tmp_dir, "feed")
    q = R.live_feed(stream, out, os.path.join(tmp_dir, "ckf"), keep=20, trigger={"availableNow": True})
    q.awaitTermination()
    got = spark.read.parquet(f"{out}/batch=0").collect()
    assert len(got) == 20
    assert len({r["log_id"] for r in got}) == 20
    assert min(r["timestamp"] for r in got) == base + dt.timedelta(seconds=5)


def test_periodic_detection_appends_anomalies(spark, tmp_dir):
    import datetime as dt
    import time

    start = dt.datetime(2024, 1, 1)
    rows, seq = [], 0
    for h in range(30):
        n = 80 if h == 28 else 10 + h % 3
        for k in range(n):
            rows.append((f"l{seq}", seq, start + dt.timedelta(hours=h, minutes=k % 60), "INFO", "m",
                         "s1", "t1", "m"))
            seq += 1
    logs = spark.createDataFrame(rows, "log_id string, ingest_seq long, timestamp timestamp, "
                                       "level string, message string, source string, "
                                       "template_id string, template string")
    logs_path = os.path.join(tmp_dir, "logs")
    logs.withColumn("event_date", F.to_date("timestamp")).write.partitionBy("event_date").parquet(logs_path)
    an_path = os.path.join(tmp_dir, "anomalies")
    q = R.periodic_detection(spark, logs_path, an_path, os.path.join(tmp_dir, "ckd"),
                             interval="1 second", hours=24 * 365 * 10)
    try:
        deadline = time.time() + 120
        while time.time() < deadline and not glob.glob(os.path.join(an_path, "run=*", "detector=volume", "_SUCCESS")):
            time.sleep(1)
    finally:
        q.stop()
    got = spark.read.parquet(an_path)
    assert got.where(F.col("anomaly_type") == "VOLUME_SPIKE").count() >= 1
    assert "created_at" in got.columns


def _collector_input(tmp_dir, n=3):
    src = os.path.join(tmp_dir, "records")
    os.makedirs(src)
    with open(os.path.join(src, "a.json"), "w") as f:
        for i in range(n):
            f.write(json.dumps({"log": f"job {i} ok", "time": f"2024-01-01T10:00:0{i}Z", "tag": "t"}) + "\n")
    return src


def test_a_batch_done_again_keeps_each_row_once(spark, tmp_dir):
    src, table, ck = _collector_input(tmp_dir), os.path.join(tmp_dir, "logs"), os.path.join(tmp_dir, "ck")
    for _ in range(2):
        R.start_logs_sink(R.collector_stream(spark, src), table, ck, {"availableNow": True}).awaitTermination()
        for f in glob.glob(os.path.join(ck, "commits", "*")) + glob.glob(os.path.join(ck, "commits", ".*.crc")):
            os.remove(f)        # the commit is lost: the next start does the batch again
    rows = spark.read.parquet(table)
    assert rows.count() == rows.select("log_id").distinct().count() == 3


def test_live_feed_of_the_collector_stream(spark, tmp_dir):
    src, out = _collector_input(tmp_dir), os.path.join(tmp_dir, "feed")
    R.live_feed(R.collector_stream(spark, src), out, os.path.join(tmp_dir, "ck"), keep=2,
                trigger={"availableNow": True}).awaitTermination()
    assert [r["message"] for r in spark.read.parquet(f"{out}/batch=0").orderBy("message").collect()] == ["job 1 ok", "job 2 ok"]


def test_a_failing_detector_leaves_the_others(spark, monkeypatch):
    import datetime as dt

    from logsift.operators import anomalies as D
    from logsift.operators.templates import template_stats

    rows = [(i, dt.datetime(2024, 1, 1, i % 24), "INFO", "m", "s", "t", "m") for i in range(48)]
    logs = spark.createDataFrame(rows, "ingest_seq long, timestamp timestamp, level string, message string, "
                                       "source string, template_id string, template string")
    logs = logs.withColumn("event_date", F.to_date("timestamp"))
    volume = D.detect_volume
    # fails when it runs, not when it is planned
    monkeypatch.setattr(D, "detect_volume", lambda *a: volume(*a).withColumn(
        "log_count", F.raise_error(F.lit("broken")).cast("bigint")).unionByName(
            volume(*a).limit(0)))
    monkeypatch.setattr(D, "detect_error_rate", lambda *a: D.detect_source_silence(*a).select(F.col("no_such_column")))
    done = {}
    run = D.run_detection(logs, template_stats(logs), dt.datetime(2024, 1, 2), 24, include_ml=False,
                          sink=lambda name, df: done.update({name: df.collect()}))
    assert "error_rate" in run.failed and "rare_templates" in run.written and "source_silence" in run.written
    assert set(run.failed) | set(run.written) == {"volume", "error_rate", "new_templates", "rare_templates", "source_silence"}
