"""Stream detectors on a replayed feed against the batch detectors."""
import datetime as dt

from pyspark.sql import functions as F

from logsift.operators import anomalies as D
from logsift.streaming import detectors as S

AT = dt.datetime(2024, 1, 1)


def _feed(spark, tmp_dir):
    """30 hours of three sources; b stops at hour 20, c has few rows; hour 25 is bad."""
    rows = []
    for h in range(30):
        for k in range(9):
            t = AT + dt.timedelta(hours=h, minutes=6 * k)
            rows.append((t, "ERROR" if h == 25 and k % 2 else "INFO", "a"))
            if h < 20:
                rows.append((t, "INFO", "b"))
        if h < 12:
            rows.append((AT + dt.timedelta(hours=h), "WARN" if h == 3 else "INFO", "c"))
    rows.append((AT + dt.timedelta(hours=40), "INFO", "end"))      # moves the watermark over all
    df = spark.createDataFrame(rows, "timestamp timestamp, level string, source string")
    for i, (lo, hi) in enumerate([(0, 7), (7, 21), (21, 24), (24, 31), (31, 50)]):
        part = df.where((F.col("timestamp") >= AT + dt.timedelta(hours=lo)) & (F.col("timestamp") < AT + dt.timedelta(hours=hi)))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_dir}/feed")
    return df


def _run(spark, tmp_dir, detector, name):
    schema = "timestamp timestamp, level string, source string"
    for _ in range(2):      # a second run on the same checkpoint adds nothing
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(f"{tmp_dir}/feed")
        q = (detector(s).writeStream.format("parquet").option("path", f"{tmp_dir}/{name}")
             .option("checkpointLocation", f"{tmp_dir}/ck-{name}").trigger(availableNow=True).start())
        q.awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_dir}/{name}").collect())


def test_silence_equals_batch_at_its_time(spark, tmp_dir):
    df = _feed(spark, tmp_dir)
    got = [r for r in _run(spark, tmp_dir, S.silence_stream, "silence") if r[0] <= AT + dt.timedelta(hours=30)]
    at = AT + dt.timedelta(hours=22)        # b: two whole hours after its last row's
    logs = df.where(F.col("timestamp") < at).withColumn("template_id", F.lit("t"))
    want = D.detect_source_silence(logs, at, 24).select(
        "timestamp", "anomaly_type", "severity", "description", "log_count", "score", "source").collect()
    assert [tuple(r) for r in want] == got and got[0][6] == "b"


def test_error_rate_equals_batch_of_each_hour(spark, tmp_dir):
    df = _feed(spark, tmp_dir)
    got = _run(spark, tmp_dir, S.error_rate_stream, "errors")
    want = []
    for h in (3, 4, 24, 25, 26):
        end = AT + dt.timedelta(hours=h + 1)
        hits = D.detect_error_rate(df.where(F.col("timestamp") < end), end, 24).collect()
        want += [(r["timestamp"], r["anomaly_type"], r["severity"], r["description"], r["log_count"])
                 for r in hits if r["timestamp"] == AT + dt.timedelta(hours=h)]
    assert [r[:5] for r in got] == want and [r[0].hour for r in got] == [1]
