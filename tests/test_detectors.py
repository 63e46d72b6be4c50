"""Detectors on hand-made log tables (the driver's data is too uniform to
fire most of them)."""
import datetime as dt

from pyspark.sql import functions as F

from logsift.operators import anomalies as D
from logsift.operators.templates import template_stats

AS_OF = dt.datetime(2024, 1, 31)
SCHEMA = ("log_id string, ingest_seq long, timestamp timestamp, level string, message string, "
          "source string, template_id string, template string")


def _logs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("event_date", F.to_date("timestamp"))


def _hourly(start, hours, per_hour, level="INFO", source="s1", tmpl="t1", spike=None):
    rows, seq = [], 0
    for h in range(hours):
        n = per_hour + (h % 3)  # some variation
        if spike and h == spike[0]:
            n = spike[1]
        for k in range(n):
            ts = start + dt.timedelta(hours=h, minutes=(k * 7) % 60)
            rows.append((f"l{seq}", seq, ts, level, "msg", source, tmpl, "msg"))
            seq += 1
    return rows


def test_volume_spike(spark):
    start = AS_OF - dt.timedelta(hours=30)
    logs = _logs(spark, _hourly(start, 30, 10, spike=(28, 80)))
    out = D.detect_volume(logs, AS_OF, hours=48).collect()
    spikes = [r for r in out if r["anomaly_type"] == "VOLUME_SPIKE"]
    assert len(spikes) == 1
    assert spikes[0]["timestamp"] == start + dt.timedelta(hours=28)
    assert spikes[0]["log_count"] == 80
    # the tested hour is inside its own window: |z| <= (w-1)/sqrt(w)
    assert spikes[0]["score"] <= 23 / (24 ** 0.5) + 1e-9
    assert spikes[0]["description"].startswith("Unusual spike in log volume: 80 logs (z-score: ")


def test_volume_needs_three_hours(spark):
    logs = _logs(spark, _hourly(AS_OF - dt.timedelta(hours=2), 2, 5))
    assert D.detect_volume(logs, AS_OF).count() == 0


def test_error_rate(spark):
    start = AS_OF - dt.timedelta(hours=10)
    rows = _hourly(start, 10, 10)
    # last-but-one hour: 9 of 10 rows are errors
    bad_hour = start + dt.timedelta(hours=8)
    rows = [(a, b, c, "ERROR" if (c >= bad_hour and c < bad_hour + dt.timedelta(hours=1)
                                  and b % 10 != 0) else d, e, f, g, h)
            for a, b, c, d, e, f, g, h in rows]
    out = D.detect_error_rate(_logs(spark, rows), AS_OF).collect()
    assert len(out) == 1
    r = out[0]
    assert r["timestamp"] == bad_hour and r["severity"] == "CRITICAL"
    assert r["description"].startswith("High error rate detected: ")


def test_error_rate_absent_levels_count_zero(spark):
    logs = _logs(spark, _hourly(AS_OF - dt.timedelta(hours=5), 5, 4))
    assert D.detect_error_rate(logs, AS_OF).count() == 0


def test_source_silence(spark):
    start = AS_OF - dt.timedelta(hours=12)
    loud = _hourly(start, 12, 8, source="loud")
    quiet = [r for r in _hourly(start, 12, 8, source="quiet", tmpl="t2")
             if r[2] < start + dt.timedelta(hours=10)]
    quiet = [(f"q{i}", 10_000 + i, *r[2:]) for i, r in enumerate(quiet)]
    out = D.detect_source_silence(_logs(spark, loud + quiet), AS_OF).collect()
    assert [r["source"] for r in out] == ["quiet"]
    assert out[0]["description"].startswith("Source 'quiet' has gone silent (usually produces ")


def test_rare_template_rule_cannot_fire(spark):
    """The 2-hour window lies inside the 7-day history, so a template's recent
    count is at most its history count, which is at most P5 for a rare
    template: recent > 3 x P5 never holds.  The rule is kept as written."""
    start = AS_OF - dt.timedelta(days=6)
    rows, seq = [], 0
    for t in range(40):
        n = 1 if t < 10 else 50
        for k in range(n):
            rows.append((f"c{seq}", seq, start + dt.timedelta(hours=(k * 3) % 140), "INFO", "m",
                         "s", f"t{t}", f"t {t}"))
            seq += 1
    for k in range(8):  # a burst of a once-rare template in the last hour
        rows.append((f"r{k}", seq, AS_OF - dt.timedelta(minutes=5 + k), "INFO", "r", "s", "t0",
                     "t 0"))
        seq += 1
    logs = _logs(spark, rows)
    assert D.detect_rare_templates(logs, AS_OF).count() == 0
    # the pieces still compute: 7-day counts and their 5th percentile
    hist = logs.groupBy("template_id").count()
    p5 = hist.agg(F.percentile("count", 0.05)).first()[0]
    assert p5 == 1.0


def test_new_templates_uses_history(spark):
    old = AS_OF - dt.timedelta(days=3)
    rows = [("a", 1, old, "INFO", "m", "s", "t_old", "old"),
            ("b", 2, AS_OF - dt.timedelta(hours=1), "INFO", "m", "s", "t_old", "old"),
            ("c", 3, AS_OF - dt.timedelta(hours=2), "INFO", "m", "s", "t_new", "new")]
    logs = _logs(spark, rows)
    out = D.detect_new_templates(logs, template_stats(logs), AS_OF).collect()
    assert len(out) == 1 and out[0]["new_template_count"] == 1
    assert out[0]["total_template_count"] == 2 and out[0]["severity"] == "HIGH"


def test_run_detection_union(spark):
    start = AS_OF - dt.timedelta(hours=30)
    logs = _logs(spark, _hourly(start, 30, 10, spike=(28, 80)))
    out = D.run_detection(logs, template_stats(logs), AS_OF, 48, include_ml=True)
    types = {r["anomaly_type"] for r in out.collect()}
    assert "VOLUME_SPIKE" in types
