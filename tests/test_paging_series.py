"""Deep pages, cursors, named filters, response defaults; hourly series of any length."""
import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from logsift.operators import anomalies as D
from logsift.operators import query as Q
from logsift.operators import stats as S


def _table(spark, tmp_dir):
    at = dt.datetime(2024, 1, 1)
    rows = [(f"id{i:05d}", at + dt.timedelta(minutes=37 * (i // 3)), ["INFO", "ERROR", None][i % 3], f"s{i % 5}") for i in range(900)]
    df = spark.createDataFrame(rows, "log_id string, timestamp timestamp, level string, source string")
    df.withColumn("event_date", F.to_date("timestamp")).write.partitionBy("event_date").parquet(tmp_dir + "/t")
    return spark.read.parquet(tmp_dir + "/t").withColumns({"parsed_fields": F.create_map(
        F.lit("userId"), F.concat(F.lit("U"), F.substring("log_id", 5, 3)), F.lit("user_agent"), F.lit("Curl/8")),
        "filename": F.lit("f")})


def _ids(df):
    return [r["log_id"] for r in df.collect()]


def test_deep_page_equals_offset_and_reads_its_dates(spark, tmp_dir):
    logs = _table(spark, tmp_dir)
    for desc in (True, False):
        for level in (None, "ERROR"):
            for offset in (0, 37, 100, 299, 600, 895, 2000):
                q = Q.LogQuery(level=level, offset=offset, limit=17, sort_desc=desc)
                assert _ids(Q.deep_page(logs, q)) == _ids(Q.query_logs(logs, q)), (desc, level, offset)
    q = Q.LogQuery(offset=600, limit=10)
    plan = Q.deep_page(logs, q)._jdf.queryExecution().executedPlan().toString()
    dates = [r["event_date"] for r in logs.select("event_date").distinct().collect()]
    assert sum(str(d) in plan or str((d - dt.date(1970, 1, 1)).days) in plan for d in dates) <= 2


def test_cursor_walks_every_row_once(spark, tmp_dir):
    logs = _table(spark, tmp_dir)
    for sort_by in ("timestamp", "level", "source"):
        for desc in (True, False):
            q = Q.LogQuery(limit=250, sort_by=sort_by, sort_desc=desc)
            got, cursor = [], None
            for _ in range(9):
                page = Q.next_page(logs, q, cursor).collect()
                if not page:
                    break
                got += [r["log_id"] for r in page]
                cursor = (page[-1][sort_by], page[-1]["log_id"])
            assert got == _ids(logs.orderBy(*Q.order_columns(q))), (sort_by, desc)


def test_named_filters_and_response(spark, tmp_dir):
    logs = _table(spark, tmp_dir)
    assert _ids(Q.matching(logs, Q.LogQuery(user_id="u007", user_agent="curl"))) == ["id00007"]
    assert Q.matching(logs, Q.LogQuery(session_id="x")).count() == 0
    row = Q.respond(logs.drop("parsed_fields")).first()
    assert row["parsed_fields"] == {} and row["metadata"] == {} and row["network_info"] == "{}" and row["template"] is None


def test_calendar_and_windows_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "HOURS_PER_BLOCK", 30)
    rng = np.random.default_rng(3)
    at = dt.datetime(2024, 1, 1)
    rows = [(at + dt.timedelta(hours=int(h), minutes=int(m)),) for h, m in zip(rng.integers(0, 200, 700), rng.integers(0, 60, 700))
            if h not in (40, 41, 90)] + [(at,), (at + dt.timedelta(hours=199),)]
    series = D.hourly_volume(spark.createDataFrame(rows, "timestamp timestamp"))
    counts = np.zeros(200)
    for (t,) in rows:
        counts[int((t - at).total_seconds() // 3600)] += 1
    for exclude in (False, True):
        got = {r["hour"]: r for r in D.rolling_z(series, exclude_current=exclude).collect()}
        assert len(got) == 200
        for i in range(200):
            r = got[at + dt.timedelta(hours=i)]
            assert r["n"] == counts[i]
            w = 24
            window = counts[i - w:i] if exclude else counts[i - w + 1:i + 1]
            if len(window) < w or i < (w if exclude else w - 1):
                assert r["rolling_mean"] is None
            else:
                assert abs(r["rolling_mean"] - window.mean()) < 1e-9 and abs(r["rolling_std"] - window.std(ddof=1)) < 1e-9


def test_a_line_of_the_year_one_or_9999_makes_no_large_row(spark):
    rows = [(dt.datetime(1800, 1, 1),), (dt.datetime(2024, 1, 1),), (dt.datetime(2300, 12, 31, 23),)]
    cal = S.hour_calendar(spark.createDataFrame(rows, "hour timestamp"))
    out = cal.agg(F.count("*"), F.max("index"), F.max("n_hours"), F.min("hour")).first()
    hours = int((rows[2][0] - rows[0][0]).total_seconds() // 3600) + 1
    assert tuple(out)[:3] == (hours, hours - 1, hours) and out[3] == rows[0][0]
    assert S.hour_calendar(spark.createDataFrame([], "hour timestamp")).count() == 0
