"""Rollups merge, match exact counts, and need one scan."""
import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from logsift.operators import rollup as RU
from logsift.operators import stats as S

SCHEMA = ("timestamp timestamp, file_id string, level string, message string, source string, template_id string, "
          "network_info struct<ip_addresses:array<string>,protocols:array<string>>")


def _logs(spark, n=6000):
    rng = np.random.default_rng(1)
    at = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        ips = [f"10.0.{rng.integers(60)}.{rng.integers(200)}" for _ in range(rng.integers(0, 3))]
        net = None if i % 5 == 0 else (ips, ["TCP", "UDP"][: rng.integers(0, 3)] or None)
        rows.append((at + dt.timedelta(minutes=int(rng.integers(0, 3000))), f"f{i % 3}", ["INFO", "ERROR", None, "CRITICAL"][i % 4],
                     f"job took {int(rng.lognormal(5, 2))} ms" if i % 2 else "plain", f"s{i % 40}", f"t{rng.integers(900)}", net))
    return spark.createDataFrame(rows, SCHEMA)


def test_rollup_against_exact(spark):
    logs = _logs(spark).cache()
    r = RU.build(logs).cache()
    exact = {(x.file_id, x.level): x["count"] for x in logs.groupBy("file_id", "level").count().collect()}
    assert {(x.file_id, x.level): x["count"] for x in RU.level_counts(r, "file_id").collect()} == exact
    # the rollups of two halves, put together, are a rollup of the whole
    both = RU.build(logs.where("hash(message, timestamp) % 2 = 0")).union(RU.build(logs.where("hash(message, timestamp) % 2 <> 0")))
    want = {x.file_id: x for x in S.file_network(logs).collect()}
    one = sorted(map(tuple, RU.file_network(r).collect()))
    for a, b in zip(sorted(map(tuple, RU.file_network(both).collect())), one):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) <= 0.002 * b[3]
    for f, rows, protocols, ips in one:
        assert rows == want[f].logs_with_network_info and protocols == want[f].unique_protocols
        assert abs(ips - want[f].unique_ips) <= 0.0326 * want[f].unique_ips
    net, full = RU.network_summary(r).first(), S.network_summary(logs).first()
    assert net[0] == full[0] and abs(net[1] - full[1]) <= 0.0326 * full[1]
    got = {x.hour: x for x in RU.hourly_features(r).collect()}
    for x in S.hourly_features(logs).collect():
        y = got[x.hour]
        assert (y.n_logs, y.n_errors, y.hour_of_day, y.day_of_week) == (x.n_logs, x.n_errors, x.hour_of_day, x.day_of_week)
        assert abs(y.n_templates - x.n_templates) <= 1 and y.n_sources == x.n_sources
    plan = RU.file_stats(spark.createDataFrame([], r.schema))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1
    logs.unpersist(), r.unpersist()


def test_response_time_quantiles(spark):
    logs = _logs(spark)
    ms = sorted(float(x.m) for x in logs.select(F.regexp_extract("message", r"took (\d+) ms", 1).alias("m")).where("m <> ''").collect())
    out = RU.response_times(RU.build_latency(logs)).first()
    assert out.timed == len(ms) and abs(out.mean_ms - np.mean(ms)) < 1e-6
    for name, q in (("p50_ms", 0.5), ("p95_ms", 0.95), ("p99_ms", 0.99)):
        want = ms[int(np.ceil(q * len(ms))) - 1]
        assert abs(out[name] - want) <= 0.01 * want
    assert RU.response_times(RU.build_latency(logs.where("message = 'plain'")), "file_id").collect() == []
