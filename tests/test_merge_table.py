"""Merge tables behind snapshots, and the incremental template store."""
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from logsift.operators import mining
from logsift.operators.merge_table import MergeTable, TemplateStore
from logsift.streaming import streams as R


def _sum(df):
    return df.groupBy("k").agg(F.sum("n").alias("n"))


def _rows(table, snapshot=None):
    df = table.read(snapshot)
    return None if df is None else {r.k: r.n for r in df.collect()}


def _batch(spark, **kn):
    return spark.createDataFrame(list(kn.items()), "k string, n long")


def test_batches_snapshots_and_redone_batches(spark, tmp_dir):
    t = MergeTable(spark, tmp_dir + "/t", _sum)
    assert _rows(t) is None
    assert t.add(_batch(spark, a=1, b=2), "s", 0)
    before = t.snapshots.newest()
    assert t.add(_batch(spark, b=3, c=4), "s", 1)
    assert not t.add(_batch(spark, b=3, c=4), "s", 1)       # done again: nothing
    assert not t.add(_batch(spark, a=1), "s", 0)
    assert t.add(_batch(spark, a=10), "other", 0)
    assert _rows(t) == {"a": 11, "b": 5, "c": 4}
    assert _rows(t, before) == {"a": 1, "b": 2}             # a reader on the old snapshot
    t.compact()
    assert t.snapshots.newest()["deltas"] == [] and _rows(t) == {"a": 11, "b": 5, "c": 4}
    t.add(_batch(spark, d=1), "s", 2)
    t.vacuum()
    assert _rows(t) == {"a": 11, "b": 5, "c": 4, "d": 1}
    assert len(t.snapshots.numbers()) == 2
    assert len([n for n in os.listdir(t.path) if n.startswith(("base", "delta"))]) == 2


def test_a_writer_that_loses_the_race_tries_again(spark, tmp_dir, monkeypatch):
    t = MergeTable(spark, tmp_dir + "/t", _sum)
    t.add(_batch(spark, a=1), "s", 0)
    old, calls = t.snapshots.newest(), []
    real = t.snapshots.newest

    def stale():
        calls.append(1)
        return old if len(calls) == 1 else real()

    MergeTable(spark, t.path, _sum).add(_batch(spark, a=5), "s2", 0)
    monkeypatch.setattr(t.snapshots, "newest", stale)
    t.add(_batch(spark, a=100), "s", 1)
    assert len(calls) == 2 and _rows(MergeTable(spark, t.path, _sum)) == {"a": 106}


def test_half_written_snapshot_is_not_read(spark, tmp_dir):
    t = MergeTable(spark, tmp_dir + "/t", _sum)
    t.add(_batch(spark, a=1))
    with open(f"{t.path}/snapshots/000000000002.json", "w") as f:
        f.write('{"number": 2, "del')
    assert _rows(t) == {"a": 1}


def _logs(spark, rows):
    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(m, s, at + dt.timedelta(seconds=s)) for s, m in rows],
                                 "template string, ingest_seq long, timestamp timestamp")


ROWS = list(enumerate([f"disk sd{i % 9} is full" for i in range(20)] + ["fan ok", "fan ok"] +
                      [f"user u{i} came from h{i % 4}" for i in range(30)] + [f"user u{i} left early today" for i in range(9)]))


@pytest.mark.parametrize("cuts", [(1, 25), (21, 22), (30, 31)])
def test_store_in_batches_equals_one_batch(spark, tmp_dir, cuts):
    one = mining.mined_stats(mining.mine_messages(mining.message_stats(_logs(spark, ROWS))))
    store = TemplateStore(spark, f"{tmp_dir}/{cuts}")
    bounds = [0, *cuts, len(ROWS)]
    first = None
    for i in range(3):
        batch = _logs(spark, ROWS[bounds[i]:bounds[i + 1]])
        store.add(batch, "s", i)
        store.add(batch, "s", i)        # done again
        first = first or {r.template_id: r for r in store.templates().collect()}
    key = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    assert key(store.templates()) == key(one)
    last = {r.template_id: r for r in store.templates().collect()}
    assert all(last[t].first_seen == r.first_seen for t, r in first.items())
    rows = store.assign(_logs(spark, ROWS)).collect()
    assert all(r.cluster_size == last[r.mined_template_id]["count"] for r in rows) and len(rows) == len(ROWS)


def test_unmined_messages_have_fallback_ids_until_mined(spark, tmp_dir):
    store = TemplateStore(spark, tmp_dir + "/f")
    store.messages.add(mining.message_stats(_logs(spark, ROWS[:5])), "s", 0)   # a job that died here
    assert {r.mined_template_id[:9] for r in store.read().collect()} == {"fallback_"}
    store.add(_logs(spark, ROWS[:5]), "s", 0)
    rows = store.read().collect()
    assert {r.mined_template_id[:5] for r in rows} == {"tmpl_"} and sum(r.rows for r in rows) == 5


def test_streams_into_merge_table(spark, tmp_dir):
    src = tmp_dir + "/src"
    logs = _logs(spark, ROWS).withColumn("template_id", F.md5("template")).withColumn("log_id", F.col("ingest_seq"))
    logs.repartition(4).write.parquet(src)
    from logsift.operators.merge_table import merge_stats
    from logsift.operators.templates import template_stats

    def run(ck):
        s = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", "1").parquet(src)
        R.start_merge_sink(s, tmp_dir + "/t", tmp_dir + ck, {"availableNow": True}).awaitTermination()
        return {tuple(r) for r in MergeTable(spark, tmp_dir + "/t", merge_stats).read().collect()}

    want = {tuple(r) for r in template_stats(logs).select("template_id", "template", "count", "first_seen", "last_seen").collect()}
    assert run("/ck") == want
    logs.limit(0).coalesce(1).write.mode("append").parquet(src)
    assert run("/ck") == want       # restarted from its checkpoint: nothing twice
