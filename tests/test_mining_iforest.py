"""Template mining and the isolation forest: order-free, mergeable, exact."""
import datetime as dt

import duckdb
import numpy as np
import pytest

from logsift.operators import iforest as IF
from logsift.operators import mining as T


def _messages(spark):
    rows = []
    for i in range(300):
        rows.append((f"conn from host{i % 17} port {i % 5}", i))
        rows.append((f"job {i % 3} finished in {i % 7} ms", 1000 + i))
    return spark.createDataFrame(rows, "template string, ingest_seq long")


def _mapping(df, **kw):
    return {r["message"]: (r["mined_template_id"], r["mined_template"], r["cluster_size"])
            for r in T.mine_templates(df, **kw).collect()}


def _one_leaf(n=400):
    """Messages of one path, of frequent and rare kinds."""
    rng = np.random.default_rng(1)
    kinds = ["svc worker handled request {0} in {1} ms", "svc worker lost connection to {0} after {1}",
             "svc worker {0} wrote {1} bytes ok", "svc worker retry number {0} for {1}"]
    out, i = [], 0
    while len(out) < n:
        k = kinds[min(3, int(rng.exponential(0.8)))]
        out.append((k.format(f"v{i}", f"u{rng.integers(40)}"), i))
        i += 1
    return out


def test_every_row_one_template_and_members_match(spark):
    msgs = _messages(spark)
    m = T.mine_templates(msgs).collect()
    assert len(m) == msgs.select("template").distinct().count()
    for r in m:
        toks, tmpl = r["message"].split(" "), r["mined_template"].split(" ")
        assert len(toks) == len(tmpl)
        assert all(b == "<*>" or a == b for a, b in zip(toks, tmpl))
    sizes = {r["mined_template_id"]: r["cluster_size"] for r in m}
    assert sum(sizes.values()) == sum(r["rows"] for r in m)
    assert {r["mined_template"] for r in m} == {"conn from <*> port <*>", "job <*> finished in <*> ms"}


def test_one_mapping_at_every_size_and_partitioning(spark):
    rows = _one_leaf()
    df = spark.createDataFrame(rows, "template string, ingest_seq long")
    whole = _mapping(df)
    assert len({t for _, t, _ in whole.values()}) == 4
    for parts in (1, 3, 9):
        assert _mapping(df.repartition(parts)) == whole
    # one message more or less changes no template of the others
    for n in (399, 401):
        other = _mapping(spark.createDataFrame(_one_leaf(n), "template string, ingest_seq long"))
        assert all(other[m][:2] == whole[m][:2] for m in whole if m in other)


def test_rare_kinds_are_not_drowned_by_frequent_ones(spark):
    rows = [(f"user login ok from h{i}", i) for i in range(200)] + [(f"user reset password by admin{i}", 500 + i) for i in range(3)]
    got = {t for _, t, _ in _mapping(spark.createDataFrame(rows, "template string, ingest_seq long")).values()}
    assert got == {"user login ok from <*>", "user reset password by <*>"}


def test_odd_messages(spark):
    rows = [("", 0), ("one", 1), ("<*>", 2), ("<*> <*> <*>", 3), ("a b", 4), (None, 5), ("a b", 6),
            ("p q r1 s1 t1 u1", 7), ("p q r2 s2 t2 u2", 8), ("  x", 9)]
    got = _mapping(spark.createDataFrame(rows, "template string, ingest_seq long"))
    assert set(got) == {m for m, _ in rows if m is not None}
    assert got["a b"][2] == 2 and got[""][1] == ""
    # too little in common: each its own
    assert got["p q r1 s1 t1 u1"][0] != got["p q r2 s2 t2 u2"][0]


def test_batches_merged_equal_one_batch_and_ids_stay(spark):
    rows = _one_leaf(300) + [(f"disk sd{i} is full", 1000 + i) for i in range(30)] + [("disk sda is full", 2000)]
    at = dt.datetime(2024, 1, 1)
    full = [(m, s, at + dt.timedelta(seconds=s)) for m, s in rows]
    schema = "template string, ingest_seq long, timestamp timestamp"
    one = T.mine_messages(T.message_stats(spark.createDataFrame(full, schema)))
    parts = [T.message_stats(spark.createDataFrame(full[i::3], schema)) for i in range(3)]
    merged = T.mine_messages(T.merge_message_stats(*parts))
    key = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    assert key(one) == key(merged)
    # a template that widens keeps its id and first_seen
    early = T.mined_stats(T.mine_messages(T.message_stats(spark.createDataFrame([full[-31]], schema)))).collect()[0]
    late = {r.template_id: r for r in T.mined_stats(one).collect()}
    assert late[early.template_id].first_seen == early.first_seen
    assert early.template == "disk sd0 is full" and late[early.template_id].template == "disk <*> is full"


def test_sql_of_the_rule(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(m, s, at) for m, s in _one_leaf(200)] + [("", 900, at), ("<*> x", 901, at), ("a b 1 2 3 4 5 6", 902, at)]
    con = duckdb.connect()
    con.execute("CREATE TABLE src (template VARCHAR, ingest_seq BIGINT, timestamp TIMESTAMP)")
    con.executemany("INSERT INTO src VALUES (?, ?, ?)", rows)
    for depth, sim, share in ((4, 0.4, 0.5), (3, 0.7, 0.2), (2, 0.0, 1.0)):
        got = con.execute(f"WITH {T.mining_sql('src', depth, sim, share)} SELECT message, mined_template_id, "
                          "mined_template, cluster_size FROM mined").fetchall()
        want = _mapping(spark.createDataFrame(rows, "template string, ingest_seq long, timestamp timestamp"),
                        depth=depth, sim=sim, share=share)
        assert {m: t for m, *t in got} == {m: list(t) for m, t in want.items()}


FEATS = ("hour timestamp, n_logs long, n_errors long, n_templates long, n_sources long, hour_of_day int, "
         "day_of_week int")


def _features(n=200):
    rng = np.random.default_rng(0)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for h in range(n):
        k = int(rng.normal(100, 5))
        rows.append((start + dt.timedelta(hours=h), k, int(k * 0.1), 20, 5, h % 24, (h // 24) % 7))
    return rows


def test_iforest_flags_outlier_and_share(spark):
    rows = _features()
    rows[150] = (rows[150][0], 900, 600, 200, 50, rows[150][5], rows[150][6])
    out = IF.isolation_scores(spark.createDataFrame(rows, FEATS)).collect()
    flagged = [r for r in out if r["is_outlier"]]
    assert 0.08 * len(out) <= len(flagged) <= 0.12 * len(out)
    worst = max(out, key=lambda r: r["anomaly_score"])
    assert worst["hour"] == rows[150][0]
    assert worst["is_outlier"]


@pytest.mark.parametrize("n", [2, 3, 40, 300])
def test_forest_is_a_forest(spark, n):
    feats = spark.createDataFrame(_features(n), FEATS)
    psi = min(256, n)
    forest = IF.grow(feats, 7, psi, 42).collect()
    by = {(r.tree, r.node): r for r in forest}
    assert len(by) == len(forest) and {t for t, _ in by} == set(range(7))
    for r in forest:
        if r.node == 1:
            assert r["size"] == psi and r["depth"] == 0
        if r.feature is None:
            assert (r.tree, 2 * r.node) not in by and (r.tree, 2 * r.node + 1) not in by
        else:
            children = [by.get((r.tree, 2 * r.node + i)) for i in (0, 1)]
            assert sum(c["size"] for c in children if c) == r["size"]
    again = IF.grow(feats.repartition(5), 7, psi, 42).collect()
    assert sorted(map(str, again)) == sorted(map(str, forest))


def test_constant_features_and_too_few_rows(spark):
    start = dt.datetime(2024, 1, 1)
    same = [(start + dt.timedelta(hours=h), 1, 1, 1, 1, 1, 1) for h in range(30)]
    out = IF.isolation_scores(spark.createDataFrame(same, FEATS)).collect()
    assert len({r["anomaly_score"] for r in out}) == 1 and not any(r["is_outlier"] for r in out)
    assert IF.isolation_scores(spark.createDataFrame(same[:1], FEATS)).collect() == []
    assert IF.isolation_scores(spark.createDataFrame([], FEATS)).collect() == []


def test_average_path_length(spark):
    c = spark.createDataFrame([(1,), (2,), (256,)], "n int").select(IF.average_path_length(IF.F.col("n"))).collect()
    assert c[0][0] == 0 and c[1][0] == 1
    assert abs(c[2][0] - 10.2448) < 1e-3 and IF.path_length_of(256) == pytest.approx(c[2][0])
