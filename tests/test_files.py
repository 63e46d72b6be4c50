"""Text-file source, file registry and per-file counts."""
import os

from pyspark.sql import functions as F

from logsift.sources import text_files as TF


def _write(d, name, data: bytes):
    with open(os.path.join(d, name), "wb") as f:
        f.write(data)


def test_counts_and_status(spark, tmp_dir):
    _write(tmp_dir, "a.log", b"a\n\nb\n\n")
    _write(tmp_dir, "empty.txt", b"")
    _write(tmp_dir, "bad.log", b"ok line\n\xff\xfe broken\n")
    _write(tmp_dir, "skip.csv", b"x\ny\n")
    _write(tmp_dir, "mid.json", b"\n\nfirst\n \n\t\nlast\n\n")
    files = {r["original_filename"]: r for r in TF.registry(spark, tmp_dir).collect()}
    assert "skip.csv" not in files
    assert (files["a.log"]["processed_logs"], files["a.log"]["failed_logs"]) == (2, 1)
    assert files["a.log"]["status"] == "completed"
    assert files["a.log"]["file_size"] == 6
    e = files["empty.txt"]
    assert (e["processed_logs"], e["failed_logs"], e["file_size"], e["status"]) == (0, 1, 0, "completed")
    assert files["bad.log"]["status"] == "failed"
    assert files["bad.log"]["processed_logs"] == 0
    assert (files["mid.json"]["processed_logs"], files["mid.json"]["failed_logs"]) == (2, 2)


def test_ingest_files_parses_and_skips_failed(spark, tmp_dir):
    _write(tmp_dir, "app.log", b"Dec  1 10:00:00 web1 cron: job ok\nfw DENY SRC=1.2.3.4 DST=5.6.7.8\n")
    _write(tmp_dir, "bad.log", b"\xff\xfe\n")
    logs, files = TF.ingest_files(spark, tmp_dir)
    rows = logs.orderBy("ingest_seq").collect()
    assert [r["log_type"] for r in rows] == ["syslog", "firewall"]
    assert {r["source"] for r in rows} == {"app.log"}
    assert all(r["template_id"].startswith("tmpl_") for r in rows)
    assert files.where(F.col("status") == "failed").count() == 1


def test_line_numbers_do_not_depend_on_the_splits(spark, tmp_dir):
    for k in range(3):
        _write(tmp_dir, f"f{k}.log", "".join(f"line {k} {i} " + "x" * (i * 7 % 41) + ("\n" if i % 5 else "\n\n")
                                             for i in range(400)).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = []
    try:
        for size in ("1k", "5000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            logs, files = TF.ingest_files(spark, tmp_dir)
            got.append((sorted((r.log_id, r.message) for r in logs.select("log_id", "message").collect()),
                        sorted(map(tuple, files.drop("file_size").collect()))))
            lines = TF.number_lines(TF.read_lines(spark, tmp_dir)).where("original_filename = 'f1.log'").collect()
            text = open(os.path.join(tmp_dir, "f1.log")).read().split("\n")
            assert sorted((r.ingest_seq, r.line) for r in lines) == list(enumerate(text[:-1]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got[0] == got[1] == got[2]
    assert len({i for i, _ in got[0][0]}) == 1200


def test_registry_plan_has_no_sort_aggregate(spark, tmp_dir):
    _write(tmp_dir, "a.log", b"x\n")
    from logsift.plans import catalog
    for df in (TF.registry(spark, tmp_dir), catalog.SPARK["file_ingest_counts"](spark, "/root/testdata/sf0.001")):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
