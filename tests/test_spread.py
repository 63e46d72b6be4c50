"""The rows of a parse task are bounded, however the table's files are cut."""
import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logsift.plans import tables
from logsift.sources import event_lines as EL


@pytest.fixture()
def copies(spark, tmp_dir):
    """Copies of 3,000 events in four files of one row group each: as many splits
    as cores.  Some ids and times come often or are missing."""
    at = F.lit(dt.datetime(2024, 1, 1)) + F.make_interval(mins=F.pmod("id", F.lit(3000)).cast("int"))
    spark.range(12_000).repartition(4).select(
        F.when(F.col("id") % 50 != 0, F.col("id")).alias("event_id"),
        F.when(F.col("id") % 40 == 0, None).when(F.col("id") % 4 == 0, F.lit(dt.datetime(2024, 1, 2))).otherwise(at).alias("ts"),
        (F.col("id") % 30).alias("user_id"), F.lit("click").alias("event_type"),
        F.lit(1.0).alias("value"), F.lit("{}").alias("props")).write.parquet(f"{tmp_dir}/events.parquet")
    return tmp_dir


def test_rows_of_a_task(spark, copies, monkeypatch):
    monkeypatch.setattr(EL, "ROWS_PER_TASK", 500)
    lines = EL.raw_lines(spark, copies)
    sizes = [r["n"] for r in lines.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 12_000 and max(sizes) <= 1000
    logs = tables.build_logs(spark, copies)
    sizes = [r["n"] for r in logs.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 1000


def test_same_lines(spark, copies, monkeypatch):
    def counted():
        return Counter(tuple(r) for r in EL.raw_lines(spark, copies).select("event_id", "ts", "line", "file_id").collect())
    many = counted()
    monkeypatch.setattr(EL, "ROWS_PER_TASK", 10_000)
    few = counted()
    monkeypatch.setattr(EL, "spread", lambda df, *_: df)
    assert many == few == counted()
