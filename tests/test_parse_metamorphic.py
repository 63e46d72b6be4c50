"""Metamorphic checks: the parse does not depend on partitioning or order."""
from pyspark.sql import functions as F

from logsift.operators.parse import parse_lines
from logsift.sources.event_lines import raw_lines

SF = "/root/testdata/sf0.001"


def _key(df):
    return sorted((r["ingest_seq"], r["log_type"], r["level"], str(r["timestamp"]), r["message"],
                   str(r["network_info"])) for r in df.collect())


def test_repartition_same_output(spark):
    raw = raw_lines(spark, SF).drop("ts")
    a = _key(parse_lines(raw))
    b = _key(parse_lines(raw.repartition(7, "source")))
    c = _key(parse_lines(raw.orderBy(F.rand(3))))
    assert a == b == c
    assert len(a) > 0
