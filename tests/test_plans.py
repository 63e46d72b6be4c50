"""Plan shape: filters reach the scan, time windows prune partitions, only
used columns are read, aggregations combine map-side before the shuffle."""
import contextlib
import io

import pytest

from logsift.plans import catalog

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def ready(spark):
    catalog.SPARK["parse_all"](spark, SF).count()  # builds the stored table
    return spark


def test_search_pushes_filter_and_prunes_columns(ready):
    p = _plan(catalog.SPARK["query_level"](ready, SF))
    assert "EqualTo(level,ERROR)" in p
    assert "parsed_fields" not in p and "metadata" not in p
    assert "TakeOrderedAndProject" in p


def test_ip_search_reads_only_needed_struct_fields(ready):
    p = _plan(catalog.SPARK["query_ip"](ready, SF))
    assert "network_info:struct<ip_addresses:array<string>,src_ip:string,dst_ip:string>" in p


def test_time_window_prunes_partitions(ready):
    p = _plan(catalog.SPARK["anomaly_error_rate_30d"](ready, SF))
    assert "PartitionFilters: [isnotnull(event_date" in p
    assert "GreaterThanOrEqual(timestamp" in p


def test_partial_aggregation_before_shuffle(ready):
    p = _plan(catalog.SPARK["stats_levels"](ready, SF))
    assert "partial_count" in p


def test_template_statistics_hash_the_log_rows(ready):
    p = _plan(catalog.SPARK["template_stats"](ready, SF))
    tree = p[:p.index("\n\n(1)")] if "\n\n(1)" in p else p
    last = [line for line in tree.splitlines() if "Aggregate" in line][-1]     # the one next to the scan
    assert "HashAggregate" in last
