"""Registry contract and a few oracle checks on the smallest scale."""
import importlib

import math

import duckdb
import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
TABLES = ["events", "documents", "conversations"]


@pytest.fixture(scope="module")
def entry_mod():
    return importlib.import_module("__spark_entry__")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry_runs(spark, entry_mod):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"level", "count"}


def test_oracle_keys_are_queries(entry_mod):
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "None"
    if isinstance(v, float):
        return f"{v:.6f}"
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    return str(v)


def _norm(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(_cell(v) for v in row) for row in pdf.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", ["parse_all", "network_facts", "stats_levels", "query_page",
                                  "anomaly_volume_30d", "file_ingest_counts", "period_growth"])
def test_matches_oracle(spark, con, entry_mod, name):
    s = entry_mod.queries()[name](spark, SF).toPandas()
    d = con.execute(entry_mod.oracle_sql()[name]).df()
    assert sorted(d.columns) == sorted(s.columns)
    assert _norm(s) == _norm(d)
