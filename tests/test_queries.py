"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.oracle_check import TABLES, compare

SF = "/root/testdata/sf0.001"
# a cross-section; tests/oracle_check.py runs all of them
NAMES = [
    "quality_gate", "quality_edges", "align_ticks", "join_layout_asof", "live_sessions", "decode_data", "hop_stats", "fleet_kpis",
    "cfg_version_upsert", "identity_migration", "rate_limit_events", "fps_estimate", "history_scan", "src_readings_ndjson",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    n, verdict = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert verdict == "ok", verdict
    assert n > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "tick_us" and df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
