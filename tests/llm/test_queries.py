"""Queries of the subpackage that SQL can state, against it, and odd rows of the URL filter."""

import random

import duckdb
import pytest

from tests.llm.helpers import SF
from tests.oracle_check import TABLES, compare
from tickweave.llm import queries, urllists
from tickweave.llm.urllists import filter_captures, intervals


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, con, name):
    n, verdict = compare(spark, con, name, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert verdict == "ok" and n > 0


def test_intervals(spark):
    rows = [("a", 5, True), ("a", 5, False), ("a", 7, True), ("a", 9, False), ("a", 12, True), ("b", 1, False), ("b", 3, True), (None, 1, True), ("c", None, True), ("c", 1, None)]
    got = sorted(map(tuple, intervals(spark.createDataFrame(rows, "key string, day int, listed boolean")).collect()), key=str)
    assert got == [("a", 12, None), ("a", 5, 9), ("b", 3, None)]


def test_captures_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(urllists, "TIME_CELLS", 5)
    urls = [None, "", "nonsense", "http://", "http://u:p@A.b.Example.com:80/x/y?q#f", "https://b.example.com//x//y/z/", "http://example.com./x", "ftp://c.example.org"]
    keys = ["host:a.b.example.com", "domain:example.com", "domain:b.example.com", "prefix:b.example.com/x/y", "prefix:example.com/x", "host:c.example.org", "domain:com"]
    names = {
        4: ["host:a.b.example.com", "domain:a.b.example.com", "domain:b.example.com", "domain:example.com", "prefix:a.b.example.com/x", "prefix:a.b.example.com/x/y"],
        5: ["host:b.example.com", "domain:b.example.com", "domain:example.com", "prefix:b.example.com/x", "prefix:b.example.com/x/y", "prefix:b.example.com/x/y/z"],
        6: ["host:example.com", "domain:example.com", "prefix:example.com/x"],
        7: ["host:c.example.org", "domain:c.example.org", "domain:example.org"],
    }
    entries = [(rng.choice(keys), rng.randrange(3, 60), rng.random() < 0.6) for _ in range(60)]
    captures = [(i if i % 9 else None, urls[i % 8], rng.randrange(70) if i % 11 else None, "x", "y") for i in range(200)] * 2
    daily = {}
    for k, d, listed in entries:
        daily[k, d] = daily.get((k, d), False) or listed
    want = []
    for i, u, d, _, _ in captures:
        active = []
        for name in names.get(urls.index(u), []) if d is not None else []:
            days = [x for k, x in daily if k == name and x <= d]
            if days and daily[name, max(days)]:
                active.append(name)
        want.append((i, u, d, bool(active), len(active), min(active, key=lambda n: (-len(n), n)) if active else None))
    df = spark.createDataFrame(captures, "page_id long, url string, day int, key string, cell string")
    got = filter_captures(df, spark.createDataFrame(entries, "key string, day int, listed boolean"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert filter_captures(df.limit(0), spark.createDataFrame(entries, "key string, day int, listed boolean")).count() == 0
    none = filter_captures(df, spark.createDataFrame([], "key string, day int, listed boolean"))
    assert none.filter("blocked").count() == 0 and none.count() == 400
