"""Run registered queries beside their SQL and compare: python tests/oracle_check.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(v + 0.0)
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, bool):
        return str(v)
    return str(v)


def kind(t: str) -> str:
    t = t.lower()
    for k, names in {
        "int": ("bigint", "int", "integer", "hugeint", "smallint", "tinyint", "long"),
        "float": ("double", "float"),
        "str": ("string", "varchar"),
        "bool": ("boolean",),
    }.items():
        if t in names:
            return k
    return t


def compare(spark, con, name, fn, sql, sf):
    df = fn(spark, sf)
    cols = sorted(df.columns)
    rows = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    if sql is None:
        return len(rows), "rows-only"
    rel = con.sql(sql)
    ocols = sorted(rel.columns)
    if cols != ocols:
        return len(rows), f"COLUMNS {cols} vs {ocols}"
    st = dict(df.dtypes)
    ot = dict(zip(rel.columns, map(str, rel.types)))
    bad = {c: (st[c], ot[c]) for c in cols if kind(st[c]) != kind(ot[c])}
    idx = {c: i for i, c in enumerate(rel.columns)}
    orows = [tuple(norm(r[idx[c]]) for c in cols) for r in rel.fetchall()]
    key = lambda r: tuple(str(x) for x in r)
    rows.sort(key=key)
    orows.sort(key=key)
    if bad:
        return len(rows), f"TYPES {bad}"
    if rows != orows:
        a, b = set(rows) - set(orows), set(orows) - set(rows)
        return len(rows), f"DIFF n={len(rows)} vs {len(orows)}\n  cols {cols}\n  spark {sorted(a, key=key)[:3]}\n  sql   {sorted(b, key=key)[:3]}"
    return len(rows), "ok" if rows else "ok EMPTY"


def main() -> int:
    from pyspark.sql import SparkSession

    args = sys.argv[1:]
    sf = args[0] if args else "/root/testdata/sf0.01"
    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args[1:] or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args[1:])]
    failed = 0
    for name in names:
        t = time.time()
        try:
            n, verdict = compare(spark, con, name, queries[name], oracles.get(name), sf)
        except Exception as ex:  # noqa: BLE001
            n, verdict = -1, "ERROR " + str(ex)[:600].replace("\n", "\n  ")
            if len(names) == 1:
                traceback.print_exc()
        ok = verdict.startswith("ok") or verdict == "rows-only"
        failed += not ok
        print(f"{name:28s} {n:7d} rows {time.time() - t:6.2f}s {verdict}", flush=True)
    print(f"{len(names)} queries, {failed} failed, {sum(n in oracles for n in names)} with SQL")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
