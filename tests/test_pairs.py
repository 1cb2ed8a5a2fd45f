"""The widest pairs against all pairs."""

import random

import pytest

from tickweave.operators import fleet_state as fs


@pytest.mark.parametrize(("seed", "n", "k", "step"), [(1, 60, 5, 1), (2, 40, 10, 30), (3, 7, 10, 1), (4, 80, 3, 180), (5, 50, 4, 0)])
def test_widest_pairs_against_all(spark, seed, n, k, step):
    rng = random.Random(seed)
    # whole degrees in steps, so that many angles are equal; step 0: anything
    deg = [float(rng.randrange(-180, 181, step)) if step else rng.uniform(-180, 180) for _ in range(n)]
    rows = [(f"10.0.{rng.randrange(9)}.{i}:4712", f"L{i}", f"r{i % 3}", d) for i, d in enumerate(deg)]
    online = spark.createDataFrame(rows, "pmu_id string, label string, region string, va_deg double")
    got = fs.widest_pairs(online, k)
    want = fs.angle_pairs_topk(fs.device_pairs(online), k).collect()
    assert got.columns == ["pair", "name", "value", "region_a", "region_b"]
    assert got.collect() == want and len(want) == min(k, n * (n - 1) // 2)


def test_few_devices(spark):
    schema = "pmu_id string, label string, region string, va_deg double"
    assert fs.widest_pairs(spark.createDataFrame([], schema)).count() == 0
    assert fs.widest_pairs(spark.createDataFrame([("a", "A", "r", 1.0)], schema)).count() == 0
    assert [r.pair for r in fs.widest_pairs(spark.createDataFrame([("a", "A", "r", 1.0), ("b", "B", "r", 1.0), ("c", "C", "r", None)], schema)).collect()] == ["a__b"]
