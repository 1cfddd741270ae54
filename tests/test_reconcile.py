import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecshift.operators import reconcile

SCHEMA = "id string, vector array<float>, payload string, updated_at timestamp, ingested_at timestamp, key string, hash bigint"
AT = datetime(2025, 1, 1)
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    full = [(i, v, p, AT + timedelta(minutes=m), AT, "clash", 1) for i, v, p, m in rows]
    return spark.createDataFrame(full, SCHEMA)


def diffs(spark, source, target):
    return sorted(tuple(r) for r in reconcile.differences(table(spark, source), table(spark, target)).collect())


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ('{"a": 5, "b": [1, 2]}', '{"b":[1.0,2e0],"a":5.00}', True),
        ('{"a": "é\\u00e9"}', '{"a":"\\u00e9é"}', True),
        (None, "{}", True),
        (None, '{"__source_id": "x", "__namespace": "n"}', True),
        ('{"a": null}', "{}", False),
        ('{"a": null}', '{"a": 0}', False),
        ('{"a": [1, 2]}', '{"a": [2, 1]}', False),
        ('{"a": "5"}', '{"a": 5}', False),
        ('{"a": true}', '{"a": 1}', False),
        ('{"a": "X"}', '{"a": "x"}', False),
        ('{"a": {"__source_id": 1}}', '{"a": {}}', False),
        ('{"a": 12345678901234567890}', '{"a": 12345678901234567891}', False),
        ('{"a": -0.0}', '{"a": 0}', True),
        ('{"a": 1e999999999}', '{"a": 10e999999998}', True),
        ("no json", "no json", True),
        ("no json", "no  json", False),
    ],
)
def test_payload_equality(a, b, same):
    assert (reconcile.canonical_json(a) == reconcile.canonical_json(b)) is same


def test_every_kind_of_difference(spark):
    v = [1.0, 2.0, 3.0]
    source = [
        ("same", v, '{"a": 1}', 0), ("noise", v, None, 0), ("vector", v, None, 0), ("length", v, None, 0), ("gone", v, None, 0), ("null", None, None, 0), ("nan", [NAN, INF, 1.0], None, 0),
        ("inf", [INF, 1.0, 1.0], None, 0), ("both", v, '{"a": 1}', 0), ("old", [9.0, 9.0, 9.0], None, 0), ("old", v, None, 5), ("Case", v, None, 0), ("007", v, None, 0), ("empty", [], None, 0), (None, v, None, 0),
    ]
    target = [
        ("same", v, '{"a":1.0,"__namespace":"n"}', 0), ("x", [1.0, 2.0, 3.00001], '{"__source_id":"noise"}', 0), ("vector", [1.0, 2.0, 3.1], None, 0), ("length", v[:2], None, 0), ("null", v, None, 0), ("nan", [NAN, INF, 1.0], None, 0),
        ("inf", [-INF, 1.0, 1.0], None, 0), ("both", [0.0, 2.0, 3.0], '{"a": 2}', 0), ("old", v, None, 0), ("case", v, None, 0), ("7", v, None, 0), ("new", v, None, 0), ("new", v, None, 0), ("empty", [], None, 0), (None, v, None, 0),
    ]
    assert diffs(spark, source, target) == sorted(
        [("vector", "vector"), ("length", "vector"), ("gone", "missing_in_target"), ("null", "vector"), ("inf", "vector"), ("both", "vector"), ("both", "payload"), ("Case", "missing_in_target"), ("007", "missing_in_target"), ("case", "missing_in_source"), ("7", "missing_in_source"), ("new", "missing_in_source")]
    )


def test_empty_copies(spark):
    one = [("a", [1.0], None, 0)]
    assert diffs(spark, [], []) == [] and diffs(spark, one, []) == [("a", "missing_in_target")] and diffs(spark, [], one) == [("a", "missing_in_source")]


def test_many_differences_and_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(reconcile, "PLANNED", 3000)  # too few buckets at first: most must be tried again
    random = np.random.default_rng(0)
    source = [(f"i{n}", [float(x) for x in random.normal(size=3)], json.dumps({"n": n}), 0) for n in range(3000)]
    target = [(i, v if n % 3 else [v[0] + 1, *v[1:]], p, 0) for n, (i, v, p, _) in enumerate(source) if n % 5]
    source += [("hot", [float(n)], None, n) for n in range(1500)]
    target += [("hot", [1499.0], None, 0)]
    expected = [(f"i{n}", "missing_in_target") for n in range(0, 3000, 5)] + [(f"i{n}", "vector") for n in range(0, 3000, 3) if n % 5]
    assert diffs(spark, source, target) == sorted(expected)


def test_keys_that_cannot_be_peeled_are_still_found(spark, monkeypatch):
    monkeypatch.setattr(reconcile, "ATTEMPTS", 1)
    monkeypatch.setattr(reconcile, "PLANNED", 10**9)
    source = [(f"i{n}", [float(n)], None, 0) for n in range(4000)]
    assert len(diffs(spark, source, [])) == 4000


def test_peeling():
    random = np.random.default_rng(1)
    elements = random.integers(-(2**62), 2**62, 800)
    hashes = random.integers(-(2**62), 2**62, 800)
    size = reconcile.HASHES * reconcile.CELLS
    n, h, e, c = (np.zeros(size, np.int64) for _ in range(4))
    for k, (x, y) in enumerate(zip(elements, hashes)):
        sign = 1 if k % 2 else -1
        for j in range(reconcile.HASHES):
            at = ((int(x) & (2**64 - 1)) >> (20 * j) & (2**20 - 1)) % reconcile.CELLS + j * reconcile.CELLS
            n[at] += sign
            h[at] ^= y
            e[at] ^= x
            c[at] += sign * (int(x) % reconcile.PRIME)
    found, whole = reconcile.peel(n, h, e, c)
    assert whole and set(found) == set(hashes)


def test_shuffles_stay_narrow(spark):
    df = table(spark, [("a", [1.0], None, 0)])
    plan = reconcile._element_table(df.withColumn("key", F.col("id")))._jdf.queryExecution().executedPlan().toString()
    exchange = plan[plan.index("Exchange hashpartitioning") :]
    assert "vector" not in exchange.splitlines()[0] and "WindowGroupLimit" in plan


def test_tables_are_sized_by_the_differences(spark):
    same = spark.range(20_000).select(F.xxhash64("id").alias("hash"), F.xxhash64("id", F.lit(3)).alias("content"))
    other = same.withColumn("content", F.when(F.pmod("hash", F.lit(100)) == 0, F.col("content") + 1).otherwise(F.col("content")))
    few = reconcile.expected_elements(same, other, 40_000)
    assert 300 < few < 600 and reconcile.expected_elements(same, same, 40_000) < 10
    assert 250 < reconcile.expected_elements(same, other, 400_000) < 1500  # by a tenth of the keys
    assert reconcile.differing_hashes(same, other).count() == other.where(F.pmod("hash", F.lit(100)) == 0).count()
