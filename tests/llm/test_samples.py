import numpy as np
import pytest
from pyspark.sql import functions as F

from vecshift.llm import fixed_sample, stable_sample

PAGES = "scan_id string, resource_name string, page_no int, attempt int, scanned_at timestamp, records array<struct<id string, namespace string, payload string>>, next_cursor string"
CONTEXTS = "context_id bigint, resource_name string, seed bigint, sample_size bigint, sample_rate double, target_dimension int"


def pages(spark, rows):
    from datetime import datetime, timedelta

    at = datetime(2025, 1, 1)
    return spark.createDataFrame([("s", r, n, 1, at + timedelta(seconds=n), None if ids is None else [(i, "ns", f"{{\"v\": {n}}}") for i in ids], None) for n, (r, ids) in enumerate(rows)], PAGES)


def contexts(spark, rows):
    return spark.createDataFrame([(c, r, s, n, rate, None) for c, r, s, n, rate in rows], CONTEXTS)


def test_permutation_is_one():
    for total in (1, 2, 3, 5, 64, 1000, 4097):
        for seed in (0, 42, -19, 2**62):
            assert sorted(fixed_sample.permuted(np.arange(total), total, seed)) == list(range(total))


def test_every_rank_is_equally_likely():
    total, size, draws = 7, 3, 7000
    counts = np.zeros(total)
    pairs = np.zeros((total, total))
    for seed in range(draws):
        drawn = fixed_sample.permuted(np.arange(size), total, seed)
        counts[drawn] += 1
        for a in drawn:
            for b in drawn:
                pairs[a, b] += a != b
    expected = draws * size / total
    assert ((counts - expected) ** 2 / expected).sum() < 22.5  # chi-square, 6 degrees, p = 0.001
    expected = draws * size * (size - 1) / (total * (total - 1))
    off = pairs[~np.eye(total, dtype=bool)]
    assert np.abs(off - expected).max() < 6 * np.sqrt(expected)


def test_sample_of_pages(spark):
    rows = [("a", [f"x{i}" for i in range(50)]), ("a", None), ("a", []), ("a", [f"x{i}" for i in range(25, 75)]), ("b", ["only", None]), (None, ["lost"])]
    asked = contexts(spark, [(1, "a", 42, 10, 0.1), (1, "a", 42, 10, 0.1), (2, "a", None, 10, 0.1), (3, "a", 7, 1000, 0.1), (4, "b", -1, 5, 0.1), (5, "none", 1, 5, 0.1), (6, "a", 1, None, 0.1), (7, "a", 1, -3, 0.1)])
    found = fixed_sample.sample_pages(pages(spark, rows), asked).toPandas()
    by = found.groupby("context_id").id.agg(list)
    assert {k: len(v) for k, v in by.items()} == {1: 10, 2: 10, 3: 75, 4: 1}
    assert all(len(set(v)) == len(v) for v in by)
    assert set(by[1]) == set(by[2])  # no seed is seed 42
    latest = found[(found.context_id == 3) & (found.id == "x30")]
    assert latest.payload.iloc[0] == '{"v": 3}'


def test_sample_of_nothing(spark):
    asked = contexts(spark, [(1, "a", 42, 10, 0.1)])
    assert fixed_sample.sample_pages(pages(spark, []), asked).count() == 0
    assert fixed_sample.sample_pages(pages(spark, [("a", ["x"])]), asked.where("false")).count() == 0


def test_pieces_arrive_one_by_one(spark):
    stage = fixed_sample.PieceStage(spark)
    for n in range(3):
        stage.add(spark.range(n * 10, n * 10 + 20).select(F.lit("r").alias("resource_name"), F.col("id").cast("string").alias("id")))
    drawn = stage.finish().draw(contexts(spark, [(1, "r", 5, 40, 0.1)]))
    assert drawn.select("id").distinct().count() == 40
    assert [r["rank"] for r in drawn.orderBy("rank").collect()] == list(range(40))
    with pytest.raises(ValueError):
        fixed_sample.PieceStage(spark).finish()


def records(spark, rows):
    return spark.createDataFrame(rows, "resource_name string, id string, load_no int, w double")


def test_stable_sample_grows_only(spark):
    rows = [("r", f"i{n}", n % 12, 1.0) for n in range(3000)]
    asked = contexts(spark, [(1, "r", 42, 0, 0.1), (2, "r", None, 0, 0.1), (3, "r", 0, 0, 0.5), (4, "r", 9, 0, 1.0), (5, "r", 9, 0, None), (6, "r", 9, 0, float("nan")), (7, "q", 9, 0, 1.0)])
    full = stable_sample.stable_sample(records(spark, rows), asked).toPandas()
    shuffled = stable_sample.stable_sample(records(spark, rows + rows[::-1]).repartition(7), asked).toPandas()
    chosen = {c: set(g.id) for c, g in full.groupby("context_id")}
    assert chosen == {c: set(g.id) for c, g in shuffled.groupby("context_id")}
    assert set(chosen) == {1, 2, 3, 4} and chosen[1] == chosen[2] and len(chosen[4]) == 3000
    assert 240 < len(chosen[1]) < 360 and 1400 < len(chosen[3]) < 1600
    before = stable_sample.stable_sample(records(spark, [r for r in rows if r[2] <= 5]), asked).toPandas()
    for c, g in before.groupby("context_id"):
        assert set(g.id) <= chosen[c]
    assert (full.first_load >= 0).all()


def test_weights_never_fall(spark):
    asked = contexts(spark, [(1, "r", 3, 0, 0.2)])
    heavy = records(spark, [("r", f"i{n}", 0, 4.0) for n in range(500)])
    light = records(spark, [("r", f"i{n}", 1, 0.1) for n in range(500)])
    first = {r["id"] for r in stable_sample.stable_sample(heavy, asked, F.col("w")).collect()}
    kept = stable_sample.running_weights(heavy, F.col("w"))
    later = {r["id"] for r in stable_sample.stable_sample(light, asked, F.col("w"), kept).collect()}
    assert first == later and 350 < len(first) < 450
    assert {r["weight"] for r in stable_sample.running_weights(light, F.col("w"), kept).collect()} == {4.0}
    odd = records(spark, [("r", None, 0, 1.0), (None, "x", 0, 1.0), ("r", "y", 0, None), ("r", "z", 0, float("nan")), ("r", "q", 0, -5.0)])
    assert stable_sample.stable_sample(odd, asked.withColumn("sample_rate", F.lit(1.0)), F.col("w")).count() == 0


def test_many_contexts_are_joined_by_parts(spark, monkeypatch):
    rows = records(spark, [("r", f"i{n}", n % 12, 1.0) for n in range(2000)])
    asked = contexts(spark, [(c, "r", c, 0, 0.1) for c in range(5)])
    few = {tuple(r) for r in stable_sample.stable_sample(rows, asked).collect()}
    monkeypatch.setattr(stable_sample, "CONTEXT_ROWS", 2)
    assert {tuple(r) for r in stable_sample.stable_sample(rows, asked).collect()} == few and len(few) > 700
