import random

import pytest
from pyspark.sql import functions as F

from runwise.operators import (
    Curve, fit_curve, merge_curve, pooled_points, predict_curve, probe_points, read_curve, refit_curve, write_curve,
)
from runwise.operators.wide_curve import _in_ranges, interpolate, isotonic_blocks
from runwise.session import written

POINTS = [(10, 100), (10, 200), (50, 80), (100, 300), (100, 100), (1000, 500), (2000, 400)]


def points(spark, rows):
    return spark.createDataFrame([(float(x), None if y is None else float(y)) for x, y in rows], "rows double, mem double")


def at(spark, curve, rows):
    asked = spark.createDataFrame([(float(r),) for r in rows], "rows double")
    return {r.rows: round(r.prediction, 4) for r in predict_curve(curve, asked).collect()}


EXPECTED = {1: 126.6667, 10: 126.6667, 50: 126.6667, 60: 141.3333, 100: 200.0, 500: 311.1111, 1000: 450.0,
            2000: 450.0, 1e7: 450.0}


@pytest.mark.parametrize("local_points", [1_000_000, 1])
def test_known_curve(spark, local_points):
    curve = fit_curve(points(spark, POINTS), local_points=local_points)
    assert at(spark, curve, EXPECTED) == EXPECTED
    assert {round(r.prediction, 4) for r in curve.table.collect()} == {126.6667, 200.0, 450.0}


def test_memory_prediction_in_mib(spark):
    curve = fit_curve(points(spark, [(10, 3 << 20), (20, (5 << 20) + 1)]))
    rows = predict_curve(curve, probe_points(spark)).select("rows", "memory_prediction").collect()
    assert [tuple(r) for r in rows] == [(50.0, 6), (100.0, 6), (1000.0, 6), (10000.0, 6), (10000000.0, 6)]


@pytest.mark.parametrize("local_points", [1_000_000, 0])
def test_one_point_is_a_constant(spark, local_points):
    curve = fit_curve(points(spark, [(10, 7), (10, 9)]), local_points=local_points)
    assert at(spark, curve, [0, 10, 99]) == {0: 8.0, 10: 8.0, 99: 8.0}


@pytest.mark.parametrize("row", [(1.0, None), (None, 1.0), (5.0, None)])
def test_missing_values_are_refused(spark, row):
    df = spark.createDataFrame([(5.0, 5.0), row], "rows double, mem double")
    with pytest.raises(ValueError):
        fit_curve(df)


def test_no_points_no_curve(spark):
    curve = fit_curve(points(spark, []))
    assert curve.table.isEmpty()
    asked = spark.createDataFrame([(1,), (None,)], "rows bigint")
    assert [(r.rows, r.prediction, r.memory_prediction) for r in predict_curve(curve, asked).orderBy("rows").collect()] == [
        (None, None, None), (1, None, None)]


def test_lookup_of_whole_numbers_keeps_columns(spark):
    curve = fit_curve(points(spark, POINTS))
    found = predict_curve(curve, spark.createDataFrame([("a", 60, 1)], "k string, rows bigint, x int"))
    assert found.columns == ["k", "rows", "x", "prediction", "memory_prediction"] and dict(found.dtypes)["rows"] == "bigint"
    assert round(found.first().prediction, 4) == 141.3333


def test_many_sizes_in_one_gap_fill_many_ranges(spark):
    curve = spark.createDataFrame([(0.0, 0.0), (10.0, 100.0)], "boundary double, prediction double")
    asked = spark.range(20_000).selectExpr("cast(20 + id as double) rows")
    found = interpolate(curve, asked, ranges=20)
    assert found.count() == 20_000 and found.filter("prediction <> 100").isEmpty()
    mixed = curve.selectExpr("boundary rows", "false asked").unionByName(asked.selectExpr("rows", "true asked"))
    sizes = [r["count"] for r in _in_ranges(mixed, 20).groupBy("range").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 3_000


def test_curve_is_kept(spark, tmp_path):
    first = write_curve(fit_curve(points(spark, POINTS)), f"{tmp_path}/curve")
    assert at(spark, first, EXPECTED) == EXPECTED
    again = refit_curve(read_curve(spark, f"{tmp_path}/curve"), points(spark, [(5000, 900)]))
    assert at(spark, again, [5000, 9000]) == {5000: 900.0, 9000: 900.0}


def shape(kind, i, rng):
    return {
        "noise": i + rng.gauss(0, 60), "rising": float(i * i), "falling": float(-i),
        "steps": i // 100 + rng.choice([0.0, 0.0, 5.0]), "flat": 0.1, "saw": float(i % 50), "cliff": i / 1000 + 0.1 * (i == 0) - 0.7 * (i == 299),
    }[kind]


@pytest.mark.parametrize("kind", ["noise", "rising", "falling", "steps", "flat", "saw", "cliff"])
def test_cut_fit_equals_the_fit_of_one_task(spark, kind):
    rng = random.Random(3)
    data = [(i * 3, shape(kind, i, rng)) for i in range(300) for _ in range(rng.choice([1, 1, 3]))]
    df = points(spark, data)
    model = fit_curve(df)
    blocks = isotonic_blocks(pooled_points(df), 300, local_points=40, ranges=7)
    wide = Curve(blocks.select(F.explode(F.array_distinct(F.array("start", "end"))).alias("boundary"), "prediction"))
    asked = [x * 0.7 - 20 for x in range(1400)]
    a, b = at(spark, model, asked), at(spark, wide, asked)
    assert max(abs(a[x] - b[x]) for x in a) < 1e-3 and len(a) == len(b) == 1400
    assert {round(r.boundary, 6) for r in model.table.collect()} == {round(r.boundary, 6) for r in wide.table.collect()}


def test_lookup_keeps_repeated_and_missing_features(spark):
    curve = spark.createDataFrame([(0.0, 0.0), (10.0, 100.0)], "boundary double, prediction double")
    asked = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", None), ("d", 11.0)], "k string, rows double")
    got = {r.k: r.prediction for r in interpolate(curve, asked, ranges=3).collect()}
    assert got == {"a": 50.0, "b": 50.0, "c": None, "d": 100.0}


def test_curve_never_falls(spark):
    rng = random.Random(1)
    table = fit_curve(points(spark, [(rng.randrange(500), rng.random() * 100) for _ in range(2000)])).table
    values = [r.prediction for r in table.orderBy("boundary").collect()]
    assert values == sorted(values)


def test_merge_prefers_new_points(spark):
    old = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0)], "boundary double, prediction double")
    new = points(spark, [(2, 4), (2, 6), (3, 30)])
    assert sorted(tuple(r) for r in merge_curve(old, new).collect()) == [(1.0, 10.0, 1.0), (2.0, 5.0, 2.0), (3.0, 30.0, 1.0)]
    assert at(spark, refit_curve(old, new), [1, 2, 3]) == {1: 6.6667, 2: 6.6667, 3: 30.0}


def _fit(points):
    """Pool-adjacent-violators over sorted (x, y, w), in fractions."""
    from fractions import Fraction

    blocks = []
    for x, y, w in points:
        block = [x, x, Fraction(y) * w, w]
        while blocks and blocks[-1][2] * block[3] >= block[2] * blocks[-1][3]:
            a = blocks.pop()
            block = [a[0], block[1], a[2] + block[2], a[3] + block[3]]
        blocks.append(block)
    return [(a, b, float(s / w)) for a, b, s, w in blocks]


@pytest.mark.parametrize("seed", range(6))
def test_fit_does_not_depend_on_the_cuts(spark, seed):
    """Many equal means, ramps and noise, by one range and by many, against exact arithmetic."""
    rng = random.Random(seed)
    make = [lambda i: rng.randrange(4), lambda i: i % 17, lambda i: i * i % 23 + i // 9, lambda i: -i + 40 * (i % 2), lambda i: rng.choice([0, i]), lambda i: i // 7][seed]
    data = [(float(i), float(make(i)), float(rng.choice([1, 1, 2, 5]))) for i in range(240)]
    df = spark.createDataFrame(data, "rows double, mem double, weight double").repartition(5)
    want = _fit((x, int(y), int(w)) for x, y, w in data)
    for local_points, ranges in ((1000, 9), (25, None), (3, None)):
        got = sorted(tuple(r) for r in isotonic_blocks(df, 240, local_points, ranges).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want], (local_points, ranges)
        assert max(abs(g[2] - w[2]) for g, w in zip(got, want)) < 1e-9


def test_rows_that_meet_grow_with_the_points(spark, monkeypatch):
    """Eight times the points give about eight times the rows, not ranges times bands."""
    from runwise.operators import wide_curve

    rows = {}
    for n in (1000, 8000):
        tables = []
        monkeypatch.setattr(wide_curve, "written", lambda df, name: tables.append(written(df, name)) or tables[-1])
        rng = random.Random(n)
        data = [(float(i), float(rng.randrange(5 * n)) + 4 * i, 1.0) for i in range(n)]
        df = spark.createDataFrame(data, "rows double, mem double, weight double")
        got = sorted(tuple(r) for r in isotonic_blocks(df, n, 5).collect())
        want = _fit((x, int(y), 1) for x, y, _ in data)
        assert [g[:2] for g in got] == [w[:2] for w in want] and max(abs(g[2] - w[2]) for g, w in zip(got, want)) < 1e-6
        rows[n] = sum(t.count() for t in tables)
    assert rows[8000] < 16 * rows[1000], rows


def test_steps_do_not_follow_the_labels(spark):
    """The same jobs for labels that give one block and for labels that give as many as points."""
    tracker, jobs = spark.sparkContext.statusTracker(), {}
    for name, label in (("falling", "-id"), ("rising", "id"), ("mixed", "id % 97 + id / 50")):
        df = spark.range(2000).selectExpr("cast(id as double) rows", f"cast({label} as double) mem", "1d weight")
        spark.sparkContext.setJobGroup(f"fit {name}", "fit")
        isotonic_blocks(df, 2000, 100)
        jobs[name] = len(tracker.getJobIdsForGroup(f"fit {name}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(jobs.values()) <= 25
