"""Random inputs against plain restatements of what the operators mean."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from runwise.functions import memory_to_bytes, parse_params
from runwise.operators import app_metrics, fit_curve, join_size, predict_curve, prefix_columns, self_join, value_counts


def random_text(rng, alphabet, longest):
    return "".join(rng.choice(alphabet) for _ in range(rng.randrange(longest)))


def test_parameter_strings(spark):
    rng = random.Random(5)
    texts = sorted({random_text(rng, "ab=;", 12) for _ in range(600)})

    def expected(text):
        found = {}
        for item in text.split(";"):
            key, sign, value = item.partition("=")
            if sign and key:
                found[key] = value
        return found

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_params(F.col("t")).alias("m"))
    assert {r.t: r.m for r in rows.collect()} == {t: expected(t) for t in texts}


def test_memory_strings(spark):
    rng = random.Random(6)
    texts = sorted({random_text(rng, "0127kKmgGt b.", 5) for _ in range(800)})
    units = {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}

    def expected(text):
        text = text.strip(" ").lower()
        digits = text[: len(text) - len(text.lstrip("0123456789"))]
        unit = text[len(digits):]
        if unit.endswith("b") and len(unit) == 2:
            unit = unit[0]
        return int(digits) << units[unit] if digits and unit in units else None

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", memory_to_bytes(F.col("t")).alias("b"))
    assert {r.t: r.b for r in rows.collect()} == {t: expected(t) for t in texts}


@pytest.mark.parametrize("seed", range(3))
def test_join_size_counts_the_join(spark, seed):
    rng = random.Random(seed)
    keys = [rng.choice("aaaaabbc") if rng.random() > 0.1 else None for _ in range(120)]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "surname string, n int")
    expected = sum(n * n for k, n in Counter(keys).items() if k is not None)
    other = prefix_columns(df, df.columns)
    assert join_size(df, other, "surname", "another_surname").first().pairs == expected
    for rows_per_task in (10**9, 200, 20):
        joined = self_join(df, "surname", rows_per_task=rows_per_task)
        pairs = [(r.n, r.another_n) for r in joined.collect()]
        assert len(pairs) == len(set(pairs)) == expected
        assert all(keys[a] == keys[b] for a, b in pairs)
    assert Counter(dict(value_counts(df, "surname").collect())) == Counter(keys)


def min_max(points):
    """Isotonic fit by its min-max formula: largest of the smallest means around a point."""
    pooled = {}
    for x, y in points:
        pooled.setdefault(x, []).append(y)
    xs = sorted(pooled)
    groups = [pooled[x] for x in xs]

    def mean(a, b):
        ys = [y for g in groups[a : b + 1] for y in g]
        return sum(ys) / len(ys)

    n = len(xs)
    return {xs[i]: max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)}


@pytest.mark.parametrize("local_points", [1_000_000, 2])
@pytest.mark.parametrize("seed", range(2))
def test_fit_is_the_min_max_formula(spark, seed, local_points):
    rng = random.Random(seed)
    data = [(float(rng.randrange(15)), float(rng.randrange(50))) for _ in range(40)]
    expected = min_max(data)
    df = spark.createDataFrame(data, "rows double, mem double")
    curve = fit_curve(df, local_points=local_points)
    got = {r.rows: r.prediction for r in predict_curve(curve, df.select("rows").distinct()).collect()}
    assert got.keys() == expected.keys()
    assert all(abs(got[x] - expected[x]) < 1e-9 for x in expected)


def test_metrics_do_not_depend_on_the_cut(spark):
    rng = random.Random(9)
    columns = ["launch_time", "finish_time", "jvm_gc_time", "mem_spill", "disk_spill", "input_read", "remote_read",
               "result_size", "shuffle_written", "local_read", "remote_to_disk", "output_written", "peak"]
    rows = [(rng.choice("aaab"), *[rng.randrange(10**6) for _ in columns], rng.randrange(2)) for _ in range(500)]
    schema = "application_attempt string, " + ", ".join(f"{c} bigint" for c in columns) + ", has_peak int"
    tasks = spark.createDataFrame(rows, schema)
    one, many = app_metrics(tasks.coalesce(1)), app_metrics(tasks.repartition(13))
    assert one.exceptAll(many).isEmpty() and one.count() == many.count() == 2
