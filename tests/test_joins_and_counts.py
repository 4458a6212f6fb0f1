import pytest
from pyspark.sql import functions as F

from runwise.operators import (
    best_trial, derive_persons, join_size, partition_profile, prefix_columns, row_count, self_join, trial_stats,
    value_counts,
)
from runwise.operators.joins import expand_pairs, factor_join, grids, pair_join
from runwise.plans import run_workload
from runwise.schemas import PERSON_COLUMNS
from runwise.sources import generate_persons, person_ids


def skewed(spark, rows=600):
    """A third of the rows share one key, some have none; copies of rows occur."""
    return spark.range(rows).selectExpr(
        "case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else concat('k', id % 40) end surname",
        "id % 100 name",
    )


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_self_join_pairs_equal_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "surname string, n int")
    rows = sorted((r.n, r.another_n) for r in self_join(df, "surname").collect())
    assert rows == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]


def test_grid_gives_the_plain_join(spark, plan):
    df = skewed(spark)
    other = prefix_columns(df, df.columns)
    plain = df.join(other, df.surname == other.another_surname)
    spread = self_join(df, "surname", rows_per_task=1000, max_tasks=64)
    assert same(plain, spread)
    assert plain.count() == join_size(df, other, "surname", "another_surname").first()[0]


def test_hot_key_is_spread_over_many_tasks(spark):
    df = spark.range(2000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id)) surname", "id name")
    sizes = [r["rows"] for r in partition_profile(self_join(df, "surname", rows_per_task=20_000)).collect()]
    assert sum(sizes) == 667 * 667 + 1333 and max(sizes) < 667 * 667 / 6


def grid_of(spark, n, m, share):
    counts = spark.createDataFrame([("k", float(n), float(m))], "_k string, n double, m double")
    rows = grids(counts.withColumn("load", F.expr("n * m + n + m")), float(share)).collect()
    return [(r._down, r._across) for r in rows]


def test_grid_follows_both_sides(spark):
    assert grid_of(spark, 10, 10, 1000) == []
    assert grid_of(spark, 200, 200, 1000) == [(7, 6)]
    assert grid_of(spark, 100_000, 1, 1000) == [(201, 1)]
    assert grid_of(spark, 100_000, 0, 1000) == [(100, 1)]
    assert grid_of(spark, 1, 100_000, 1000)[0][0] == 1
    down, across = grid_of(spark, 1e6, 1e4, 1e6)[0]
    assert down * across >= 1e4 and 50 < down / across < 200


def test_one_sided_hot_keys(spark):
    left = spark.range(900).selectExpr(
        "case when id < 300 then 'gone' when id < 600 then 'one' else concat('k', id % 10) end a", "id"
    )
    right = spark.range(300).selectExpr("case when id = 0 then 'one' else concat('k', id % 10) end b", "id other")
    plain = left.join(right, F.col("a") == F.col("b"))
    assert same(plain, pair_join(left, right, "a", "b", rows_per_task=100))
    assert same(plain.select("id", "other"), pair_join(right, left, "b", "a", rows_per_task=100).select("id", "other"))


def test_tasks_follow_the_size_of_the_result(spark):
    even = spark.range(400).selectExpr("id % 20 surname", "id name")
    joined = self_join(even, "surname", rows_per_task=500)
    assert joined.rdd.getNumPartitions() == 18
    assert joined.count() == 8000 and joined.distinct().count() == 8000
    with pytest.raises(ValueError, match="rows_per_task"):
        self_join(even, "surname", rows_per_task=1, max_tasks=3)


def test_equal_rows_of_a_hot_key_are_spread(spark):
    df = spark.range(900).selectExpr("'same' surname", "1 name")
    joined = self_join(df, "surname", rows_per_task=20_000)
    sizes = [r["rows"] for r in partition_profile(joined).collect()]
    assert sum(sizes) == 810_000 and max(sizes) < 810_000 / 6
    # places are read from a table, so that a second run of a task finds them again
    assert sorted(r["rows"] for r in partition_profile(joined).collect()) == sorted(sizes)


@pytest.mark.parametrize("block_rows, per_cell", [(4096, 8), (7, 2), (1, 1)])
def test_factored_join_is_the_plain_join(spark, block_rows, per_cell):
    df = skewed(spark, 300)
    other = prefix_columns(df, df.columns).withColumn("more", F.lit(None).cast("int"))
    plain = df.join(other, df.surname == other.another_surname)
    factored = factor_join(df, other, "surname", "another_surname", block_rows=block_rows, blocks_per_cell=per_cell)
    assert factored.columns == ["left_rows", "right_rows"]
    expanded = expand_pairs(factored)
    assert expanded.columns == plain.columns and same(plain, expanded)


def test_factored_join_bounds_what_a_task_holds(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id)) surname", "id name")
    other = prefix_columns(df, df.columns)
    factored = factor_join(df, other, "surname", "another_surname", block_rows=50, blocks_per_cell=4)
    sizes = factored.select(F.size("left_rows").alias("l"), F.size("right_rows").alias("r"), F.spark_partition_id().alias("p"))
    rows = sizes.collect()
    assert sum(r.l * r.r for r in rows) == 1000 * 1000 + 2000
    assert max(max(r.l, r.r) for r in rows) < 100
    hot = [r for r in rows if r.l > 1]
    assert len(hot) == 400 and len({r.p for r in hot}) > 8


def test_large_joins_are_planned_and_not_refused(spark, plan, monkeypatch):
    """Ten million rows on 92 keys make 1.1e12 pairs: the plan holds blocks, and a small table gives its plain join."""
    df = spark.range(920).selectExpr("cast(id % 92 as string) surname", "id name")
    told = spark.range(92).selectExpr("cast(id as string) _k", "cast(108696 as decimal(19,0)) n", "cast(108696 as decimal(19,0)) m")
    other = prefix_columns(df, df.columns)
    joined = pair_join(df, other, "surname", "another_surname", counts=told)
    assert joined.rdd.getNumPartitions() <= 92 * 16 and plan(joined).count("* Generate (") >= 2
    assert joined.count() == 9200
    monkeypatch.setattr("runwise.operators.joins.MAX_TASKS", 4)
    assert same(self_join(df, "surname", rows_per_task=10), df.join(other, df.surname == other.another_surname))


def test_workload_counts_its_key_in_one_scan(spark, tmp_path):
    spark.range(100).selectExpr(*[f"cast(id % 7 as string) {c}" for c in PERSON_COLUMNS]).write.parquet(f"{tmp_path}/people")
    people = spark.read.parquet(f"{tmp_path}/people")
    result = run_workload(people)
    for df in (result.rows, result.counts, result.other_counts, result.joined_rows):
        assert f"{tmp_path}/people" not in "".join(df.inputFiles())
    assert result.rows.first()[0] == 100 and result.counts.first()["count"] == 15
    assert result.joined_rows.first()[0] == sum(n * n for n in (15, 15, 14, 14, 14, 14, 14))


def test_join_of_two_different_sides(spark):
    left = spark.createDataFrame([(1,), (1,), (2,)], "a int")
    right = spark.createDataFrame([(1,), (2,), (2,), (9,)], "b int")
    assert join_size(left, right, "a", "b").first()[0] == 4
    assert join_size(left.filter("a > 5"), right, "a", "b").first()[0] == 0


def test_join_size_type_holds_large_results(spark):
    size = join_size(spark.range(3), spark.range(3), "id", "id")
    assert size.schema["pairs"].dataType.simpleString() == "decimal(38,0)"


def test_join_size_never_joins_rows(spark, plan):
    text = plan(join_size(skewed(spark), skewed(spark), "surname", "surname"))
    assert "partial_count" in text


def test_derived_columns_skip_nulls(spark):
    people = spark.createDataFrame(
        [("A", None, "C", "s", None, "01", "02"), (None, None, None, None, None, None, "9")],
        "surname string, name string, patronymic string, street string, city string, "
        "series_passport string, number_passport string",
    )
    rows = [(r.fio, r.address, r.document) for r in derive_persons(people).collect()]
    assert rows == [("A C", "s", "01 02"), ("", "", "9")]


def test_prefix_ignores_missing_columns(spark):
    df = spark.createDataFrame([(1, 2)], "name int, other int")
    assert prefix_columns(df).columns == ["another_name", "other"]
    people = derive_persons(generate_persons(person_ids(spark, 1))).drop("fio", "document")
    renamed = prefix_columns(people).columns
    assert len(renamed) == 12 and all(c.startswith("another_") for c in renamed)


def test_value_counts(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "v string")
    assert [tuple(r) for r in value_counts(df, "v").collect()] == [("c", 2), (None, 1), ("a", 1), ("b", 1)]
    assert [tuple(r) for r in value_counts(df, "v", limit=1).collect()] == [("c", 2)]


def test_top_values_need_no_full_sort(spark, plan):
    assert "TakeOrderedAndProject" in plan(value_counts(skewed(spark), "surname", limit=20))


def test_row_count_and_partitions(spark):
    df = spark.range(100).repartition(4)
    assert row_count(df).first().rows == 100
    profile = {r.partition: r.rows for r in partition_profile(df).collect()}
    assert len(profile) == 4 and sum(profile.values()) == 100


def test_trials(spark):
    trials = spark.createDataFrame(
        [(0, 1, 100, 5.0), (0, 2, 200, 3.0), (1, 1, 300, 3.0), (1, 2, 400, None)],
        "generation int, individual int, value int, duration_s double",
    )
    stats = {r.generation: (r.avg, r.min, r.max) for r in trial_stats(trials).collect()}
    assert stats == {0: (4.0, 3.0, 5.0), 1: (3.0, 3.0, 3.0)}
    best = best_trial(trials).first()
    assert (best.duration_s, best.generation, best.individual, best.value) == (3.0, 0, 2, 200)
    assert best_trial(trials.limit(0)).isEmpty()
