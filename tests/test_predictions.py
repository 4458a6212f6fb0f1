from pyspark.sql import functions as F

from runwise import fixtures as fx
from runwise.operators import (
    app_metrics, combine_predictions, predict_footprint, predict_gc, predict_spill, task_bytes, task_metrics,
    task_peak_memory, training_points,
)
from runwise.operators.metrics import PEAK_MEMORY
from runwise.schemas import EVENT, TASK_END

BASE = 1 << 30


def event(app, duration=100, gc=10, spill=(0, 0), moved=(1, 2, 3, 4, 5, 6, 7), updates=()):
    """A task-end event as a nested dictionary; ``updates`` are peak-memory values."""
    read, remote, result, written, local, to_disk, output = moved
    return {
        "application_attempt": app, "Event": TASK_END,
        "Task Info": {
            "Launch Time": 1000, "Finish Time": 1000 + duration,
            "Accumulables": [{"Name": "other", "Update": "99999"}, {"Name": None, "Update": "1"},
                             *({"Name": PEAK_MEMORY, "Update": u} for u in updates)],
        },
        "Task Metrics": {
            "JVM GC Time": gc, "Memory Bytes Spilled": spill[0], "Disk Bytes Spilled": spill[1], "Result Size": result,
            "Input Metrics": {"Bytes Read": read}, "Output Metrics": {"Bytes Written": output},
            "Shuffle Read Metrics": {"Remote Bytes Read": remote, "Local Bytes Read": local,
                                     "Remote Bytes Read To Disk": to_disk},
            "Shuffle Write Metrics": {"Shuffle Bytes Written": written},
        },
    }


def tasks(spark, *events):
    return task_metrics(spark.createDataFrame(list(events), f"application_attempt string, {EVENT}"))


def by_app(df):
    return {r.application_attempt: r for r in df.collect()}


def test_independent_maxima_and_sums(spark):
    m = by_app(app_metrics(tasks(
        spark, event("a", 100, 10, (5, 1), updates=["7"]), event("a", 300, 30, (2, 9), updates=["3", "11"]),
    )))["a"]
    assert (m.total_duration, m.total_gc, m.mem_spill, m.disk_spill) == (400, 40, 5, 9)
    assert (m.max_bytes_all, m.max_peak_mem, m.has_peak) == (28, 11, 1)


def test_largest_of_repeated_updates(spark):
    updates = {"a": ["3", None, "x", "12", "4"], "b": ["5"], "c": [None, None]}
    t = tasks(spark, *(event(app, updates=u) for app, u in updates.items()))
    got = {r.application_attempt: (r.has_peak, r.peak) for r in t.collect()}
    assert got == {"a": (1, 12), "b": (1, 5), "c": (1, None)}


def test_formulas(spark):
    metrics = app_metrics(tasks(spark, event("a", 100, 25, (1000, 3000), updates=["72"])))
    gc, spill, footprint = (by_app(f(metrics))["a"] for f in (predict_gc, predict_spill, predict_footprint))
    assert gc.prediction1 == (25 / 100 - 0.1) * BASE and gc.prediction1_mb == 154
    assert spill.prediction2 == 2000.0
    assert footprint.prediction3 == (28 + 72) / BASE - 0.6 / 2 * BASE and footprint.prediction3_mb == -307
    assert by_app(combine_predictions(metrics))["a"].prediction == footprint.prediction3


def test_applications_without_the_metric_drop_out(spark):
    metrics = app_metrics(tasks(spark, event("none"), event("null", updates=[None]), event("text", updates=["x"])))
    assert set(by_app(predict_gc(metrics))) == {"none", "null", "text"}
    combined = by_app(combine_predictions(metrics))
    assert set(combined) == {"null", "text"}
    assert combined["null"].prediction3 is None
    assert combined["null"].prediction == combined["null"].prediction2 == 0.0


def test_zero_duration_gives_no_first_prediction(spark):
    metrics = app_metrics(tasks(spark, event("a", 0, 0, updates=["1"])))
    row = by_app(combine_predictions(metrics))["a"]
    assert row.prediction1 is None and row.prediction == row.prediction3


def test_unknown_part_makes_bytes_unknown(spark):
    t = tasks(spark, event("a", moved=(1, None, 1, 1, 1, 1, 1)), event("a", moved=(1, 1, 1, 1, 1, 1, 1)))
    assert sorted(r.bytes_all or -1 for r in task_bytes(t).collect()) == [-1, 7]
    assert by_app(app_metrics(t))["a"].max_bytes_all == 7


def test_empty_accumulables_and_other_events(spark):
    bare, other = event("a"), event("b", updates=["1"])
    bare["Task Info"]["Accumulables"] = None
    other["Event"] = "SparkListenerTaskStart"
    t = tasks(spark, bare, other)
    assert [r.has_peak for r in t.collect()] == [0]
    assert task_peak_memory(t).isEmpty()


def branch_by_branch(events):
    """The predictions as separate aggregates over exploded events, then joined."""
    info, metric = F.col("`Task Info`"), F.col("`Task Metrics`")
    ended = events.filter(F.col("Event") == TASK_END)
    app = ended.groupBy("application_attempt")
    time = app.agg((F.sum(metric["JVM GC Time"]) / F.sum(info["Finish Time"] - info["Launch Time"])).alias("share"))
    spills = app.agg(((F.max(metric["Memory Bytes Spilled"]) + F.max(metric["Disk Bytes Spilled"])) / 2).alias("p2"))
    shuffle = metric["Shuffle Read Metrics"]
    moved = (
        metric["Input Metrics"]["Bytes Read"] + metric["Output Metrics"]["Bytes Written"] + metric["Result Size"]
        + metric["Shuffle Write Metrics"]["Shuffle Bytes Written"] + shuffle["Remote Bytes Read"]
        + shuffle["Local Bytes Read"] + shuffle["Remote Bytes Read To Disk"]
    )
    largest = app.agg(F.max(moved).alias("moved"))
    peaks = (
        ended.select("application_attempt", F.explode(info["Accumulables"]).alias("a"))
        .filter(F.col("a.Name") == PEAK_MEMORY)
        .groupBy("application_attempt").agg(F.max(F.col("a.Update").try_cast("bigint")).alias("peak"))
    )
    joined = time.join(spills, "application_attempt").join(largest, "application_attempt").join(peaks, "application_attempt")
    p1 = (F.col("share") - 0.1) * BASE
    p3 = (F.col("moved") + F.col("peak")) / BASE - 0.3 * BASE
    return joined.select("application_attempt", F.least(p1, "p2", p3).alias("prediction"))


def test_one_pass_equals_branch_by_branch(spark, sf_dir):
    events = fx.task_end_events(spark, sf_dir)
    one = combine_predictions(app_metrics(task_metrics(events))).select("application_attempt", "prediction")
    four = branch_by_branch(events)
    assert one.count() == four.count() == 9
    both = one.join(four.withColumnRenamed("prediction", "other"), "application_attempt")
    assert both.filter("abs(prediction - other) > 1e-6").isEmpty() and both.count() == 9


def test_one_exchange(spark, sf_dir, plan):
    text = plan(combine_predictions(app_metrics(task_metrics(fx.task_end_events(spark, sf_dir)))))
    lines = [l for l in text.splitlines() if "Exchange" in l and l.strip().startswith(("+-", ":-", "*"))]
    assert len(lines) == 1, text
    assert "Join" not in text


def test_training_points(spark):
    predictions = spark.createDataFrame(
        [("a", -100.0), ("b", -100.0), ("c", 1.0)], "application_attempt string, prediction double"
    )
    configs = spark.createDataFrame(
        [("a", 1000, {"limit": "5"}), ("b", 50, {"total_num_rows": "7"}), ("z", 1, {"limit": "1"})],
        "application_attempt string, spark_executor_memory bigint, record map<string,string>",
    )
    got = {r[0]: r[1:] for r in training_points(predictions, configs).collect()}
    assert got == {"a": (900.0, 5.0), "b": (-50.0, 7.0)}
    assert {r[0]: r.rows for r in training_points(predictions, configs, "total_num_rows", "none").collect()} == {
        "a": None, "b": 7.0}
