"""Time the headline jobs and print one JSON line.

Each job runs once to warm up, then three times; the median counts. Results go to
Spark's no-op sink, which makes every row without collecting any.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession, functions as F

from runwise import fixtures as fx, operators as op, plans, sources as src
from runwise.session import JOB_CONF, scratch_path, scratch_scope

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
PERSONS = int(os.environ.get("BENCH_PERSONS", "10000000"))


def session() -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
    )
    for key, value in JOB_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def branch_by_branch(events):
    """The same predictions as four aggregates of exploded events and three joins."""
    app = "application_attempt"
    tasks = op.task_metrics(events)
    time_ = tasks.groupBy(app).agg(F.sum(F.expr("finish_time - launch_time")).alias("t"), F.sum("jvm_gc_time").alias("gc"))
    spill = tasks.groupBy(app).agg(F.max("mem_spill").alias("ms"), F.max("disk_spill").alias("ds"))
    moved = op.task_bytes(tasks).groupBy(app).agg(F.max("bytes_all").alias("mb"))
    peak = (
        events.select(app, F.explode("`Task Info`.Accumulables").alias("a"))
        .filter(F.col("a.Name") == "internal.metrics.peakExecutionMemory")
        .groupBy(app).agg(F.max(F.col("a.Update").try_cast("bigint")).alias("pk"))
    )
    return moved.join(peak, app).join(spill, app).join(time_, app)


def jobs(spark):
    lineitem_events = fx.task_end_events(spark, SF_DIR)
    customers = fx.table(spark, SF_DIR, "customer")
    people = fx.person_rows(spark, SF_DIR)
    logs, configs = scratch_path(spark, "event_logs"), scratch_path(spark, "config_logs")
    src.write_event_logs(fx.log_events(spark, SF_DIR), logs)
    src.write_config_log(src.config_record(fx.config_runs(spark, SF_DIR), fx.CONFIG_FIELDS), configs)

    def metrics(events):
        return op.app_metrics(op.task_metrics(events))

    def others(df):
        return op.prefix_columns(df, df.columns)

    def points(events):
        return op.training_points(op.combine_predictions(metrics(events)), src.read_config_logs(spark, configs))

    priced = fx.table(spark, SF_DIR, "lineitem").selectExpr("l_quantity rows", "l_extendedprice mem")
    orders = fx.table(spark, SF_DIR, "orders").selectExpr("cast(o_custkey as double) rows", "o_totalprice mem")
    curve = op.write_curve(op.fit_curve(orders), scratch_path(spark, "curve"))
    few = fx.table(spark, SF_DIR, "customer").selectExpr("cast(c_custkey % 92 as string) surname", "c_custkey", "c_name")
    csv = scratch_path(spark, "csv")
    src.write_table(fx.table(spark, SF_DIR, "customer"), "csv", csv)
    workload = scratch_path(spark, "workload")
    people_out = scratch_path(spark, "people")
    return {
        "app_metrics": lambda: drain(metrics(lineitem_events)),
        "app_metrics_four_branches": lambda: drain(branch_by_branch(lineitem_events)),
        "combine_predictions": lambda: drain(op.combine_predictions(metrics(lineitem_events))),
        "event_logs_app_metrics": lambda: drain(metrics(src.read_event_logs(spark, logs))),
        "event_logs_four_branches": lambda: drain(branch_by_branch(src.read_event_logs(spark, logs))),
        "event_logs_training_points": lambda: drain(points(src.read_event_logs(spark, logs))),
        "fit_curve": lambda: op.fit_curve(priced),
        "fit_curve_cut": lambda: op.fit_curve(orders, local_points=1000),
        "predict_curve": lambda: drain(op.predict_curve(curve, orders.select("rows"))),
        "read_table_csv": lambda: drain(src.read_table(spark, "csv", csv)),
        "run_workload": lambda: drain(plans.run_workload(people, workload).joined_rows),
        "self_join_few_keys": lambda: drain(op.self_join(few, "surname")),
        "value_counts": lambda: drain(op.value_counts(people, "surname")),
        "value_counts_top": lambda: drain(op.value_counts(people, "surname", limit=20)),
        "join_size": lambda: drain(op.join_size(customers, others(customers), "c_mktsegment", "another_c_mktsegment")),
        "join_then_count": lambda: op.self_join(customers, "c_mktsegment").count(),
        "self_join": lambda: drain(op.self_join(people, "surname")),
        "self_join_write": lambda: src.write_table(op.self_join(people, "surname"), "parquet", workload),
        "derive_persons": lambda: drain(op.derive_persons(people)),
        "parquet_profile": lambda: drain(src.parquet_profile(src.parquet_footers(spark, SF_DIR))),
        f"generate_{PERSONS}_persons_to_parquet": lambda: src.write_table(
            src.generate_persons(src.person_ids(spark, PERSONS)), "parquet", people_out
        ),
        "best_trial": lambda: drain(op.best_trial(fx.trial_rows(spark, SF_DIR))),
    }


def main() -> None:
    spark = session()
    only = set(sys.argv[1:])
    seconds = {}
    for name, job in jobs(spark).items():
        if only and name not in only:
            continue
        times = []
        for _ in range(RUNS + 1):
            with scratch_scope(spark):
                start = time.perf_counter()
                job()
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
    print(json.dumps({
        "metric": "headline_jobs_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
