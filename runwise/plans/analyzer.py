"""From event logs and configuration logs to a memory curve."""

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from runwise.operators import (
    Curve, app_metrics, combine_predictions, fit_curve, predict_curve, probe_points, read_curve, refit_curve,
    task_metrics, training_points, write_curve,
)
from runwise.sources import read_config_logs, read_event_logs


class Analysis(NamedTuple):
    points: DataFrame
    curve: Curve
    probe: DataFrame


def analyze_runs(
    spark: SparkSession, event_logs: str, config_logs: str, points_path: str, rows_key: str = "limit",
    curve_path: str | None = None, old_curve_path: str | None = None,
) -> Analysis:
    """Fit input rows -> executor memory on all logged runs and probe the curve.

    The event logs are read once: the training points, one row per application,
    are written to ``points_path`` and everything after starts from there. The
    curve is written to ``curve_path``; one that an earlier run wrote to
    ``old_curve_path`` is refitted with the new points.
    """
    metrics = app_metrics(task_metrics(read_event_logs(spark, event_logs, complete=True)))
    configs = read_config_logs(spark, config_logs)
    training_points(combine_predictions(metrics), configs, rows_key).write.mode("overwrite").parquet(points_path)
    points = spark.read.parquet(points_path)
    curve = fit_curve(points) if old_curve_path is None else refit_curve(read_curve(spark, old_curve_path), points)
    if curve_path is not None:
        curve = write_curve(curve, curve_path)
    return Analysis(points, curve, predict_curve(curve, probe_points(spark)))
