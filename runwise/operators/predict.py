"""Executor-memory predictions from application metrics.

Each prediction is a projection of the one-row-per-application frame of
``app_metrics``; together they cost one aggregate and no join.
"""

from pyspark.sql import Column, DataFrame, functions as F

from runwise.functions import to_mib

# Fixed values of the three estimates.
BASE_MEMORY = 1 << 30       # bytes taken as the executor's current memory
MEMORY_FRACTION = 0.6       # unified-memory share of the heap
GC_SHARE = 0.1              # share of run time garbage collection may take


def _gc(base: int) -> Column:
    share = F.try_divide("total_gc", "total_duration")
    return (share - F.lit(GC_SHARE)) * F.lit(base)


def _spill() -> Column:
    return (F.col("mem_spill") + F.col("disk_spill")) / F.lit(2)


def _footprint(base: int, fraction: float) -> Column:
    # The first term is a ratio and the second is bytes. That is the estimate as
    # defined; the ratio only matters for footprints of many gigabytes squared.
    ratio = (F.col("max_bytes_all") + F.col("max_peak_mem")) / F.lit(base)
    return ratio - F.lit(fraction) / F.lit(2) * F.lit(base)


def _reporting(metrics: DataFrame) -> DataFrame:
    """Applications of which at least one task reports peak memory."""
    return metrics.filter(F.col("has_peak") == 1)


def predict_gc(metrics: DataFrame, base: int = BASE_MEMORY) -> DataFrame:
    """Memory asked for by the share of time spent in garbage collection."""
    p = metrics.select("application_attempt", "total_duration", "total_gc", _gc(base).alias("prediction1"))
    return p.withColumn("prediction1_mb", to_mib(F.col("prediction1")))


def predict_spill(metrics: DataFrame) -> DataFrame:
    """Memory asked for by the largest spills."""
    return metrics.select("application_attempt", "mem_spill", "disk_spill", _spill().alias("prediction2"))


def predict_footprint(metrics: DataFrame, base: int = BASE_MEMORY, fraction: float = MEMORY_FRACTION) -> DataFrame:
    """Memory asked for by the largest task, where peak memory is reported."""
    p = _reporting(metrics).select(
        "application_attempt", "max_bytes_all", "max_peak_mem", _footprint(base, fraction).alias("prediction3")
    )
    return p.withColumn("prediction3_mb", to_mib(F.col("prediction3")))


def combine_predictions(
    metrics: DataFrame, base: int = BASE_MEMORY, fraction: float = MEMORY_FRACTION
) -> DataFrame:
    """All three predictions and the least of those that are known."""
    return (
        _reporting(metrics)
        .select(
            "application_attempt",
            _gc(base).alias("prediction1"),
            _spill().alias("prediction2"),
            _footprint(base, fraction).alias("prediction3"),
        )
        .withColumn("prediction", F.least("prediction1", "prediction2", "prediction3"))
    )


def training_points(
    predictions: DataFrame, configs: DataFrame, rows_key: str = "limit", fallback_key: str = "total_num_rows"
) -> DataFrame:
    """``(application_attempt, mem, rows)`` of the applications with a configuration log.

    ``mem`` is the memory the run had plus the predicted change, ``rows`` its
    input size under ``rows_key`` of the record, else under ``fallback_key``.
    """
    rows = F.coalesce(F.col("record")[rows_key], F.col("record")[fallback_key])
    runs = configs.select("application_attempt", "spark_executor_memory", rows.try_cast("double").alias("rows"))
    return predictions.join(runs, "application_attempt").select(
        "application_attempt",
        (F.col("prediction") + F.col("spark_executor_memory")).cast("double").alias("mem"),
        "rows",
    )
