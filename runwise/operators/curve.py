"""Isotonic curve from input rows to executor memory."""

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from runwise.functions import to_mib
from runwise.operators.wide_curve import LOCAL_POINTS, interpolate, isotonic_blocks, label_moments

# The input sizes a fitted curve is shown for.
PROBE_ROWS = (50, 100, 1000, 10000, 10000000)


class Curve(NamedTuple):
    """A fitted curve: ``(boundary, prediction)`` rows."""

    table: DataFrame


def probe_points(spark: SparkSession) -> DataFrame:
    """The probe grid as one double column ``rows``."""
    return spark.createDataFrame([(float(r),) for r in PROBE_ROWS], "rows double")


def pooled_points(
    points: DataFrame, feature: str = "rows", label: str = "mem", weight: str | None = None
) -> DataFrame:
    """One weighted point ``(rows, mem, weight)`` per distinct feature.

    Pooling equal features to their mean is the first step of an isotonic fit
    anyway. Done as an aggregate it combines before the shuffle, whereas the fit
    would bring all points of one feature into one task. A group with a missing
    label has none itself, so that the fit refuses it.
    """
    w = F.lit(1.0) if weight is None else F.col(weight)
    total, known = F.sum(w), F.count(label) == F.count("*")
    return points.groupBy(F.col(feature).cast("double").alias("rows")).agg(
        F.when(known, F.sum(w * F.col(label)) / total).alias("mem"), total.alias("weight")
    )


def fit_curve(
    points: DataFrame, feature: str = "rows", label: str = "mem", weight: str | None = None,
    local_points: int = LOCAL_POINTS,
) -> Curve:
    """Least-squares non-decreasing curve through the points, of weight one unless given.

    ``local_points`` is the number of points up to which a stretch of the curve is
    fitted by one task. The curve does not depend on it.
    """
    pooled = pooled_points(points, feature, label, weight).persist()
    try:
        number, whole, *moments = pooled.agg(
            F.count("*"), F.count(F.when(F.col("rows").isNotNull(), F.col("mem"))), *label_moments()).first()
        if number != whole:
            raise ValueError("every point needs a feature and a label")
        blocks = isotonic_blocks(pooled, number, local_points, moments=moments)
    finally:
        pooled.unpersist()
    ends = F.explode(F.array_distinct(F.array("start", "end")))
    return Curve(blocks.select(ends.alias("boundary"), "prediction"))


def predict_curve(curve: Curve, rows: DataFrame) -> DataFrame:
    """Add ``prediction`` and ``memory_prediction`` in MiB to a frame with numbers ``rows``.

    Between boundaries the curve is linear, beyond the ends it is flat. A null
    size, and any size under a curve without points, has no prediction.
    """
    return interpolate(curve.table, rows).withColumn("memory_prediction", to_mib(F.col("prediction")))


def merge_curve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Points ``(rows, mem, weight)`` of an old curve table, overridden where new runs exist.

    New points of equal size are pooled before they meet the old curve, so both
    sides of the join have one row per feature.
    """
    o = old.select(F.col("boundary").alias("rows"), F.col("prediction").alias("old_mem"))
    return o.join(pooled_points(new), "rows", "full_outer").select(
        "rows", F.coalesce("mem", "old_mem").alias("mem"), F.coalesce("weight", F.lit(1.0)).alias("weight")
    )


def refit_curve(old: DataFrame, new: DataFrame) -> Curve:
    """Curve through the merged points of an old curve and new runs."""
    return fit_curve(merge_curve(old, new), weight="weight")


def write_curve(curve: Curve, path: str) -> Curve:
    """Keep a curve as a table, and return the kept one."""
    curve.table.write.mode("overwrite").parquet(path)
    return Curve(read_curve(curve.table.sparkSession, path))


def read_curve(spark: SparkSession, path: str) -> DataFrame:
    """The ``(boundary, prediction)`` rows of a kept curve, as ``refit_curve`` takes them."""
    return spark.read.parquet(path)
