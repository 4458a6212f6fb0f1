"""Ranking of parameter trials, taken from the history of real runs."""

from pyspark.sql import DataFrame, functions as F


def trial_table(configs: DataFrame, durations: DataFrame, param: str) -> DataFrame:
    """``(application_attempt, param, value, duration_s)`` of runs that set ``param``."""
    chosen = configs.select(
        "application_attempt", F.lit(param).alias("param"), F.col("record")[param].try_cast("bigint").alias("value")
    ).filter(F.col("value").isNotNull())
    took = durations.select("application_attempt", (F.col("duration_ms") / 1000).alias("duration_s"))
    return chosen.join(took, "application_attempt")


def trial_stats(trials: DataFrame, by: str = "generation") -> DataFrame:
    """Mean, least and largest duration per group of trials."""
    return trials.groupBy(by).agg(
        F.avg("duration_s").alias("avg"), F.min("duration_s").alias("min"), F.max("duration_s").alias("max")
    )


def best_trial(trials: DataFrame, ties=("generation", "individual")) -> DataFrame:
    """The fastest trial; ``ties`` decide between equal durations.

    A minimum over structs needs no sort and combines before the shuffle.
    """
    best = F.min(F.struct("duration_s", *ties, "value"))
    return trials.filter(F.col("duration_s").isNotNull()).agg(best.alias("b")).filter("b is not null").select("b.*")
