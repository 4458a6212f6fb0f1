"""The configuration record a job leaves of itself."""

from pyspark.sql import DataFrame, SparkSession

from runwise.sources import config_record


def own_record(spark: SparkSession, params: str = "", **fields) -> DataFrame:
    """Record of the running application: its id, memory, the given fields and parameters."""
    values = {
        "spark_executor_memory": spark.conf.get("spark.executor.memory", "1g"),
        **{name: None if value is None else str(value) for name, value in fields.items()},
    }
    row = {"application_attempt": spark.sparkContext.applicationId, "opp_parameters": params, **values}
    schema = ", ".join(f"`{name}` string" for name in row)
    return config_record(spark.createDataFrame([tuple(row.values())], schema), list(values))
