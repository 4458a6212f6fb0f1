"""Telemetry and person-like rows derived from the benchmark tables.

There is no event log in the benchmark data, so its rows are read as telemetry:
each ``lineitem`` is a finished task of the application of its supplier, each
``supplier`` but number 7 a configuration record, each ``order`` a person or a trial. All of it is
integer and string arithmetic over whole tables.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from runwise.operators.metrics import PEAK_MEMORY, TASK_FIELDS
from runwise.schemas import APPLICATION_END, APPLICATION_START, ENVIRONMENT_UPDATE, TASK_END

CONFIG_FIELDS = ("job", "need_to_join", "spark_executor_memory", "limit", "access_key")

TASK_SQL = """
  concat('app-', cast(l_suppkey as string)) application_attempt,
  l_orderkey * 1000 launch_time,
  l_orderkey * 1000 + 1 + (l_partkey * 37 + l_linenumber * 101) % 5000 finish_time,
  (l_partkey * 13 + l_linenumber) % 900 jvm_gc_time,
  case when l_partkey % 50 = 0 then (l_orderkey % 1000) * 1048576 else 0 end mem_spill,
  case when l_partkey % 75 = 0 then (l_orderkey % 500) * 1048576 else 0 end disk_spill,
  cast(l_quantity as bigint) * 1048576 input_read,
  l_partkey * 64 remote_read,
  cast(1000 + l_linenumber as bigint) result_size,
  l_orderkey % 4096 shuffle_written,
  l_partkey % 2048 local_read,
  cast(0 as bigint) remote_to_disk,
  case when l_returnflag = 'R' then l_orderkey * 10 else 0 end output_written,
  l_suppkey % 10 <> 9 and l_linenumber = 1 has_peak,
  case when l_suppkey % 10 not in (8, 9) and l_linenumber = 1 then l_partkey * 65536 end peak
"""

CONFIG_SQL = """
  concat('app-', cast(s_suppkey as string)) application_attempt,
  'csv' job, true need_to_join, 'not-for-logs' access_key,
  case s_suppkey % 4 when 0 then '1g' when 1 then '512m' when 2 then '536870912' else '451m' end
    spark_executor_memory,
  cast(((s_suppkey * 7) % 50 + 1) * 1000 as string) row_limit,
  case s_suppkey % 3
    when 0 then 'spark.sql.shuffle.partitions=1000;spark.default.parallelism=2000'
    when 1 then 'spark.sql.shuffle.partitions=150'
    else 'spark.sql.shuffle.partitions=150;spark.sql.shuffle.partitions=300' end opp_parameters
"""

PERSON_SQL = """
  concat('Customer-', cast(o_custkey as string)) surname,
  nullif(o_orderpriority, '2-HIGH') name,
  nullif(o_orderstatus, 'P') patronymic,
  cast(o_orderkey as string) phone,
  nullif(o_orderpriority, '5-LOW') street,
  o_orderstatus city,
  lpad(cast(o_custkey % 10000 as string), 4, '0') series_passport,
  lpad(cast(o_orderkey % 1000000 as string), 6, '0') number_passport,
  date_format(o_orderdate, 'd.M.yyyy') birthday,
  date_format(o_orderdate, 'd.M.yyyy') created_dt,
  date_format(o_orderdate, 'd.M.yyyy') updated_dt
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _select(spark: SparkSession, sf_dir: str, name: str, columns: str) -> DataFrame:
    return spark.sql(f"select {columns} from {{source}}", source=table(spark, sf_dir, name))


def flat_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, "lineitem", TASK_SQL)


def task_end_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task-end events nested as Spark logs them, plus ``application_attempt``."""
    flat = flat_tasks(spark, sf_dir)

    def leaf(name: str):
        return F.col(name).alias(TASK_FIELDS[name].split(".")[-1].strip("`"))

    noise = F.struct(F.lit("internal.metrics.jvmGCTime").alias("Name"), F.lit("7").alias("Update"))
    peak = F.struct(F.lit(PEAK_MEMORY).alias("Name"), F.col("peak").cast("string").alias("Update"))
    accumulables = F.when(F.col("has_peak"), F.array(noise, peak)).otherwise(F.array(noise))
    return flat.select(
        "application_attempt",
        F.lit(TASK_END).alias("Event"),
        F.struct(leaf("launch_time"), leaf("finish_time"), accumulables.alias("Accumulables")).alias("Task Info"),
        F.struct(
            leaf("jvm_gc_time"), leaf("mem_spill"), leaf("disk_spill"), leaf("result_size"),
            F.struct(leaf("input_read")).alias("Input Metrics"),
            F.struct(leaf("output_written")).alias("Output Metrics"),
            F.struct(leaf("remote_read"), leaf("local_read"), leaf("remote_to_disk")).alias("Shuffle Read Metrics"),
            F.struct(leaf("shuffle_written")).alias("Shuffle Write Metrics"),
        ).alias("Task Metrics"),
    )


def config_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").filter("s_suppkey <> 7")
    return spark.sql(f"select {CONFIG_SQL} from {{source}}", source=suppliers).withColumnRenamed("row_limit", "limit")


def application_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, end and environment events of the applications."""
    tasks = flat_tasks(spark, sf_dir).groupBy("application_attempt").agg(
        F.min("launch_time").alias("first"), F.max("finish_time").alias("last")
    )
    ends = tasks.select(
        "application_attempt",
        F.explode(F.array(
            F.struct(F.lit(APPLICATION_START).alias("Event"), F.col("first").alias("Timestamp")),
            F.struct(F.lit(APPLICATION_END).alias("Event"), F.col("last").alias("Timestamp")),
        )).alias("e"),
    ).select("application_attempt", "e.*")
    environment = config_runs(spark, sf_dir).select(
        "application_attempt",
        F.lit(ENVIRONMENT_UPDATE).alias("Event"),
        F.create_map(
            F.lit("spark.executor.memory"), F.col("spark_executor_memory"),
            F.lit("spark.hadoop.fs.s3a.access.key"), F.col("access_key"),
        ).alias("Spark Properties"),
    )
    return ends.unionByName(environment, allowMissingColumns=True)


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything an event log of these applications would hold."""
    return task_end_events(spark, sf_dir).unionByName(
        application_events(spark, sf_dir), allowMissingColumns=True
    )


def person_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, "orders", PERSON_SQL)


def trial_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey % 5 generation", "o_orderkey individual", "100 + o_custkey value", "o_totalprice duration_s"
    )
