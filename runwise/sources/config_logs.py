"""Configuration logs: one JSON object per application run."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runwise.functions import fold_entries, keep_public, memory_to_bytes, parse_params

ID = "application_attempt"
# When a record was written, in microseconds; not part of the record itself.
LOGGED_AT = "logged_at"
# Records up to which each gets a folder of its own; more share files, since a store takes files one by one.
OWN_FOLDERS = 100


def config_record(runs: DataFrame, fields: Sequence[str], params: str = "opp_parameters") -> DataFrame:
    """One flat key/value record per run: ``(application_attempt, record)``.

    ``fields`` are the configuration columns, ``params`` a column with a
    parameter string. Parameters override fields and the application id
    overrides both; secrets are left out, and so are fields without a value.
    """
    def entry(key: str) -> Column:
        return F.struct(F.lit(key).alias("key"), F.col(key).cast("string").alias("value"))

    entries = F.concat(
        F.array(*[entry(f) for f in fields]),
        F.coalesce(
            F.map_entries(parse_params(F.col(params))),
            F.array().cast("array<struct<key:string,value:string>>"),
        ),
        F.array(entry(ID)),
    )
    entries = F.filter(entries, lambda e: e["value"].isNotNull())
    return runs.select(F.col(ID).cast("string").alias(ID), keep_public(fold_entries(entries)).alias("record"))


def write_config_log(records: DataFrame, path: str) -> None:
    """Write records as JSON lines, each with the time it was logged, in place of older ones of the same application.

    Up to ``OWN_FOLDERS`` records, as single runs leave them, go into one folder with one file per application.
    Writing replaces the folders of the applications in ``records`` and leaves all others as they are.
    More records share new files, next to what is there; of an application that has several records then
    ``read_config_logs`` shows the one logged last. Records without an application are left out, since no reader finds them.
    """
    own = F.map_filter("record", lambda k, _: k != LOGGED_AT)
    now = F.create_map(F.lit(LOGGED_AT), F.unix_micros(F.current_timestamp()).cast("string"))
    lines = records.filter(F.col("record")[ID].isNotNull()).select(F.col("record")[ID].alias(ID), F.to_json(F.map_concat(own, now)).alias("value"))
    if lines.limit(OWN_FOLDERS + 1).count() > OWN_FOLDERS:
        lines.select("value").hint("rebalance").write.mode("append").text(path)
        return
    (
        lines.repartition(ID)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(ID)
        .text(path)
    )


def read_config_logs(spark: SparkSession, path: str) -> DataFrame:
    """``(application_attempt, spark_executor_memory in bytes, record)``, one row per run.

    Of several records of an application, as logs that were appended to have, the one
    logged last counts; one without a time is older than any with one.

    Keys differ from run to run, so a record is read as a map and not as
    inferred columns: no inference pass, and keys that differ only in case do
    not clash. Lines that are no JSON object or name no application are skipped.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    record = F.from_json("value", "map<string,string>")
    logged_at = F.coalesce(F.col("record")[LOGGED_AT].try_cast("bigint"), F.lit(-1))
    last = (
        lines.select("value", record.alias("record"))
        .filter(F.col("record")[ID].isNotNull())
        .groupBy(F.col("record")[ID].alias(ID))
        .agg(F.max_by("record", F.struct(logged_at, "value")).alias("record"))
    )
    return (
        last.select(ID, F.map_filter("record", lambda k, _: k != LOGGED_AT).alias("record"))
        .select(
            ID,
            memory_to_bytes(F.col("record")["spark_executor_memory"]).alias("spark_executor_memory"),
            "record",
        )
    )
