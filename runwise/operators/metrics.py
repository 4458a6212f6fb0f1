"""Metrics of tasks and applications from event logs."""

from pyspark.sql import Column, DataFrame, functions as F

from runwise.functions.params import SECRET_KEYS
from runwise.schemas import APPLICATION_END, APPLICATION_START, ENVIRONMENT_UPDATE, TASK_END
from runwise.sources.event_logs import LOG_APP, LOG_AT, LOG_FILE, application_of_line, part_number

PEAK_MEMORY = "internal.metrics.peakExecutionMemory"

# Output column -> field of the event.
TASK_FIELDS = {
    "launch_time": "`Task Info`.`Launch Time`",
    "finish_time": "`Task Info`.`Finish Time`",
    "jvm_gc_time": "`Task Metrics`.`JVM GC Time`",
    "mem_spill": "`Task Metrics`.`Memory Bytes Spilled`",
    "disk_spill": "`Task Metrics`.`Disk Bytes Spilled`",
    "input_read": "`Task Metrics`.`Input Metrics`.`Bytes Read`",
    "remote_read": "`Task Metrics`.`Shuffle Read Metrics`.`Remote Bytes Read`",
    "result_size": "`Task Metrics`.`Result Size`",
    "shuffle_written": "`Task Metrics`.`Shuffle Write Metrics`.`Shuffle Bytes Written`",
    "local_read": "`Task Metrics`.`Shuffle Read Metrics`.`Local Bytes Read`",
    "remote_to_disk": "`Task Metrics`.`Shuffle Read Metrics`.`Remote Bytes Read To Disk`",
    "output_written": "`Task Metrics`.`Output Metrics`.`Bytes Written`",
}

MOVED_BYTES = (
    "input_read", "remote_read", "result_size", "shuffle_written",
    "local_read", "remote_to_disk", "output_written",
)


def task_metrics(events: DataFrame) -> DataFrame:
    """One flat row per finished task.

    The peak-memory accumulables are condensed inside the row's own array
    instead of exploding it. ``has_peak`` tells a task that reports the metric
    without a value from one that does not report it. Events of log files keep their ``log_file``
    and ``log_application``.
    """
    where = [c for c in (LOG_FILE, LOG_APP) if c in events.columns]
    tasks = events.filter(F.col("Event") == TASK_END).select(
        "application_attempt", *where,
        *[F.col(field).alias(name) for name, field in TASK_FIELDS.items()],
        F.col("`Task Info`.Accumulables").alias("accumulables"),
        _occurrences(F.col("`Task Info`.Accumulables.Name"), PEAK_MEMORY).alias("peaks"),
    )
    return tasks.select(
        "application_attempt", *where, *TASK_FIELDS, (F.col("peaks") > 0).cast("int").alias("has_peak"), _peak().alias("peak")
    )


def _occurrences(names: Column, name: str) -> Column:
    return F.coalesce(F.size(names) - F.size(F.array_remove(names, name)), F.lit(0))


def _peak() -> Column:
    """Largest peak-memory update of a task.

    A task nearly always reports the metric once, and then a lookup by position
    stays in generated code; lambda functions, which do not, take the other case.
    """
    accumulables = F.col("accumulables")
    position = F.array_position(F.col("accumulables.Name"), PEAK_MEMORY) - 1
    only = F.get(F.col("accumulables.Update"), position.cast("int")).try_cast("bigint")
    matching = F.filter(accumulables, lambda a: a["Name"] == PEAK_MEMORY)
    largest = F.array_max(F.transform(matching, lambda a: a["Update"].try_cast("bigint")))
    return F.when(F.col("peaks") == 1, only).when(F.col("peaks") > 1, largest)


def _moved() -> Column:
    total = F.col(MOVED_BYTES[0])
    for name in MOVED_BYTES[1:]:
        total = total + F.col(name)
    return total


def task_bytes(tasks: DataFrame) -> DataFrame:
    """Bytes a task read, shuffled, returned and wrote; null if a part is unknown."""
    return tasks.select("application_attempt", _moved().alias("bytes_all"))


def task_peak_memory(tasks: DataFrame) -> DataFrame:
    """Peak execution memory of the tasks that report it."""
    return tasks.filter(F.col("has_peak") == 1).select("application_attempt", F.col("peak").alias("peak_mem"))


def app_metrics(tasks: DataFrame) -> DataFrame:
    """One row per application: everything the predictions need, in one pass.

    All aggregates share one shuffle of partial results, one row per application
    and map task, so neither many tasks nor one dominating application hurts.
    Tasks of log files are totalled per file first, so that the application is
    read from a path once per file and not once per event. Those whose line names it need no path.
    """
    values = {
        "total_duration": (F.sum, F.col("finish_time") - F.col("launch_time")), "total_gc": (F.sum, F.col("jvm_gc_time")),
        "mem_spill": (F.max, F.col("mem_spill")), "disk_spill": (F.max, F.col("disk_spill")),
        "max_bytes_all": (F.max, _moved()), "max_peak_mem": (F.max, F.col("peak")), "has_peak": (F.max, F.col("has_peak")),
    }
    if LOG_FILE in tasks.columns:
        file = F.when(F.col(LOG_APP).isNull(), F.col(LOG_FILE)).alias(LOG_FILE)
        files = tasks.groupBy(file, LOG_APP).agg(*[f(c).alias(name) for name, (f, c) in values.items()])
        tasks = files.withColumn("application_attempt", application_of_line())
        values = {name: (f, F.col(name)) for name, (f, _) in values.items()}
    return tasks.groupBy("application_attempt").agg(*[f(c).alias(name) for name, (f, c) in values.items()])


def app_durations(events: DataFrame) -> DataFrame:
    """Wall-clock milliseconds of every application with a start and an end event."""
    start = F.min(F.when(F.col("Event") == APPLICATION_START, F.col("Timestamp")))
    end = F.max(F.when(F.col("Event") == APPLICATION_END, F.col("Timestamp")))
    return (
        events.filter(F.col("Event").isin(APPLICATION_START, APPLICATION_END))
        .groupBy("application_attempt")
        .agg((end - start).alias("duration_ms"))
        .filter(F.col("duration_ms").isNotNull())
    )


def effective_conf(events: DataFrame, redact: str = SECRET_KEYS) -> DataFrame:
    """``(application_attempt, key, value)`` of the settings applications ran under, one row per key.

    Spark logs all settings again when an application adds files or jars; where
    a value differs then, the last one logged is shown: that of the highest part
    of a rolling log, and there the one furthest on. Events that do not come from
    log files have no order, and the largest value is shown.
    """
    updates = events.filter(F.col("Event") == ENVIRONMENT_UPDATE)
    if LOG_FILE in events.columns:
        # within a split the running id follows the file
        file = F.col(LOG_FILE)
        order = F.struct(F.coalesce(part_number(file), F.lit(0)), file, LOG_AT, F.monotonically_increasing_id())
    else:
        order = F.lit(0)
    value = F.when(F.col("key").rlike(redact), F.lit("*(redacted)")).otherwise(F.col("value"))
    return (
        updates.select("application_attempt", order.alias("at"), "Spark Properties")
        .select("application_attempt", "at", F.explode("Spark Properties").alias("key", "value"))
        .groupBy("application_attempt", "key").agg(F.max_by(value, F.struct("at", value)).alias("value"))
    )
