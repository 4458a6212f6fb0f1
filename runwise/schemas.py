"""Schemas of the tables and logs this package reads."""

from pyspark.sql import types as T

PERSON_COLUMNS = (
    "surname", "name", "patronymic", "phone", "street", "city",
    "series_passport", "number_passport", "birthday", "created_dt", "updated_dt",
)

PERSON = T.StructType([T.StructField(c, T.StringType()) for c in PERSON_COLUMNS])

# Only the leaves the operators read. Spark's JSON reader skips everything a
# schema does not name, so the many other fields of an event cost no decoding.
EVENT = """
  Event string,
  Timestamp bigint,
  `Spark Properties` map<string, string>,
  `Task Info` struct<
    `Launch Time`: bigint, `Finish Time`: bigint,
    Accumulables: array<struct<Name: string, Update: string>>>,
  `Task Metrics` struct<
    `JVM GC Time`: bigint,
    `Memory Bytes Spilled`: bigint, `Disk Bytes Spilled`: bigint,
    `Result Size`: bigint,
    `Input Metrics`: struct<`Bytes Read`: bigint>,
    `Output Metrics`: struct<`Bytes Written`: bigint>,
    `Shuffle Read Metrics`: struct<
      `Remote Bytes Read`: bigint, `Local Bytes Read`: bigint,
      `Remote Bytes Read To Disk`: bigint>,
    `Shuffle Write Metrics`: struct<`Shuffle Bytes Written`: bigint>>
"""

FOOTER = "path string, num_rows bigint, num_columns bigint, serialized_size bigint"

TASK_END = "SparkListenerTaskEnd"
APPLICATION_START = "SparkListenerApplicationStart"
APPLICATION_END = "SparkListenerApplicationEnd"
ENVIRONMENT_UPDATE = "SparkListenerEnvironmentUpdate"
