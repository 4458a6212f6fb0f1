"""Session settings and the shared scratch folder."""

import contextlib
import contextvars
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this package relies on; all are plain Spark options.
JOB_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "snappy",
}


def event_log_conf(event_log_dir: str) -> dict[str, str]:
    """Options that make an application leave an event log in ``event_log_dir``."""
    return {"spark.eventLog.enabled": "true", "spark.eventLog.dir": event_log_dir}


def s3a_conf(endpoint: str, access_key: str, secret_key: str) -> dict[str, str]:
    """Options that open ``s3a://`` paths on an S3-compatible store."""
    return {
        "spark.hadoop.fs.s3a.endpoint": endpoint,
        "spark.hadoop.fs.s3a.access.key": access_key,
        "spark.hadoop.fs.s3a.secret.key": secret_key,
        "spark.hadoop.fs.s3a.path.style.access": "true",
    }


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="runwise-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``.

    Executors must all see the folder, so a machine-local one is made up only
    where driver and executors are one process (``local`` masters).
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_folder()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    owned = _owned.get()
    if owned is not None:
        owned.append(path)
    return path


_owned: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("owned", default=None)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete, at its end, the scratch tables that were made inside.

    What comes out of it must be written, counted or collected before it ends: a DataFrame
    that reads a scratch table cannot be read any more. Scopes may be nested; each
    deletes its own paths only, through Hadoop, so on any store. Without a scope
    scratch tables stay, since results are lazy and may still need them.
    """
    token = _owned.set([])
    try:
        yield
    finally:
        paths = _owned.get()
        _owned.reset(token)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder, which cuts the lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
