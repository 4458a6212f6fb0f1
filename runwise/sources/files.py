"""Files of any store as executors open them: one way from a path to a file system."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import SparkSession

#: Hadoop options of an S3-compatible store, and the pyarrow arguments they become.
STORE_OPTIONS = {
    "fs.s3a.endpoint": "endpoint_override",
    "fs.s3a.endpoint.region": "region",
    "fs.s3a.access.key": "access_key",
    "fs.s3a.secret.key": "secret_key",
    "fs.s3a.session.token": "session_token",
}


def store_options(spark: SparkSession) -> dict[str, str]:
    """What the session says about its S3-compatible store, for ``file_of`` on executors."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = {argument: conf.get(option) for option, argument in STORE_OPTIONS.items()}
    found = {k: v for k, v in found.items() if v}
    if conf.get("fs.s3a.connection.ssl.enabled") == "false":
        found["scheme"] = "http"
    scheme, mark, host = found.get("endpoint_override", "").partition("://")
    if mark:
        found |= {"scheme": scheme, "endpoint_override": host.rstrip("/")}
    return found


def resolver(options: dict[str, str] | None = None, filesystem=None):
    """A function from a path, as Hadoop writes it, to (file system, name in it).

    Local paths, ``s3a`` and its other names with the session's ``options``, and whatever pyarrow
    opens by itself. ``filesystem`` takes the place of all of them. The function is nested so that it
    travels by value: executors need pyarrow and not this package.
    """
    options = dict(options or {})

    def resolve(path: str):
        from pyarrow import fs

        scheme, mark, rest = path.partition("://")
        if not mark:
            scheme, rest = "file", path.removeprefix("file:")
        if filesystem is not None:
            return filesystem, rest
        if scheme == "file":
            return fs.LocalFileSystem(), rest
        if scheme in ("s3", "s3a", "s3n"):
            return fs.S3FileSystem(**options), rest
        return fs.FileSystem.from_uri(path)

    return resolve


def decoded(path: str) -> str:
    """A path without the escapes that Spark puts into ``_metadata.file_path`` and ``inputFiles``."""
    return unquote(path)
