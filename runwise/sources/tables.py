"""Tables as CSV or Parquet on any path Spark can open."""

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("csv", "parquet")


def _check(fmt: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown table format {fmt!r}, expected one of {FORMATS}")


def read_table(spark: SparkSession, fmt: str, path: str, schema=None, infer: bool = False) -> DataFrame:
    """Read a table. CSV has a header and all-string columns unless told otherwise.

    ``infer`` costs a pass over the whole input, so it is off by default.
    """
    _check(fmt)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", infer and schema is None)
    return reader.format(fmt).load(path)


def write_table(df: DataFrame, fmt: str, path: str, mode: str = "overwrite") -> None:
    """Write a table: Parquet with snappy, or CSV with a header line."""
    _check(fmt)
    writer = df.write.mode(mode)
    writer = writer.option("header", True) if fmt == "csv" else writer.option("compression", "snappy")
    writer.format(fmt).save(path)
