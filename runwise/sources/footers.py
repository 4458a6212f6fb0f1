"""Sizes of Parquet files from their footers."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from runwise.schemas import FOOTER
from runwise.sources.files import resolver, store_options


def _footer_reader(resolve):
    """The function the Python workers run.

    It is nested so that it travels to the executors by value: they need
    pandas and pyarrow, but not this package.
    """
    def footer(path: str):
        import pyarrow as pa
        import pyarrow.parquet as pq

        store, name = resolve(path)
        with store.open_input_file(name) as file:
            try:
                meta = pq.ParquetFile(file).metadata
            except pa.ArrowInvalid:  # not Parquet
                return None
        return path, meta.num_rows, meta.num_columns, meta.serialized_size

    def footers(batches):
        import pandas as pd

        for batch in batches:
            found = [f for f in map(footer, batch["path"]) if f is not None]
            yield pd.DataFrame(found, columns=["path", "num_rows", "num_columns", "serialized_size"])

    return footers


def parquet_footers(spark: SparkSession, path: str, filesystem=None) -> DataFrame:
    """One row per ``*.parquet`` file below ``path``; files that are not Parquet are skipped.

    A file or store that cannot be read fails the job, so a profile never misses
    files in silence.

    Spark lists the files; only their names are read there, since the contents
    are not selected. Tasks then read the tail of each file. Listing packs tasks
    by file size, far too finely for footers, hence the narrow coalesce.
    Executors open files with the session's store options; ``filesystem``, a pyarrow
    file system, is for stores that need something else.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .load(path)
        .select("path")
        .coalesce(4 * spark.sparkContext.defaultParallelism)
    )
    return files.mapInPandas(_footer_reader(resolver(store_options(spark), filesystem)), FOOTER)


def parquet_profile(footers: DataFrame) -> DataFrame:
    """Totals over all files: one row, or none if there is no readable file."""
    return footers.agg(
        F.sum("num_rows").alias("total_num_rows"),
        F.max("num_columns").alias("max_num_columns"),
        F.sum("serialized_size").alias("total_serialized_size"),
    ).filter(F.col("total_num_rows").isNotNull())
