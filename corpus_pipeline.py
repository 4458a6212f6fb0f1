"""A training-data pipeline over ``documents``: clean, drop near duplicates and benchmark text, mix, tokenize.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a
DataFrame that is written as Parquet and read again for the next one. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from runwise.llm import decontaminate, mixing, neardup, quality
from runwise.llm.common import table
from runwise.llm.queries import token_output
from runwise.session import scratch_path


#: Bytes of a batch of texts on its way to a Python worker; Spark's own bound, 64 MB, is several times that in
#: buffers on either side for each task that runs on an executor.
BATCH_BYTES = 8 << 20


def _small_batches(spark: SparkSession) -> None:
    """Bound the batches of the stages with Python workers, for the rest of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that fail.

    Null and empty texts are rejected for their words. Rows are judged alone, so repeated rows and ties
    stay as they are, long texts are judged whole, an empty table gives an empty one, and further columns,
    whatever their names, are kept.
    """
    _small_batches(spark)
    return quality.clean_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id.

    Texts without a word, null ones too, all stay. Rows that repeat an id and a text are one; ties go to the text of
    the smallest hash. Null ids come last. Long texts are compared whole, an empty table gives an empty one, and further
    columns are kept, from one of the repeated rows.
    """
    _small_batches(spark)
    return neardup.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go.

    Null and empty texts are clean, rows that repeat or share an id are judged alone, long texts are looked through whole,
    an empty table of documents or of benchmark items is no error, and further columns are kept.
    """
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents, as often as its target takes them, in the order of the curriculum.

    Null is a source of its own; null and empty texts have no words and are not taken. Rows that repeat are
    taken each for itself, ties are ordered by a hash of the id, a long text counts all its words, an empty table gives an
    empty one, and further columns are kept.
    """
    return mixing.mix(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document of the mix, from the files written.

    The shards follow the curriculum: ``docs`` is the mix as read from its Parquet, which was sorted
    by training position, so a row's file and its place there are its place in training. Null and empty texts are
    an end id, null ids stay, rows that repeat are written as often as they come, long texts whole; an empty table
    gives no shard and no row. Further columns play no part.
    """
    _small_batches(spark)
    # by number: names of more than 99,999 files do not sort by theirs
    file = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("bigint")
    return token_output(spark, docs, order=(file, F.col("_metadata.file_name"), F.col("_metadata.row_index")))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
    ("token output", token_shards),
]

#: SQL can express neither the signatures nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
