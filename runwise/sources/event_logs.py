"""Spark event logs as a DataFrame of events."""

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runwise.schemas import EVENT
from runwise.sources.codecs import DECODED, codec_of, decoded_lines
from runwise.sources.files import decoded, resolver, store_options

INPROGRESS = ".inprogress"

COMPACT = ".compact"

# Where an event stands: its file, and its place there or that of the split it was read in.
LOG_FILE, LOG_AT = "log_file", "log_at"
# The application that an archived line names; null in logs as Spark writes them, whose path has it.
LOG_APP = "log_application"

ID = "application_attempt"
# Events of an archived file at most, about 500 MB of JSON.
EVENTS_A_FILE = 1_000_000
# Applications up to which each gets a folder of its own; more share files, since a store takes files one by one.
OWN_FOLDERS = 100
# Events looked at first for the number of applications.
FIRST_EVENTS = 10_000
# What stands for a missing application, as in the name of a folder.
NO_APPLICATION = "__HIVE_DEFAULT_PARTITION__"

_SUFFIXES = r"(\.(zstd|lz4|snappy|lzf|inprogress|compact))+$"
_ROLLING = r"^events_(\d+)_"
_APP_FOLDER = r"/application_attempt=([^/]+)/"
# Names that Spark's JSON reader cannot decode.
_OTHER_CODECS = r"\.(lz4|snappy|lzf)(\.compact|\.inprogress)*$|\.zstd(\.compact|\.inprogress)+$"


def with_application_id(file_path: Column | None = None) -> Column:
    """The application a log line belongs to, from the path of its file.

    Plain logs are named by the application, parts of a rolling log are
    ``events_<n>_<application>``, both perhaps with a codec suffix, and the latter
    with ``.compact`` where Spark has condensed the parts up to it. Logs of few applications
    archived by ``write_event_logs`` keep the application in a folder name. The hidden
    ``_metadata`` column is used because, unlike ``input_file_name()``, it lets
    filters on the events reach the scan.
    """
    path = F.col("_metadata.file_path") if file_path is None else file_path
    folder = F.regexp_extract(path, _APP_FOLDER, 1)
    # a folder's name is escaped by the writer and again in the path
    folder = F.coalesce(_decoded(_decoded(folder)), _decoded(folder))
    name = F.regexp_replace(_decoded(F.substring_index(path, "/", -1)), _SUFFIXES, "")
    return F.when(folder != "", folder).otherwise(F.regexp_replace(name, _ROLLING, ""))


def _decoded(name: Column) -> Column:
    """A name without the escapes of a path; null if they are none."""
    return F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def application_of_line() -> Column:
    """The application of an event that ``read_event_logs`` gave: the one its line names, else that of its file."""
    return F.coalesce(F.col(LOG_APP), with_application_id(F.col(LOG_FILE)))


def part_number(file_path: Column) -> Column:
    """The number of a part of a rolling log; null for other files."""
    return F.regexp_extract(F.substring_index(file_path, "/", -1), _ROLLING, 1).try_cast("bigint")


def read_event_logs(
    spark: SparkSession, path: str, include_inprogress: bool = False, complete: bool = False, filesystem=None
) -> DataFrame:
    """All events below ``path`` with their ``application_attempt``, ``log_file``, ``log_at`` and ``log_application``.

    The schema is given, so there is no inference pass, and lines that are not
    JSON come out as null events, which every event filter drops. Files are listed once. Those in a codec
    that the JSON reader lacks are decoded on the executors, see ``codecs``, and parsed by the same schema.

    Plain logs of running applications are left out unless asked for. The parts of a rolling log
    do not tell in their names whether it is complete, so they are always read;
    ``app_durations`` has only applications that logged their end. Parts that a
    compacted part of the same folder covers are left out.

    A log in lzf, which nothing here decodes, gives no event; with ``complete`` it raises an error instead.
    ``log_at`` orders the events of a file: the start of the split for plain files, the line for decoded ones.
    ``filesystem``, a pyarrow file system, opens files to decode where the session's store options don't.
    """
    line = f"{EVENT}, {ID} string"
    plain = spark.read.schema(line).option("recursiveFileLookup", True).json(path)
    fields = [c for c in plain.columns if c != ID]
    # spelt as in the metadata
    files = [re.sub(r"^(\w+):///", r"\1:/", f) for f in plain.inputFiles()]
    other, covered = _sorted_out(files, include_inprogress)
    unknown = [file for file, codec in other if codec not in DECODED]
    if unknown and complete:
        raise ValueError(f"cannot decode event log {unknown[0]}; use zstd, lz4, snappy or no compression")
    other = [(file, codec) for file, codec in other if codec in DECODED]
    name, file = F.col("_metadata.file_name"), F.col("_metadata.file_path")
    # filters on the file's name leave its files out of the scan
    if other or unknown:
        plain = plain.filter(~name.rlike(_OTHER_CODECS))
    if covered:
        plain = plain.filter(~file.isin(covered))
    if not include_inprogress:
        plain = plain.filter(~name.endswith(INPROGRESS))
    events = plain.select(*fields, file.alias(LOG_FILE), F.col("_metadata.file_block_start").alias(LOG_AT), F.col(ID).alias(LOG_APP))
    if other:
        lines = decoded_lines(spark, [(f, decoded(f), codec) for f, codec in other], resolver(store_options(spark), filesystem))
        parsed = lines.select(LOG_FILE, LOG_AT, F.from_json("line", line).alias("e")).select("e.*", LOG_FILE, LOG_AT)
        events = events.unionByName(parsed.withColumnRenamed(ID, LOG_APP))
    return events.withColumn(ID, application_of_line())


def _sorted_out(files: list[str], include_inprogress: bool) -> tuple[list[tuple[str, str]], list[str]]:
    """Of the listed files, those that the JSON reader cannot decode with their codec, and those that a compacted part covers."""
    last: dict[str, int] = {}
    placed = []
    for file in files:
        folder, _, name = file.rpartition("/")
        number = re.match(_ROLLING, name)
        placed.append((file, folder, name, int(number[1]) if number else None))
        if number and name.endswith(COMPACT):
            last[folder] = max(last.get(folder, 0), int(number[1]))
    other, covered = [], []
    for file, folder, name, number in placed:
        upto = last.get(folder, 0)
        if number is not None and (number < upto or number == upto and not name.endswith(COMPACT)):
            covered.append(file)
        elif re.search(_OTHER_CODECS, name) and (include_inprogress or not name.endswith(INPROGRESS)):
            other.append((file, codec_of(name) or ""))
    return other, covered


def unreadable_event_logs(spark: SparkSession, path: str) -> DataFrame:
    """Paths of logs that Spark can write but nothing here decodes: those in lzf.

    Such files do not fail, they read as empty, so a job that must see every
    application should look here first.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*{.lzf,.lzf.compact,.lzf.inprogress}")
        .load(path)
        .select("path")
    )


def require_readable(spark: SparkSession, path: str) -> None:
    """Raise if a log below ``path`` cannot be decoded. ``read_event_logs`` does the same from its own listing."""
    unreadable = unreadable_event_logs(spark, path).first()
    if unreadable is not None:
        raise ValueError(f"cannot decode event log {unreadable.path}; use zstd, lz4, snappy or no compression")


def write_event_logs(events: DataFrame, path: str) -> None:
    """Archive events as JSON lines in gzip: one folder per application, or many applications in shared files.

    Up to ``OWN_FOLDERS`` applications have folders. Of more, each line names its application, so that
    neither the files nor the time to make, list and open them grow with the applications.

    The rebalance hint gathers an application into few files, yet lets adaptive
    execution split one that is much larger than the rest. A file in gzip is read by one task,
    so a large one is continued in another after ``EVENTS_A_FILE`` events. Level two packs these lines at twice
    the speed of the default, into a quarter more bytes.
    """
    events = events.drop(LOG_FILE, LOG_AT, LOG_APP)
    shared = _more_applications(events, OWN_FOLDERS)
    if shared:
        # the id that the name of a folder would give
        events = events.withColumn(ID, F.coalesce(F.nullif(F.col(ID).cast("string"), F.lit("")), F.lit(NO_APPLICATION)))
    writer = (
        events.hint("rebalance", ID)
        .write.mode("overwrite")
        .option("compression", "gzip")
        .option("zlib.compress.level", "TWO")
        .option("maxRecordsPerFile", EVENTS_A_FILE)
    )
    (writer if shared else writer.partitionBy(ID)).json(path)


def _more_applications(events: DataFrame, number: int) -> bool:
    """Whether ``events`` are of more than ``number`` applications; all are looked at unless the first few tell."""
    ids = events.select(ID)
    if len({r[0] for r in ids.limit(FIRST_EVENTS).collect()}) > number:
        return True
    return ids.distinct().limit(number + 1).count() > number
