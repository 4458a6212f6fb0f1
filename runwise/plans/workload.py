"""The sample workload: derive, rename, count, self-join, write."""

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from runwise.operators import derive_persons, prefix_columns, self_join
from runwise.operators.joins import kept_key_counts, own_pairs, pairs_of
from runwise.operators.people import PREFIX
from runwise.schemas import PERSON_COLUMNS
from runwise.sources import write_table


class Workload(NamedTuple):
    derived: DataFrame
    rows: DataFrame
    counts: DataFrame
    other_counts: DataFrame
    joined_rows: DataFrame | None


def run_workload(
    persons: DataFrame, output_path: str | None = None, key: str = "surname", need_to_join: bool = True
) -> Workload:
    """Run the workload on a person-like table and, if asked, write its self-join.

    The key is counted once, in one scan. The number of rows, both counts, the
    number of pairs and the shape of the join all come from that table. The join
    goes straight to the sink, never into a cache.
    """
    base = persons.columns
    derived = derive_persons(persons)
    other = prefix_columns(derived.drop("fio", "document"), {*PERSON_COLUMNS, *base, "address"})
    keys = kept_key_counts(persons, key)
    joined_rows = None
    if need_to_join:
        joined_rows = pairs_of(own_pairs(keys))
        if output_path is not None:
            write_table(self_join(persons, key, right=other, counts=keys), "parquet", output_path)

    def counts(name: str) -> DataFrame:
        return keys.select(F.col("_k").alias(name), F.col("n").alias("count")).orderBy(F.desc("count"), name)

    rows = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"))
    return Workload(derived, rows, counts(key), counts(PREFIX + key), joined_rows)
