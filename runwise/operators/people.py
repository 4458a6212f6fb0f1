"""Columns derived from person rows."""

from pyspark.sql import DataFrame, functions as F

from runwise.schemas import PERSON_COLUMNS

PREFIX = "another_"


def derive_persons(persons: DataFrame) -> DataFrame:
    """Add full name, address and document; nulls leave no doubled separator."""
    return persons.withColumns({
        "fio": F.concat_ws(" ", "surname", "name", "patronymic"),
        "address": F.concat_ws(",", "street", "city"),
        "document": F.concat_ws(" ", "series_passport", "number_passport"),
    })


def prefix_columns(df: DataFrame, columns=(*PERSON_COLUMNS, "address"), prefix: str = PREFIX) -> DataFrame:
    """Rename ``columns`` to ``prefix + name``; names the frame lacks are ignored."""
    return df.withColumnsRenamed({c: prefix + c for c in columns})
