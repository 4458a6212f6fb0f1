"""Memory sizes as native column expressions."""

from pyspark.sql import Column, functions as F

MIB = 1 << 20

# Bytes per unit letter of a Spark memory string.
UNIT_BYTES = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40, "p": 1 << 50}


def memory_to_bytes(size: Column) -> Column:
    """``'451m'`` -> 472907776. A bare number is bytes; anything unreadable is null."""
    text = F.lower(F.trim(size))
    pattern = r"^([0-9]+)(?:([kmgtp])(?:i?b)?)?$"
    count = F.regexp_extract(text, pattern, 1).try_cast("bigint")
    unit = F.regexp_extract(text, pattern, 2)
    factor = F.lit(1).cast("bigint")
    for letter, size_of in UNIT_BYTES.items():
        factor = F.when(unit == letter, F.lit(size_of).cast("bigint")).otherwise(factor)
    return F.try_multiply(count, factor)


def to_mib(size: Column) -> Column:
    """Bytes to whole MiB, rounded towards plus infinity."""
    return F.ceil(size / MIB)
