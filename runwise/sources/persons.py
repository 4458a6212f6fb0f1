"""Synthetic person table.

Every value is a function of the row's id alone, so a row is the same whatever
the partitioning, and a lost task rebuilds exactly the rows it had. Draws are
power residues modulo a prime: plain bigint arithmetic inside codegen.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runwise.sources import pools

PRIME = (1 << 31) - 1
# Primitive roots of PRIME; their powers give each stream its own constants.
ROOTS = (16807, 48271, 69621)


def stream_constants(stream: int, seed: int) -> tuple[int, int, int]:
    """Two factors and an offset of one stream of draws."""
    low, high, offset = ROOTS
    return (
        pow(low, 1009 * (stream + 1), PRIME),
        pow(high, 1013 * (stream + 1), PRIME),
        pow(offset, 1019 * (stream + 1) + seed, PRIME),
    )


def draw(key: Column, stream: int, size: int, seed: int = 0) -> Column:
    """A number in ``[0, size)`` for each non-negative bigint key.

    Keys are mapped linearly and raised to the fifth power, which permutes the
    residues because 5 does not divide PRIME - 1. Products stay below 2**63.
    """
    low, high, offset = (F.lit(c).cast("bigint") for c in stream_constants(stream, seed))
    prime = F.lit(PRIME).cast("bigint")
    base = ((key % prime) * low % prime + _div(key, PRIME) % prime * high % prime + offset) % prime
    square = base * base % prime
    return square * square % prime * base % prime % F.lit(size).cast("bigint")


def _div(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by).cast("bigint"))


def generate_persons(
    ids: DataFrame, key: str = "id", phone_prefix: str = pools.PHONE_PREFIX, seed: int = 0
) -> DataFrame:
    """One person, eleven string columns, per row of ``ids``; narrow, no shuffle."""
    k = F.col(key).cast("bigint")

    def pick(stream: int, pool: Sequence[str]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in pool]), (draw(k, stream, len(pool), seed) + 1).cast("int"))

    def digits(stream: int, width: int) -> Column:
        return F.lpad(draw(k, stream, 10**width, seed).cast("string"), width, "0")

    def date(stream: int, years: tuple[int, int]) -> Column:
        n = draw(k, stream, 28 * 12 * (years[1] - years[0] + 1), seed)
        return F.concat_ws(".", (n % 28 + 1).cast("string"), (_div(n, 28) % 12 + 1).cast("string"),
                           (_div(n, 336) + years[0]).cast("string"))

    return ids.select(
        pick(0, pools.SURNAMES).alias("surname"),
        pick(1, pools.NAMES).alias("name"),
        pick(2, pools.PATRONYMICS).alias("patronymic"),
        F.concat(F.lit(phone_prefix), digits(3, 5), digits(4, 5)).alias("phone"),
        pick(5, pools.STREETS).alias("street"),
        pick(6, pools.CITIES).alias("city"),
        digits(7, 4).alias("series_passport"),
        digits(8, 6).alias("number_passport"),
        date(9, pools.BIRTH_YEARS).alias("birthday"),
        date(10, pools.RECORD_YEARS).alias("created_dt"),
        date(11, pools.RECORD_YEARS).alias("updated_dt"),
    )


def person_ids(spark: SparkSession, rows: int) -> DataFrame:
    """Ids 0 .. rows-1, made on the executors."""
    return spark.range(rows)
