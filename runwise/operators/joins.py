"""Many-to-many joins: all pairs of rows that share a key, and their number."""

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

from runwise.operators.people import PREFIX, prefix_columns
from runwise.session import written

# Rows one task should take in and make, and the tasks beyond which rows made no longer decide.
ROWS_PER_TASK = 250_000
MAX_TASKS = 20_000

# Rows of a block of a factored join, and blocks of either side that meet in a task.
BLOCK_ROWS = 4096
BLOCKS_PER_CELL = 8

_WIDE = "decimal(19,0)"


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def key_counts(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str) -> DataFrame:
    """``(_k, n, m)``: rows of each non-null key on both sides."""
    def counts(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.filter(_col(key).isNotNull()).groupBy(_col(key).alias("_k")).agg(F.count("*").cast(_WIDE).alias(name))

    joined = counts(left, left_key, "n").join(counts(right, right_key, "m"), "_k", how)
    return joined.fillna(0, ["n", "m"])


def kept_key_counts(df: DataFrame, key: str) -> DataFrame:
    """``(_k, n)`` of every key, null included, from one scan and kept as a table."""
    return written(df.groupBy(_col(key).alias("_k")).agg(F.count("*").alias("n")), "keys")


def own_pairs(counts: DataFrame) -> DataFrame:
    """``kept_key_counts`` as the ``(_k, n, m)`` of a join of the table with itself."""
    n = F.col("n").cast(_WIDE)
    return counts.filter("_k is not null").select("_k", n.alias("n"), n.alias("m"))


def pairs_of(counts: DataFrame) -> DataFrame:
    """One row: the pairs that ``(_k, n, m)`` make, a decimal because they outgrow a bigint."""
    return counts.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).cast("decimal(38,0)").alias("pairs"))


def join_size(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """One row: how many rows the inner equi-join has, without making them.

    Both sides shrink to one row per key before they meet, so the work is linear
    in the input where the join itself is quadratic per key.
    """
    return pairs_of(key_counts(left, right, left_key, right_key, "inner"))


def grids(counts: DataFrame, share: float) -> DataFrame:
    """``(_k, _across, _down)`` for the keys that load a join with over ``share`` rows.

    The load of a key is the rows it brings plus the pairs it makes. The grid has
    as many cells as the load has shares, in the proportion of the two sides.
    """
    cells = F.col("load") / F.lit(share)
    down = F.ceil(F.least(cells, F.sqrt(cells * F.greatest("n", F.lit(1.0)) / F.greatest("m", F.lit(1.0)))))
    return (
        counts.filter(F.col("load") > share)
        .select("_k", cells.alias("cells"), F.greatest(down, F.lit(1)).cast("int").alias("_down"))
        .select("_k", "_down", F.ceil(F.col("cells") / F.col("_down")).cast("int").alias("_across"))
    )


def pair_join(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str,
    rows_per_task: int = ROWS_PER_TASK, max_tasks: int | None = None, counts: DataFrame | None = None,
) -> DataFrame:
    """Inner equi-join sized by the rows it makes, with no key left to a single task.

    The key columns are counted first, unless ``counts`` has their ``(_k, n, m)``.
    The join is cut into tasks by the rows it takes and makes, which can be far
    beyond what the inputs suggest. One that would need more than ``MAX_TASKS`` is
    made from blocks of rows instead, by ``factor_join``, whose tasks are sized by what
    they hold; with ``max_tasks`` given it is refused, and needs a larger
    ``rows_per_task``. A key that exceeds a task's share is spread over a grid: each left row takes a random row of the
    grid and is copied to all its columns, each right row the reverse, so every
    pair meets in exactly one cell. Each such key holds over 1/tasks of the load,
    so there are fewer of them than tasks, and their list is small enough to
    collect and broadcast.

    The random places are written to the shared folder before the join, so that
    a task that is run again finds the same ones.
    """
    if counts is None:
        counts = written(key_counts(left, right, left_key, right_key, "full_outer"), "keys")
    loads = counts.select("_k", F.col("n").cast("double"), F.col("m").cast("double")).withColumn("load", F.expr("n * m + n + m"))
    total, most = loads.agg(F.coalesce(F.sum("load"), F.lit(0.0)), F.coalesce(F.max("load"), F.lit(0.0))).first()
    tasks = max(1, math.ceil(total / rows_per_task))
    if max_tasks is None and tasks > MAX_TASKS:
        return expand_pairs(factor_join(left, right, left_key, right_key, counts))
    if max_tasks is not None and tasks > max_tasks:
        raise ValueError(f"the join makes {total:.3g} rows, {tasks} tasks of {rows_per_task}; raise rows_per_task or max_tasks")
    left, right = left.filter(_col(left_key).isNotNull()), right.filter(_col(right_key).isNotNull())
    hot = grids(loads, total / tasks).collect() if most > total / tasks else []
    sizes = left.sparkSession.createDataFrame(hot, T.StructType([
        T.StructField("_k", left.select(_col(left_key)).schema[0].dataType),
        T.StructField("_down", T.IntegerType()), T.StructField("_across", T.IntegerType()),
    ]))
    l = _on_grid(left, left_key, sizes, bool(hot), own=("_row", "_down"), copied=("_column", "_across"), seed=1)
    r = _on_grid(right, right_key, sizes, bool(hot), own=("_column2", "_across"), copied=("_row2", "_down"), seed=2)
    l = l.repartition(tasks, _col(left_key), "_row", "_column")
    r = r.repartition(tasks, _col(right_key), "_row2", "_column2")
    same_cell = (F.col("_row") == F.col("_row2")) & (F.col("_column") == F.col("_column2"))
    return l.join(r, (_col(left_key) == _col(right_key)) & same_cell).drop("_row", "_column", "_row2", "_column2")


def _on_grid(
    df: DataFrame, key: str, sizes: DataFrame, spread: bool, own: tuple[str, str], copied: tuple[str, str], seed: int
) -> DataFrame:
    """Give each row one random coordinate and a copy for each value of the other.

    Coordinates are ``(name, size column)``; keys without a grid have size one.
    """
    placed = df.join(F.broadcast(sizes), _col(key) == F.col("_k"), "left").select(
        *[_col(c) for c in df.columns],
        F.floor(F.rand(seed) * F.coalesce(own[1], F.lit(1))).cast("int").alias(own[0]),
        F.coalesce(copied[1], F.lit(1)).alias("_copies"),
    )
    if spread:
        placed = written(placed, "placed")
    return placed.withColumn(copied[0], F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")


def factor_join(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, counts: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS, blocks_per_cell: int = BLOCKS_PER_CELL,
) -> DataFrame:
    """The inner equi-join in factored form: rows ``(left_rows, right_rows)`` of which every pair is a row of the join.

    The rows of a key fall into blocks of about ``block_rows``. Both sides are kept as tables of such blocks, so what
    is stored is linear in the inputs however many rows the join has. A cell, the share of a task, holds
    ``blocks_per_cell`` blocks of either side at most: its memory is bounded, whatever it makes, and a
    key of many blocks fills as many cells as it needs. ``counts`` are the ``(_k, n, m)`` of the keys, if known.
    """
    if counts is None:
        counts = written(key_counts(left, right, left_key, right_key, "inner"), "keys")
    sizes = counts.filter("n > 0 and m > 0").select(
        "_k", *[F.ceil(F.col(c) / block_rows).cast("bigint").alias(b) for c, b in (("n", "_lb"), ("m", "_rb"))]
    ).withColumns({"_down": F.ceil(F.col("_lb") / blocks_per_cell), "_across": F.ceil(F.col("_rb") / blocks_per_cell)})
    sizes = written(sizes, "sizes")
    cells = sizes.agg(F.coalesce(F.sum(F.col("_down") * F.col("_across")), F.lit(1))).first()[0]
    tasks = int(min(MAX_TASKS, max(1, cells)))
    l = _in_blocks(left, left_key, sizes, "_lb", "_across", blocks_per_cell, seed=1)
    r = _in_blocks(right, right_key, sizes, "_rb", "_down", blocks_per_cell, seed=2)
    l = l.select(F.col("_key").alias("_l"), F.col("_own").alias("_row"), F.col("_other").alias("_column"), F.col("_rows").alias("left_rows"))
    r = r.select(F.col("_key").alias("_r"), F.col("_own").alias("_column2"), F.col("_other").alias("_row2"), F.col("_rows").alias("right_rows"))
    same_cell = (F.col("_l") == F.col("_r")) & (F.col("_row") == F.col("_row2")) & (F.col("_column") == F.col("_column2"))
    met = l.repartition(tasks, "_l", "_row", "_column").join(r.repartition(tasks, "_r", "_row2", "_column2").hint("merge"), same_cell)
    return met.select("left_rows", "right_rows")


def _in_blocks(df: DataFrame, key: str, sizes: DataFrame, blocks: str, copies: str, per_cell: int, seed: int) -> DataFrame:
    """``(_key, _own, _other, _rows)``: blocks of rows, the cell they are in along their own side, and a copy for each cell of the other.

    Rows without a partner go. A row's block is drawn and written before rows are gathered, so that a task that runs
    again finds the same ones.
    """
    placed = df.join(sizes, _col(key) == F.col("_k")).select(
        F.col("_k").alias("_key"), F.floor(F.rand(seed) * F.col(blocks)).cast("bigint").alias("_block"), F.col(copies).alias("_copies"),
        F.struct(*[_col(c) for c in df.columns]).alias("_record"))
    placed = written(placed, "placed")
    gathered = placed.groupBy("_key", "_block").agg(F.first("_copies").alias("_copies"), F.collect_list("_record").alias("_rows"))
    kept = written(gathered, "blocks")
    return kept.select("_key", F.expr(f"_block div {per_cell}").alias("_own"), "_copies", "_rows").select(
        "_key", "_own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies").cast("bigint") - 1)).alias("_other"), "_rows")


def expand_pairs(factored: DataFrame) -> DataFrame:
    """The rows of a ``factor_join``, made one by one as they are read; two nested loops in generated code."""
    return factored.select(F.explode("left_rows").alias("_left"), "right_rows").select(
        "_left", F.explode("right_rows").alias("_right")).select("_left.*", "_right.*")


def self_join(
    df: DataFrame, key: str, right: DataFrame | None = None, counts: DataFrame | None = None, **sizing
) -> DataFrame:
    """Pair every row with every row of the same ``key``; null keys never match.

    The second copy's columns carry the ``another_`` prefix. ``right`` may give a
    second copy with further columns, already prefixed. Both have the same keys,
    so one count, ``kept_key_counts``, serves both sides.
    """
    other = prefix_columns(df, df.columns) if right is None else right
    counts = own_pairs(kept_key_counts(df, key) if counts is None else counts)
    return pair_join(df, other, key, PREFIX + key, counts=counts, **sizing)
