"""Mixing sources to target weights along a time-varying curriculum, in DataFrame expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACED_WORD, fresh

WEIGHTS = (5, 2, 1)
#: Relative weight of a source at the start, the middle and the end of training, by its place in the cycle.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
#: Rows of a source that are put in order together.
ROWS_TOGETHER = 20_000


def text_size(text: str | Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source with ``place`` and ``target`` added to source and source_size.

    Sources in code-point order, null last, get the weights in turn. ``share`` times all sizes is
    dealt by weight; a source stops at ``most`` times its size, and the rest is dealt to the others.
    That is the level at which min(cap, level * weight) sums to the total, found by sorting sources
    by the level at which each is full.
    """
    everything = Window.partitionBy()
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    dealt = (
        sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("place") % len(weights) + 1))
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("total", share * F.sum("source_size").over(everything))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
        .withColumn("k", F.row_number().over(by_level))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("k", "level"))).over(everything)["level"])
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return dealt.select("source", "source_size", "place", target.alias("target"))


def when_demanded(fraction: Column, schedule: tuple[float, ...]) -> Column:
    """The training time (0 to 1) by which a source has given ``fraction`` of its target.

    ``schedule`` has its weight at evenly spaced times, linear in between. The integral is a
    quadratic in each piece, so its inverse is a square root.
    """
    k = len(schedule) - 1
    area = sum(schedule[i] + schedule[i + 1] for i in range(k)) / 2
    out, done = None, 0.0
    for i in range(k):
        a, b = schedule[i] / area, schedule[i + 1] / area
        d = fraction - done
        # a x + (b - a) x^2 / 2 = d, in the form that also holds for b = a
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(a * a) + 2 * (b - a) * d))
        x = F.when(a + root > 0, 2 * d / (a + root)).otherwise(F.lit(0.0))
        t = (F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) + i) / k
        done += (a + b) / 2
        out = F.when(fraction <= done, t) if out is None else out.when(fraction <= done, t)
    return out.otherwise(F.lit(1.0))


def mix_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
             share: float = 1.5, most: float = 2.0, schedules=SCHEDULES, seed: int = 0, keep: bool = False, number: bool = False) -> DataFrame:
    """What the mix takes of each row of ``docs``: doc_id, size, source, source_size, target, taken, takes.

    The documents of a source stand in the order of a hash of seed and id and are read round and
    round, until the target, rounded to whole words, is reached; the document at which that happens
    is taken in part. ``takes`` lists, per round that takes words, its ``words`` and the training
    time ``position`` at which the source's demand reaches them. With ``keep``, the row's own columns
    are kept as the struct ``row``; with ``number`` the row has its ``part`` and its ``number`` in the
    order of source and part, which name it.

    Texts without words have size 0 and are never taken. A null source is a source of its own.
    Rows that share an id follow each other by size; equal rows are interchangeable. Reruns agree.
    """
    rounds = math.ceil(most)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), text_size(text).alias("size"),
                       order.alias("order"), *([F.struct(*docs.columns).alias("row")] if keep else []))
    # Hash prefixes split every source into groups of bounded size; their number does not change the result.
    most_rows = docs.groupBy(source).count().agg(F.max("count")).first()[0] or 0
    digits = max(1, math.ceil(math.log2(max(1, most_rows / ROWS_TOGETHER)) / 4))
    rows = rows.withColumn("part", F.substring("order", 1, digits))
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, share, most)
    prefix = Window.partitionBy("p_source").orderBy("p_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        parts.select(F.col("source").alias("p_source"), F.col("part").alias("p_part"), "part_size")
        .withColumn("before", F.coalesce(F.sum("part_size").over(prefix), F.lit(0)))
        .join(targets, F.col("p_source").eqNullSafe(F.col("source"))).drop("source", "part_size")
    )
    here = Window.partitionBy("source", "part").orderBy("order", "doc_id", "size")
    within = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(parts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part")))
    rows = rows.withColumn("offset", F.col("before") + F.sum("size").over(within) - F.col("size"))
    if number:
        rows = rows.withColumn("number", F.row_number().over(here))
    goal = F.round("target").cast("bigint")

    def take(k):
        at = F.col("offset") + k * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), goal - at)).cast("bigint")
        fraction = F.try_divide(at + words / 2, F.col("target"))  # a source without words has target 0
        position = None
        for i, s in enumerate(schedules):
            hit = F.col("place") % len(schedules) == i
            position = F.when(hit, when_demanded(fraction, s)) if position is None else position.when(hit, when_demanded(fraction, s))
        return F.struct(words.alias("words"), position.alias("position"))

    takes = F.filter(F.array(*[take(k) for k in range(rounds)]), lambda x: x["words"] > 0)
    return rows.select("doc_id", "size", "source", "source_size", "target", takes.alias("takes"),
                       *(["row"] if keep else []), *(["part", "number"] if number else [])).withColumn(
        "taken", F.aggregate("takes", F.lit(0).cast("bigint"), lambda a, x: a + x["words"]))


def training_order(docs: DataFrame, **how) -> DataFrame:
    """The mix without its texts, range-sorted by training position: one row per document and round that takes words of it.

    ``part`` and ``number`` name the row of ``docs`` in its source. ``position`` is the training time at which the
    schedule of the source's weight reaches the copy, ``words`` what it takes. A document that is not taken stands
    once, first, without a position and with no words. Rows at one position stand by source, part and number, so
    that those without one spread over tasks too.
    """
    plan = mix_plan(docs, number=True, **how).select("doc_id", "size", "source", "source_size", "target", "part", "number", F.explode_outer("takes").alias("take"))
    return plan.select("doc_id", "size", "source", "source_size", "target", "part", "number", F.coalesce("take.words", F.lit(0)).alias("words"),
                       F.col("take.position").alias("position")).sort(F.col("position").asc_nulls_first(), "source", "part", "number")


def mix(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", position: str | None = None, **how) -> DataFrame:
    """The mixed documents, range-sorted by training position, with the columns of ``docs``.

    A document that is taken twice stands at both of its positions. The one copy per source that
    crosses the target ends after the words taken. ``position`` names a column for the positions.
    """
    plan = mix_plan(docs, text=text, keep=True, **how)
    copies = plan.select("row", "size", F.explode("takes").alias("take"))
    words = F.slice(F.regexp_extract_all(F.col(f"row.{text}"), F.lit(rf"[\x20\x09-\x0D]*{SPACED_WORD}"), F.lit(0)), 1, F.col("take.words").cast("int"))
    whole = F.col("take.words") == F.col("size")
    new = F.when(whole, F.col(f"row.{text}")).otherwise(F.array_join(words, ""))
    at = position or fresh(docs, "position")
    out = copies.select("row.*", F.col("take.position").alias(at), new.alias(fresh(docs, "new_text")), whole.alias(fresh(docs, "whole")))
    t, w = fresh(docs, "new_text"), fresh(docs, "whole")
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(F.col(w), F.col(n_chars)).otherwise(F.length(t)).cast(docs.schema[n_chars].dataType))
    out = out.withColumn(text, F.col(t)).sort(at)
    return out.select(*docs.columns, *([at] if position else []))
