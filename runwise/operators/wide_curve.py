"""Isotonic fit and lookup, for curves of any size.

Both cut the feature axis into ranges small enough for one task each. No step
brings a whole curve, or all rows of one feature, into a task or to the driver,
and the number of steps does not depend on the labels.
"""

from bisect import bisect

from pyspark.sql import DataFrame, Window, functions as F

from runwise.session import written

BLOCK = "start double, end double, prediction double"
STACK = ("part int, range bigint, start double, end double, w double, s double, slope double, before_end double, before_w double, "
         "before_s double, before double, last boolean, n bigint, size double")

# Relative size below which a gap between labels, or between sums of them, counts as rounding error:
# stretches whose means differ by less may come out as one.
ROUNDING = 1e-12

# Points of a range and blocks of a band, about, that are handled together.
LOCAL_POINTS = 200_000

# Points up to which a task takes several ranges, one after the other.
TASK_POINTS = 20_000

# Lines that each place between two known cuts is searched with at a time.
LINES = 64


def _written(df: DataFrame) -> DataFrame:
    return written(df, "curve")


def _pool(tiny: float):
    """Pool-adjacent-violators over rows sorted by start; nested to travel by value.

    Blocks whose means do not rise by more than ``tiny`` are pooled.
    """
    def pool(starts, ends, weights, sums):
        blocks = []
        for start, end, w, s in zip(starts, ends, weights, sums):
            while blocks and blocks[-1][3] / blocks[-1][2] >= s / w - tiny:
                start, _, v, t = blocks.pop()
                w, s = w + v, s + t
            blocks.append((start, end, w, s))
        return blocks

    return pool


def _stacks(center: float, tiny: float, size: int):
    """The points of each partition, sorted and in ranges of ``size``, to the ranges' stacks of blocks.

    The sums before a block are those of the partition, so that only partitions are added up later.
    """
    pool = _pool(tiny)
    names = [c.split()[0] for c in STACK.split(", ")]

    def stack(batches):
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        part, done, all_w, all_s = TaskContext.get().partitionId(), 0, 0.0, 0.0

        def fitted(points):
            nonlocal done, all_w, all_s
            w = points["weight"].to_numpy()
            s = w * (points["mem"].to_numpy() - center)
            blocks = pool(points["rows"].tolist(), points["rows"].tolist(), w.tolist(), s.tolist())
            start, end, bw, bs = (np.array(x) for x in zip(*blocks))
            n, slope, none = len(blocks), bs / bw, np.full(1, -np.inf)
            sums_w, sums_s = all_w + np.cumsum(bw), all_s + np.cumsum(bs)
            last = np.arange(n) == n - 1
            columns = (np.full(n, part), np.full(n, (part << 32) + done), start, end, bw, bs, slope, np.concatenate([none, end[:-1]]),
                       np.concatenate([[all_w], sums_w[:-1]]), np.concatenate([[all_s], sums_s[:-1]]),
                       np.concatenate([none, slope[:-1]]), last, np.where(last, n, 0), np.where(last, np.abs(s).sum(), 0.0))
            done, all_w, all_s = done + 1, sums_w[-1], sums_s[-1]
            return columns

        def frame(ranges):
            return pd.DataFrame({c: np.concatenate(x) for c, x in zip(names, zip(*ranges))})

        rest, waiting = [], 0
        for b in batches:
            rest.append(b)
            waiting += len(b)
            if waiting >= size:
                points = pd.concat(rest)
                whole = len(points) // size * size
                yield frame(fitted(points[i : i + size]) for i in range(0, whole, size))
                rest, waiting = [points[whole:]], len(points) - whole
        if waiting:
            yield frame([fitted(pd.concat(rest))])

    return stack


def _corners(slopes: list[float], lows: list[float], highs: list[float], first: int):
    """Blocks to the corners ``(line, part, x, w, s)`` at which a line of slope ``line`` supports the range's own curve.

    Only corners between the line's place in ``lows`` and that in ``highs`` count, which both only rise.
    """
    def corners(batches):
        import numpy as np
        import pandas as pd

        lines, left, right = np.array(slopes), np.array(lows), np.array(highs)

        def rows(b, low, high, x, w, s):
            places = x.to_numpy()
            low = np.maximum(low, np.searchsorted(right, places, "left"))
            n = np.maximum(0, np.minimum(high, np.searchsorted(left, places, "right")) - low)
            at = np.repeat(np.arange(len(n)), n)
            t = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            return pd.DataFrame({"line": lines[t], "part": b["part"].to_numpy()[at], "x": places[at], "w": w.to_numpy()[at], "s": s.to_numpy()[at]})

        for b in batches:
            low, high = (np.searchsorted(lines, b[c].to_numpy(), "right") for c in ("before", "slope"))
            # the corner before a range is the last of the range before it
            own = np.isfinite(b["before_end"].to_numpy()) | (b["range"].to_numpy() == first)
            yield rows(b, np.where(own, low, high), high, b["before_end"], b["before_w"], b["before_s"])
            end = b[b["last"]]
            if len(end):
                steepest = np.searchsorted(lines, end["slope"].to_numpy(), "right")
                yield rows(end, steepest, np.full(len(end), len(lines)), end["end"], end["before_w"] + end["w"], end["before_s"] + end["s"])

    return corners


def _cuts(stacks: DataFrame, slopes: list[float], first: int, size: float) -> list[float]:
    """For each slope the place of the axis left of which the fit's blocks lie below it, and right of which they do not.

    That is where the running sum of ``weight * (mem - slope)`` is least. A range's own least place is
    a corner of its own fit, so only those meet: one row per range and slope. Few slopes, far apart, are
    placed first. A slope between two of them has its place between theirs, so the next ones, ``LINES`` times
    as many, meet only the ranges there, and rows grow with ranges and slopes, not with their product.
    """
    totals = stacks.groupBy("part").agg(F.sum("w").alias("all_w"), F.sum("s").alias("all_s"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = _written(totals.select("part", *[F.coalesce(F.sum(f"all_{c}").over(ahead), F.lit(0.0)).alias(f"off_{c}") for c in "ws"]))
    step, cuts = 1, {-1: float("-inf"), len(slopes): float("inf")}
    while step * LINES < len(slopes):
        step *= LINES
    while step:
        asked = [t for t in range(step - 1, len(slopes), step) if t not in cuts]
        known = sorted(cuts)
        lows = [cuts[known[bisect(known, t) - 1]] for t in asked]
        highs = [cuts[known[bisect(known, t)]] for t in asked]
        corners = stacks.mapInPandas(_corners([slopes[t] for t in asked], lows, highs, first), "line double, part int, x double, w double, s double")
        values = _written(corners.join(offsets, "part").select("line", "x", F.expr("s + off_s - line * (w + off_w)").alias("gap")))
        least = values.groupBy("line").agg(F.min("gap").alias("least"))
        # of places that differ by rounding alone the leftmost, so that no stretch is cut in two
        near = values.join(least, "line").filter(F.col("gap") <= F.col("least") + ROUNDING * size)
        found = dict(tuple(r) for r in near.groupBy("line").agg(F.min("x")).collect())
        so_far = float("-inf")
        for t, low, high in zip(asked, lows, highs):
            # without a row, the places on both sides are one but for rounding
            so_far = cuts[t] = min(high, max(so_far, low, found.get(slopes[t], low)))
        step //= LINES
    return [cuts[t] for t in range(len(slopes))]


def _segments(slopes: list[float], cuts: list[float]):
    """Blocks to rows ``(range, segment, part, start, end, w, s)``, where blocks of equal part can be pooled.

    Between two cuts the fit lies between their slopes, so no corner between two blocks of a range that both
    lie below, or both not below, that band is a corner of the fit.
    """
    def place(batches):
        import numpy as np

        edges, lines = np.array(cuts), np.array([-np.inf, *slopes, np.inf])
        for b in batches:
            start, slope = b["start"].to_numpy(), b["slope"].to_numpy()
            segment = np.searchsorted(edges, start, "left")
            part = np.where(slope < lines[segment], -np.inf, np.where(slope >= lines[segment + 1], np.inf, start))
            yield b[["range", "start", "end", "w", "s"]].assign(segment=segment.astype("int32"), part=part)

    return place


def label_moments():
    """Aggregates of ``(mem, weight)`` that ``isotonic_blocks`` starts from."""
    return F.sum(F.expr("weight * mem")) / F.sum("weight"), F.sum(F.expr("weight * abs(mem)")) / F.sum("weight")


def isotonic_blocks(
    points: DataFrame, number: int, local_points: int = LOCAL_POINTS, ranges: int | None = None,
    moments: tuple[float, float] | None = None,
) -> DataFrame:
    """Constant stretches ``(start, end, prediction)`` of the isotonic fit.

    ``points`` are ``number`` rows ``(rows, mem, weight)`` with distinct rows. The fit is the slope of the greatest
    convex curve below the running sums of the labels. Every range of ``local_points`` points is fitted by itself; its
    stack of blocks holds all corners that the whole fit can have there. The slopes of all blocks
    are cut into bands of about as many blocks, and each line between two bands finds the place where it
    supports the whole curve. Between two such places the fit has only slopes of their band, so all other
    blocks of a range are pooled there, and what is left, a band of blocks and two for each range, is one
    task's share. The steps are the same for all labels, and the result does not depend on the cuts.

    ``moments`` are the weighted means of the labels and of their sizes, see ``label_moments``, if known.
    """
    if not number:
        return points.sparkSession.createDataFrame([], BLOCK)
    center, scale = moments or points.agg(*label_moments()).first()
    tiny, size = ROUNDING * scale, max(1, local_points)
    parts = ranges or -(-number // max(size, TASK_POINTS))
    ranged = points.select("rows", "mem", "weight").repartitionByRange(parts, "rows").sortWithinPartitions("rows")
    stacks = _written(ranged.mapInPandas(_stacks(center, tiny, size), STACK))
    prediction = (F.lit(center) + F.col("s") / F.col("w")).alias("prediction")
    if parts == 1 and number <= size:
        return stacks.select("start", "end", prediction)
    first, blocks, spread = stacks.filter("last").agg(F.min("range"), F.sum("n"), F.sum("size")).first()
    bands = -(-blocks // size)
    slopes = sorted(set(stacks.approxQuantile("slope", [i / bands for i in range(1, bands)], 0.1 / bands))) if bands > 1 else []
    cuts = _cuts(stacks, slopes, first, spread) if slopes else []
    placed = stacks.mapInPandas(_segments(slopes, cuts), "range bigint, start double, end double, w double, s double, segment int, part double")
    pooled = placed.groupBy("segment", "range", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("w").alias("w"), F.sum("s").alias("s"))
    pool = _pool(tiny)

    def fit(pdf):
        import pandas as pd

        pdf = pdf.sort_values("start")
        return pd.DataFrame(pool(*(pdf[c].tolist() for c in ("start", "end", "w", "s"))), columns=["start", "end", "w", "s"])

    found = pooled.groupBy("segment").applyInPandas(fit, "start double, end double, w double, s double")
    return _written(found.select("start", "end", prediction))


def interpolate(curve: DataFrame, rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """Add ``prediction``: linear between boundaries of the curve, flat beyond.

    Distinct features are looked up, so a feature that many rows share is one row
    here. Boundaries and asked features are range-sorted together, so that
    many features between two boundaries fill many ranges. Within a range the
    neighbours come from a window; boundaries in other ranges are carried over in a
    second pass, as one summary row per range.
    """
    empty = F.lit(None).cast("struct<rows:double,prediction:double>")
    point = F.struct(F.col("boundary").cast("double").alias("rows"), F.col("prediction").cast("double").alias("prediction"))
    known = curve.select(point["rows"].alias("rows"), point.alias("point"), F.lit(False).alias("asked"))
    asked = rows.select(F.col("rows").cast("double").alias("rows")).distinct().filter("rows is not null").select(
        "rows", empty.alias("point"), F.lit(True).alias("asked"))
    mixed = _in_ranges(known.unionByName(asked), ranges)
    summary = mixed.groupBy("range").agg(F.min("point").alias("low"), F.max("point").alias("high"))
    # Frames only ever grow from the start of an order, which takes linear time.
    ahead = (Window.unboundedPreceding, -1)
    carried = summary.select(
        "range",
        F.last("high", True).over(Window.orderBy("range").rowsBetween(*ahead)).alias("left_in"),
        F.last("low", True).over(Window.orderBy(F.desc("range")).rowsBetween(*ahead)).alias("right_in"),
    )
    # In both orders boundaries come before an equal feature, so that it sees them.
    here = Window.partitionBy("range")
    upto = (Window.unboundedPreceding, 0)
    near = mixed.select(
        "range", "rows", "asked",
        F.last("point", True).over(here.orderBy("rows", "asked").rowsBetween(*upto)).alias("l"),
        F.last("point", True).over(here.orderBy(F.desc("rows"), "asked").rowsBetween(*upto)).alias("r"),
    ).filter("asked")
    l, r = F.coalesce("l", "left_in"), F.coalesce("r", "right_in")
    found = near.join(carried, "range").select("rows", l.alias("l"), r.alias("r"))
    slope = F.try_divide(F.expr("r.prediction - l.prediction"), F.expr("r.rows - l.rows"))
    inside = F.col("l.prediction") + F.coalesce(slope * (F.col("rows") - F.col("l.rows")), F.lit(0.0))
    value = F.when(F.col("l").isNull(), F.col("r.prediction")).when(F.col("r").isNull(), F.col("l.prediction"))
    # Written, so that both sides of the join are plain shuffles, which Spark splits where a size is common.
    found = _written(found.select(F.col("rows").alias("_rows"), value.otherwise(inside).alias("prediction")))
    return rows.join(found, F.col("rows").cast("double") == F.col("_rows"), "left").select(*rows.columns, "prediction")


def _in_ranges(mixed: DataFrame, ranges: int | None = None) -> DataFrame:
    """``mixed`` with the number of the ``range`` each row fell into, in the order of ``rows``, as a table."""
    by = ("rows", "asked")
    placed = mixed.repartitionByRange(ranges, *by) if ranges else mixed.repartitionByRange(*by)
    return _written(placed.withColumn("range", F.spark_partition_id()))
