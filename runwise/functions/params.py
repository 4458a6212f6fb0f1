"""``key=value;key=value`` strings and key/value records as maps."""

from pyspark.sql import Column, functions as F

# Keys whose values must never reach a log or a report.
SECRET_KEYS = r"(?i)secret|password|passwd|token|access[._-]?key|credential"


def fold_entries(entries: Column) -> Column:
    """Array of ``struct<key, value>`` to a map in which the last entry of a key wins."""
    empty = F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<string>")
    )

    def put(acc, e):
        others = F.map_filter(acc, lambda k, _: k != e["key"])
        return F.map_concat(others, F.create_map(e["key"], e["value"]))

    return F.aggregate(entries, empty, put)


def parse_params(text: Column) -> Column:
    """``'a=1;b=2'`` -> ``{a: 1, b: 2}``.

    The value is everything after the first ``=``, items without ``=`` or
    without a key are skipped, and a repeated key keeps its last value.
    """
    pairs = F.transform(F.split(text, ";"), lambda item: F.split(item, "=", 2))
    good = F.filter(pairs, lambda p: (F.size(p) == 2) & (p[0] != ""))
    return fold_entries(
        F.transform(good, lambda p: F.struct(p[0].alias("key"), p[1].alias("value")))
    )


def keep_public(conf: Column) -> Column:
    """Drop the entries of a map whose key names a secret."""
    return F.map_filter(conf, lambda k, _: ~k.rlike(SECRET_KEYS))
