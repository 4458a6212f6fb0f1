"""URL filters: host and path rules, and a tree of path templates per host. DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from runwise.session import scratch_path

from .common import LOWER, UPPER

#: (verdict, rule); a rule is a host, which stands for its subdomains too, and the start of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A place with more literal segments than this, and fewer pages than PER_SEGMENT to each, is variable.
SEGMENTS, PER_SEGMENT = 20, 5
#: Weight of the parent's purity when branches are compared, and tenths in which purities are compared.
POOLED, STEPS = 4, 10
#: Allowed and blocked pages that each template is taken to have besides its own, and the least share of allowed ones.
PRIOR, LEAST_PURITY = (1, 1), (1, 5)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does. Of equally long rules the first wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: len(x[1])):  # later ones go before earlier ones
        h, slash, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The segments of a path with numbers and long hexadecimal names as ``<num>`` and ``<id>``; an ending stays."""
    def typed(s):
        return F.regexp_replace(F.regexp_replace(s, r"^[0-9]+(\.[A-Za-z0-9]+)?$", "<num>$1"), r"^[0-9a-fA-F-]{16,}(\.[A-Za-z0-9]+)?$", "<id>$1")

    every = F.split(path, "/")
    return F.transform(F.slice(every, 2, F.size(every) - 1), typed)


def template_tree(urls: DataFrame) -> DataFrame:
    """host, typed (path), template, n, good, bad, blocked, for ``urls`` of host, path and a label (allow, block or null).

    Every place of the tree, a host and the segments so far, is variable if it has many literal
    segments and few pages to each, and a wildcard then. Branches of a host that differ only in
    their first literal segment have one parent, the pattern with a wildcard there. A branch's purity is the share of
    allowed pages among its labelled ones, smoothed by the parent's; without labels it is the parent's.
    Branches whose purities fall into the same tenth are merged. A template is
    blocked if its labelled pages, or its parent's where it has none, have a purity below LEAST_PURITY, smoothed
    by PRIOR; where the parent has no labels either, it is not.
    """
    leaves = urls.select("host", F.array_join(segments(F.col("path")), "/").alias("typed"), "label").groupBy("host", "typed").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("label") == "allow", 1)).alias("good"), F.count(F.when(F.col("label") == "block", 1)).alias("bad"))
    leaves = _kept(leaves, "leaves")
    steps = leaves.select("host", "typed", "n", F.split("typed", "/").alias("s")).select("*", F.posexplode("s").alias("d", "segment")).select(
        "host", "typed", "n", "d", "segment", F.xxhash64(F.slice("s", 1, F.col("d"))).alias("before"))
    literal = ~F.col("segment").rlike(r"^(<|\*|$)")
    variable = (
        steps.filter(literal).groupBy("host", "before", "d", "segment").agg(F.sum("n").alias("n"))
        .groupBy("host", "before", "d").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
        .filter(f"kinds > {SEGMENTS} and n < {PER_SEGMENT} * kinds")
        .select(F.col("host").alias("v_host"), F.col("before").alias("v_before"), F.col("d").alias("v_d"))
    )
    shown = F.when(literal & F.col("v_host").isNotNull(), "*").otherwise(F.col("segment"))
    templates = (
        steps.join(variable, (F.col("host") == F.col("v_host")) & (F.col("before") == F.col("v_before")) & (F.col("d") == F.col("v_d")), "left")
        .groupBy("host", "typed").agg(F.sort_array(F.collect_list(F.struct("d", shown.alias("x")))).alias("parts"))
        .select(F.col("host").alias("t_host"), F.col("typed").alias("t_typed"), F.transform("parts", lambda p: p["x"]).alias("parts"))
    )
    first = F.coalesce(F.get(F.filter(F.col("parts"), lambda x: ~x.rlike(r"^(<|\*|$)")), F.lit(0)), F.lit(""))
    at = F.array_position("parts", first)
    open_ = F.when(first == "", F.col("parts")).otherwise(F.transform("parts", lambda x, i: F.when(i + 1 == at, "*").otherwise(x)))
    named = leaves.join(templates, (F.col("host") == F.col("t_host")) & (F.col("typed") == F.col("t_typed"))).select(
        "host", "typed", "n", "good", "bad", F.array_join("parts", "/").alias("own"), F.array_join(open_, "/").alias("pattern"))
    named = _kept(named, "templates")

    branches = named.groupBy("host", "pattern", "own").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    parents = branches.groupBy("host", "pattern").agg(F.sum("good").alias("all_good"), F.sum(F.expr("good + bad")).alias("labelled")).withColumnsRenamed(
        {"host": "p_host", "pattern": "p_pattern"})
    tenth = F.expr(f"({STEPS} * (good * labelled + {POOLED} * all_good)) div (labelled * (good + bad + {POOLED}))")
    binned = branches.join(parents, (F.col("host") == F.col("p_host")) & (F.col("pattern") == F.col("p_pattern"))).select(
        "host", "pattern", "own", "good", "bad", "all_good", "labelled", F.when(F.col("labelled") > 0, tenth).otherwise(-1).alias("tenth"))
    groups = binned.groupBy("host", "pattern", "tenth").agg(
        F.count("*").alias("branches"), F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("all_good").alias("all_good"), F.max("labelled").alias("labelled"))
    impure = lambda good, of: LEAST_PURITY[1] * (good + PRIOR[0]) < LEAST_PURITY[0] * (of + sum(PRIOR))
    own = F.col("good") + F.col("bad")
    judged = groups.select(
        F.col("host").alias("j_host"), F.col("pattern").alias("j_pattern"), F.col("tenth").alias("j_tenth"), "branches",
        F.when(own > 0, impure(F.col("good"), own)).otherwise(impure(F.col("all_good"), F.col("labelled"))).alias("blocked"))
    verdicts = binned.join(judged, (F.col("host") == F.col("j_host")) & (F.col("pattern") == F.col("j_pattern")) & (F.col("tenth") == F.col("j_tenth"))).select(
        F.col("host").alias("b_host"), F.col("pattern").alias("b_pattern"), F.col("own").alias("b_own"),
        F.when(F.col("branches") > 1, F.col("pattern")).otherwise(F.col("own")).alias("template"), "blocked")
    return named.join(verdicts, (F.col("host") == F.col("b_host")) & (F.col("pattern") == F.col("b_pattern")) & (F.col("own") == F.col("b_own"))).select(
        "host", "typed", "template", "n", "good", "bad", "blocked")


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def judge_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict, template.

    The verdict is the longest fitting rule's, else the template's; pages that rules judge are the
    labels that templates learn from. A url that is null or has no ``://`` has an empty host and path,
    fits no rule, and shares the template of such urls. Repeated rows are judged alike and kept, and count as often in
    the shares. Of rules of equal length the first wins. Paths are told apart in all their segments, however many. An
    empty table gives an empty result. Other columns play no part.
    """
    host, path = host_and_path(F.col(url))
    parts = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, label = longest_rule(F.col("host"), F.col("path"), rules)
    parts = parts.select("*", rule.alias("rule"), label.alias("label"))
    tree = _kept(template_tree(parts).select(F.col("host").alias("t_host"), F.col("typed").alias("t_typed"), "template", "blocked"), "verdicts")
    typed = parts.withColumn("typed", F.array_join(segments(F.col("path")), "/"))
    return typed.join(tree, (F.col("host") == F.col("t_host")) & (F.col("typed") == F.col("t_typed")), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("label", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"), "template")
