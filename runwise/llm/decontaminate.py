"""Benchmark decontamination by word windows, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, UPPER, fresh

N = 13
#: The words before A-Z are lower-cased.
WORD, GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
#: Windows of the benchmark that are sent to every executor at most; about 200 bytes each.
BROADCAST_WINDOWS = 500_000


def _covered(spans: Column) -> Column:
    """Words in the union of sorted (start, length) spans."""
    step = lambda a, s: F.struct(
        F.greatest(a["end"], s["start"] + s["length"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["end"], s["start"]))).alias("n"))
    return F.aggregate(spans, F.struct(F.lit(1).alias("end"), F.lit(0).alias("n")), step)["n"]


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _low_words(text: Column) -> Column:
    # lower() also folds letters beyond ASCII, and is much faster than translate(); it moves no
    # border of a word, and each hit is verified. Only a capital sigma becomes one letter or another by
    # what stands around it, so both are made one: equal folded words are equal here
    return _words(F.replace(F.lower(text), F.lit("\u03c2"), F.lit("\u03c3")))


def _folded(words: Column, start: Column, length: Column) -> Column:
    """A window with A-Z lower-cased, and nothing else."""
    return F.translate(F.array_join(F.slice(words, start, length), " "), UPPER, LOWER)


def _key(words: Column, start: Column, length: Column) -> Column:
    return F.xxhash64(F.slice(words, start, length))


def benchmark_windows(benchmark: DataFrame, n: int = N, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The distinct windows of all items: probe, key, gram, length, item_ids.

    An item of fewer than ``n`` words, but not none, is one window. Items without a word have no
    window. Equal windows are one row that lists their items. Windows are looked up by the hash of
    their first ``probe`` words: all of a full window, else the largest power of two.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text")).select(
        "item_id", _words(F.col("text")).alias("words"), _low_words(F.col("text")).alias("low"))
    size = F.size("words")
    windows = (
        items.withColumn("length", F.least(size, F.lit(n))).filter("length > 0")
        .withColumn("probe", F.when(F.col("length") == n, F.lit(n)).otherwise(F.pow(F.lit(2), F.floor(F.log2("length") + 1e-9)).cast("int")))
        .select("*", F.explode(F.sequence(F.lit(1), size - F.col("length") + 1)).alias("start"))
        .select("item_id", "probe", "length", _key(F.col("low"), F.col("start"), F.col("probe")).alias("key"),
                _folded(F.col("words"), F.col("start"), F.col("length")).alias("gram"))
    )
    return windows.groupBy("probe", "key", "gram", "length").agg(F.collect_set("item_id").alias("item_ids"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, doc_id: str = "doc_id", text: str = "text",
                  share: int = 20, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated, spans, item_ids.

    A word inside any occurrence of a benchmark window is hit. ``contaminated``: some word is hit,
    and ``share`` times the hit words are no fewer than the words. The windows of all documents are
    looked up in a broadcast hash set, or by a shuffled join where the benchmark has more than
    ``broadcast_windows``, and verified by their words. Null and empty texts have no words and are
    clean. Each row is judged alone: rows that repeat, or share an id, or have none keep their own
    counts. Texts are looked through whole, whatever their length. An empty benchmark hits nothing, no documents give no
    rows, and other columns, whatever their names, play no part.
    """
    windows = benchmark_windows(benchmark, n).withColumnsRenamed({"probe": "w_probe", "key": "w_key"})
    probes = windows.groupBy("w_probe").count().orderBy(F.desc("w_probe")).collect()  # n rows at most
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.select("*", F.xxhash64("text").alias("text_hash"), _low_words(F.col("text")).alias("low"))
    # start 0 stands for the document itself
    probe, first = F.col("probe"), probes[0]["w_probe"] if probes else n
    starts = F.sequence(F.when(probe == first, 0).otherwise(1), F.greatest(F.size("low") - probe + 1, F.lit(0)))
    places = (
        rows.select("*", F.size("low").cast("bigint").alias("n_words"), F.explode(F.array(*[F.lit(r["w_probe"]) for r in probes] or [F.lit(n)])).alias("probe"))
        .select("*", F.explode(F.when((probe == first) | (F.size("low") >= probe), starts)).alias("start"))
        .withColumn("key", F.when(F.col("start") > 0, _key(F.col("low"), F.col("start"), probe)))
    )
    same = (F.col("key") == F.col("w_key")) & (probe == F.col("w_probe"))
    gram = _folded(_words(F.col("text")), F.col("start"), F.col("length"))
    if sum(r["count"] for r in probes) <= broadcast_windows:
        found = places.join(F.broadcast(windows), same, "left").filter(
            # the words are taken anew from the text only where the hash was found
            F.when(F.col("start") == 0, True).when(F.col("gram").isNull(), False).otherwise(gram == F.col("gram")))
    else:
        # places go through the shuffle without their document, which would be sent once a word
        keys = windows.select("w_key", "w_probe").distinct()
        near = places.select("row", "start", "key", "probe").filter("start > 0").join(keys, same, "left_semi")
        near = near.join(windows, same).select(F.col("row").alias("h_row"), F.col("start").alias("h_start"), "gram", "length", "item_ids")
        whole = rows.withColumn("n_words", F.size("low").cast("bigint"))
        found = whole.join(near, F.col("row") == F.col("h_row"), "left").withColumn("start", F.coalesce("h_start", F.lit(0)))
        hit = F.when(F.col("start") > 0, gram == F.col("gram")).otherwise(False)
        found = found.withColumn("start", F.when(hit, F.col("start")).otherwise(0)).withColumn("item_ids", F.when(hit, F.col("item_ids")))
    span = F.when(F.col("start") > 0, F.struct(F.col("start"), F.col("length")))
    joined = found.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("text_hash").alias("text_hash"), F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set(span)).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("start") > 0, F.col("item_ids")))))).alias("item_ids"))
    n_hit = _covered(F.col("spans")).cast("bigint")
    return joined.select(
        "doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), "spans", "item_ids")


def remove_documents(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without the contaminated ones; rows and columns are otherwise as they were."""
    bad = (contamination(docs, benchmark, doc_id=doc_id, text=text, **how).filter("contaminated")
           .select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct())
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs[text]) == bad["bad_hash"]), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` whose hit words are cut out, each with what stands between it and the next word."""
    spans = (contamination(docs, benchmark, doc_id=doc_id, text=text, **how).filter("n_hit > 0")
             .select(F.col("doc_id").alias("s_id"), F.col("text_hash").alias("s_hash"), F.col("spans").alias("s_spans")).distinct())
    spans = spans.withColumnsRenamed({c: fresh(docs, c) for c in spans.columns})
    i, h, s = spans.columns
    joined = docs.join(spans, docs[doc_id].eqNullSafe(spans[i]) & (F.xxhash64(docs[text]) == spans[h]), "left")
    parts = F.regexp_extract_all(F.col(text), F.lit(WORD + GAP), F.lit(0))
    lead = F.regexp_extract(F.col(text), "^" + GAP, 0)
    stays = F.filter(parts, lambda _, k: ~F.exists(F.col(s), lambda x: (k + 1 >= x["start"]) & (k + 1 < x["start"] + x["length"])))
    cut = F.when(F.col(s).isNotNull(), F.concat(lead, F.array_join(stays, ""))).otherwise(F.col(text))
    return joined.withColumn(text, cut).select(*docs.columns)
