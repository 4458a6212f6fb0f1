"""Near duplicates by BagMinHash signatures, banding and a check of every multiset overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from runwise.session import scratch_path

from .common import fresh
from .graph import components

WORDS = 5
#: A pair is similar if ``NEAR[1] * overlap >= NEAR[0] * union`` of its shingle multisets.
NEAR = (4, 5)
#: A pair at similarity 0.8 misses all bands once in 20,000 times.
BANDS, ROWS = 25, 5
#: Shingles that are signed together, and texts that are Python objects at a time.
TOGETHER, ROWS_AT_ONCE = 400_000, 200
_U = np.uint64
#: ASCII but letters and digits separates words.
TO_SPACE = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased runs of ASCII letters and digits and of all characters beyond ASCII."""
    return (text or b"").lower().translate(TO_SPACE).split()


def mix(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(words: list[bytes]) -> np.ndarray:
    """A number for each run of five words; one for all of a shorter text; none for no word."""
    import xxhash

    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(len(w) - WORDS + 1, min(len(w), 1))
    h = np.zeros(n, np.uint64)
    for j in range(min(WORDS, len(w))):
        h = mix(h + w[j : j + n] + _U(0x9E3779B97F4A7C15))
    return h


def signatures(bags: list[np.ndarray], size: int) -> np.ndarray:
    """BagMinHash signatures, one row of ``size`` times per bag; equal places estimate weighted Jaccard.

    The weights 1, 2, 3-4, 5-8, ... of an element are the blocks of a hierarchy. Each block of an
    element is a Poisson process whose rate is its width, the same in every bag; a point belongs
    to one weight of the block and to one place of the signature, and counts in the bags that have
    that weight. A bag's places keep their first points, so its processes are followed only until
    they pass the latest of these.
    """
    doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    h = np.concatenate(bags) if bags else np.array([], np.uint64)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(first)
    weight = np.diff(np.append(at, len(h)))
    doc, h = doc[at], h[at]
    # one process per element and block: [0, 1), [1, 2), [2, 4), ...
    blocks = np.ceil(np.log2(weight)).astype(np.int64) + 1
    rep = np.repeat(np.arange(len(h)), blocks)
    block = np.arange(len(rep)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(block > 0, 2.0 ** (block - 1.0), 0.0)
    width = np.maximum(low, 1.0)
    doc, weight = doc[rep], weight[rep].astype(float)
    seed = mix(h[rep] + block.astype(np.uint64) * _U(0xD1342543DE82EF95))
    times = np.zeros(len(seed))
    out = np.full((len(bags), size), np.inf)
    flat, step = out.reshape(-1), 0
    while len(seed):
        step += 1
        a = mix(seed + _U(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        times = times - np.log1p(-(a >> _U(11)).astype(float) * 2.0**-53) / width
        b = mix(a ^ _U(0xA0761D6478BD642F))
        place = ((b >> _U(32)) * _U(size) >> _U(32)).astype(np.int64)
        counts = low + (b & _U(0xFFFFFFFF)).astype(float) * 2.0**-32 * width < weight
        np.minimum.at(flat, (doc * size + place)[counts], times[counts])
        alive = times < out.max(1)[doc]
        seed, times, doc, low, width, weight = (x[alive] for x in (seed, times, doc, low, width, weight))
    return out


def bands(sig: np.ndarray, n: int, rows: int) -> np.ndarray:
    """One number per band of each signature."""
    x = sig.view(np.uint64).reshape(len(sig), n, rows)
    h = np.tile(np.arange(n, dtype=np.uint64), (len(sig), 1))
    for j in range(rows):
        h = mix(h * _U(0x9E3779B97F4A7C15) + x[:, :, j])
    return h.view(np.int64)


def signed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, key (of the words; null without any), size, bands."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def done(ids, hashes, keys, bags):
            b = np.zeros((len(bags), n), np.int64)
            some = [i for i, x in enumerate(bags) if len(x)]
            if some:
                b[some] = bands(signatures([bags[i] for i in some], n * rows), n, rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, b.size + 1, n), pa.int32()), pa.array(b.reshape(-1)))
            return pa.record_batch([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(keys, pa.binary()),
                                    pa.array([len(x) for x in bags], pa.int64()), lists], names=["doc_id", "text_hash", "key", "size", "bands"])

        ids, hashes, keys, bags, size = [], [], [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                for i, h, t in zip(*(c.slice(at, ROWS_AT_ONCE).to_pylist() for c in batch.columns)):
                    words = words_of(t)
                    ids.append(i)
                    hashes.append(h)
                    keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                    bags.append(shingles(words))
                    size += len(words) + 20
                    if size > TOGETHER:
                        yield done(ids, hashes, keys, bags)
                        ids, hashes, keys, bags, size = [], [], [], [], 0
        if ids:
            yield done(ids, hashes, keys, bags)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("binary").alias("text")).mapInArrow(
        sign, "doc_id bigint, text_hash bigint, key binary, size bigint, bands array<bigint>")


def overlaps(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``shared`` and ``all``: overlap and union of the shingle multisets of ``texts`` (key, text)."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bag(text):
            return np.unique(shingles(words_of(text)), return_counts=True)

        for batch in batches:
            shared, union, last = [], [], (None, None)
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if last[0] != tb:
                    last = (tb, bag(tb))
                (ka, na), (kb, nb) = bag(ta), last[1]
                _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
                shared.append(int(np.minimum(na[ia], nb[ib]).sum()))
                union.append(int(na.sum() + nb.sum()) - shared[-1])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(union, pa.int64())],
                                  names=["a", "b", "shared", "all"])

    return _with_texts(pairs, texts).mapInArrow(compare, "a binary, b binary, shared bigint, all bigint")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b and their texts ta, tb."""
    left = texts.select(F.col("key").alias("ka"), F.col("text").cast("binary").alias("ta"))
    right = texts.select(F.col("key").alias("kb"), F.col("text").cast("binary").alias("tb"))
    both = pairs.select("a", "b").join(right, F.col("b") == F.col("kb")).join(left, F.col("a") == F.col("ka"))
    return both.select("a", "b", "ta", "tb")


def additions(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (key, pivot) to one row a, b, shingle, n for each shingle of ``key`` and how often it has it more than ``pivot``."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, shingle, more = [], [], [], []
            for ka, kb, ta, tb in zip(*(c.to_pylist() for c in batch.columns)):
                (s, n), (t, m) = (np.unique(shingles(words_of(x)), return_counts=True) for x in (ta, tb))
                _, i, j = np.intersect1d(s, t, assume_unique=True, return_indices=True)
                n = n.copy()
                n[i] -= m[j]
                s, n = s[n > 0], n[n > 0]
                a += [ka] * len(s)
                b += [kb] * len(s)
                shingle += s.view(np.int64).tolist()
                more += n.tolist()
            yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(shingle, pa.int64()), pa.array(more, pa.int64())],
                                  names=["a", "b", "shingle", "n"])

    return _with_texts(pairs.select(F.col("key").alias("a"), F.col("pivot").alias("b")), texts).mapInArrow(
        compare, "a binary, b binary, shingle bigint, n bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", near: tuple[int, int] = NEAR,
                    n: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, class_id, class_key.

    ``class_id`` is the smallest id of the documents that are linked, directly or through others, by
    a similarity of at least ``near[0] / near[1]``: the weighted Jaccard overlap of their multisets of
    five-word shingles. Documents of the same words are one node. Nodes that share a band are
    candidates; each is checked against the bucket's pivot, its most connected node. What that leaves
    in more than one component is checked further, but only where the overlaps with the pivot
    allow a link, or with the shingles that both have and the pivot lacks do: first against one member of each
    group that meets, then, where that linked nothing, pair by pair. So a large group of
    copies needs a check or two per node, and no pair of a bucket that could be a link stays unchecked. The pairs that
    are left are those of nodes which are similar, but not similar enough.

    Texts without a word (null, empty, marks only) are each a class of their own, under their own
    id. Shorter texts than five words are one shingle. Repeated rows are copies. Ids may be null:
    such rows belong to a class, but don't name one unless no other row does. Texts are compared whole, whatever
    their length; an empty table gives an empty one; other columns, whatever their names, play no part. ``class_key``, null for
    texts without a word, tells classes apart even where rows of different texts share an id.
    """
    spark = docs.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    sig = kept(signed(docs, doc_id, text, n, rows), "signatures")
    nodes = sig.filter("key is not null").groupBy("key").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("row"), F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = kept(nodes, "nodes")
    places = nodes.select("key", "size", F.explode("bands").alias("bucket"))
    buckets = places.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1").withColumnRenamed("bucket", "b_bucket")
    members = kept(places.join(buckets, F.col("bucket") == F.col("b_bucket")).select("bucket", "members", "key", "size"), "members")
    # the pivot of a bucket is the member that shares most places with others, as an original does among its copies
    central = members.groupBy("key").agg(F.sum("members").alias("weight")).withColumnRenamed("key", "c_key")
    pivots = members.join(central, F.col("key") == F.col("c_key")).groupBy("bucket").agg(
        F.max(F.struct("weight", "key"))["key"].alias("pivot")).withColumnRenamed("bucket", "p_bucket")
    members = kept(members.join(pivots, F.col("bucket") == F.col("p_bucket")).select("bucket", "pivot", "key", "size"), "members")

    wanted = members.select("key").distinct()
    rows_of = nodes.join(wanted, "key", "left_semi").select("key", F.col("row.doc_id").alias("r_id"), F.col("row.text_hash").alias("r_hash"))
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    texts = source.join(rows_of, (F.col("text_hash") == F.col("r_hash")) & F.col("doc_id").eqNullSafe(F.col("r_id"))).select("key", "text")
    # rows that are repeated would give a text more than once
    texts = kept(texts.groupBy("key").agg(F.first("text").alias("text")), "candidates")

    linked = F.expr(f"{near[1]} * shared >= {near[0]} * all")

    checked = kept(overlaps(members.filter("key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b")).distinct(), texts), "checked")
    links = checked.filter(linked).select("a", "b")
    roots = kept(components(links), "roots")

    # what is in more than one component of a bucket
    placed = members.filter("key <> pivot").join(roots, F.col("key") == F.col("node"), "left").select(
        "bucket", "pivot", "key", "size", F.coalesce("root", "key").alias("root"))
    placed = placed.join(checked.select("a", "b", "shared"), (F.col("key") == F.col("a")) & (F.col("pivot") == F.col("b"))).drop("a", "b")
    open_ = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select(F.col("bucket").alias("o_bucket"))
    placed = kept(placed.join(open_, F.col("bucket") == F.col("o_bucket"), "left_semi"), "open")
    # the pivot's part of an overlap is no more than the smaller overlap with the pivot; pairs for which that is enough
    both = near[0] + near[1]

    def apart(x: str, y: str) -> str:
        """``x`` is the smaller, the two may be similar by their sizes, and nothing links them yet."""
        return (f"({x}.size < {y}.size or {x}.size = {y}.size and {x}.key < {y}.key) and {x}.root <> {y}.root"
                f" and {near[1]} * {x}.size >= {near[0]} * {y}.size")

    enough = f"{both} * least(x.shared, y.shared) >= {near[0]} * (x.size + y.size)"
    # all other pairs need shingles that both have and the pivot has not: so many that two nodes of a link
    # share one of the first of these in any order, once each leaves out one less than it needs. The
    # rarest go first, so what a family of copies has in common hardly counts.
    added = kept(additions(placed.select("key", "pivot").distinct(), texts), "additions")
    known = placed.select("key", "pivot", "size", "root", "shared").distinct()
    added = kept(added.join(known, (F.col("a") == F.col("key")) & (F.col("b") == F.col("pivot"))).select(
        "pivot", "key", "size", "root", "shared", "shingle", "n"), "additions")
    often = added.groupBy("pivot", "shingle").agg(F.count("*").alias("often")).withColumnsRenamed({"pivot": "o_pivot", "shingle": "o_shingle"})
    rarest = Window.partitionBy("pivot", "key").orderBy("often", "shingle").rowsBetween(Window.unboundedPreceding, -1)
    # of a link the larger node shares near[0] / near[1] of its own size at least, the smaller (and nodes of equal size)
    # twice near[0] of both; the pivot gives up to ``shared`` of that
    needs = {"low": f"ceil({2 * near[0]} * size / {both} - 1e-9D)", "high": f"ceil({near[0]} * size / {near[1]} - 1e-9D)"}
    within = {k: F.expr(f"ahead <= size - shared - greatest(1, {v} - shared)") for k, v in needs.items()}
    first = (
        added.join(often, (F.col("pivot") == F.col("o_pivot")) & (F.col("shingle") == F.col("o_shingle")))
        .withColumn("ahead", F.coalesce(F.sum("n").over(rarest), F.lit(0)))
        .filter((F.col("often") > 1) & within["high"])
        .select("pivot", "key", "size", "root", "shingle", within["low"].alias("low")))
    first = kept(first, "first")
    # the shingles of a passage are with the same nodes, whose pairs one of them brings
    member = F.xxhash64("key", "low")
    sets = first.groupBy("pivot", "shingle").agg(F.bit_xor(member).alias("one"), F.sum(member.bitwiseAND((1 << 40) - 1)).alias("two"), F.count("*").alias("of"))
    stands = sets.groupBy("pivot", "one", "two", "of").agg(F.min("shingle").alias("s_shingle")).filter("of > 1").select(F.col("pivot").alias("s_pivot"), "s_shingle")
    first = kept(first.join(kept(stands, "shingles"), (F.col("pivot") == F.col("s_pivot")) & (F.col("shingle") == F.col("s_shingle")), "left_semi"), "first")

    def renamed(groups: DataFrame) -> DataFrame:
        """With the roots as they are after further links."""
        now = roots.select(F.col("node").alias("n_node"), F.col("root").alias("n_root"))
        return kept(groups.join(now, F.col("key") == F.col("n_node"), "left").withColumn("root", F.coalesce("n_root", "key")).drop("n_node", "n_root"), "open")

    def centred(groups: DataFrame, by: list[str], condition: str) -> DataFrame:
        """Each group's members with its largest one."""
        center = F.max(F.struct("size", "key", *[c for c in groups.columns if c not in (*by, "size", "key")])).alias("c")
        y = kept(groups.groupBy(*by).agg(center).select(*[F.col(c).alias(f"y_{c}") for c in by], "c.*"), "centers").alias("y")
        x = groups.alias("x")
        same = " and ".join(f"x.{c} = y.y_{c}" for c in by)
        return x.join(y, F.expr(f"{same} and {apart('x', 'y')} and {condition}")).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))

    def paired(groups: DataFrame, by: list[str], condition: str) -> DataFrame:
        x, y = groups.alias("x"), groups.alias("y")
        same = " and ".join(f"x.{c} = y.{c}" for c in by)
        return x.join(y, F.expr(f"{same} and {apart('x', 'y')} and {condition}")).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))

    # first against one member of each group, which links a family in as many pairs as it has members; then
    # what is still apart, pair by pair
    done = None
    for pairs in (centred, paired):
        rest = pairs(placed, ["bucket"], enough).unionByName(pairs(first, ["pivot", "shingle"], "x.low")).distinct()
        rest = rest if done is None else rest.join(done, ["a", "b"], "left_anti")
        done = kept(overlaps(rest, texts), "checked")
        extra = done.filter(linked).select("a", "b")
        if extra.take(1):
            roots = kept(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(extra)), "roots")
            if pairs is centred:
                placed, first = renamed(placed), renamed(first)
    named = nodes.select("key", "doc_id").join(roots, F.col("key") == F.col("node"), "left").select("key", "doc_id", F.coalesce("root", "key").alias("root"))
    names = named.groupBy("root").agg(F.min("doc_id").alias("class_id")).withColumnRenamed("root", "n_root")
    classes = named.join(names, F.col("root") == F.col("n_root")).select(F.col("key").alias("c_key"), "class_id", F.col("root").alias("class_key"))
    return sig.join(classes, F.col("key") == F.col("c_key"), "left").select(
        "doc_id", "text_hash", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "class_key")


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of ``docs`` per class: that of the smallest id, and of its texts the one of smallest hash.

    Texts without a word all stay. Rows that repeat an id and a text are one. Classes whose ids are
    all null keep one row.
    """
    found = near_duplicates(docs, doc_id, text, **how)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("row")
    one = found.filter("class_key is not null").groupBy("class_key").agg(best).select("row.doc_id", "row.text_hash").unionByName(
        found.filter("class_key is null").select("doc_id", "text_hash").distinct()).select(
        F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"))
    h = fresh(docs, "text_hash")
    keyed = docs.withColumn(h, F.xxhash64(text))
    rest = [c for c in docs.columns if c != doc_id]
    single = keyed.groupBy(doc_id, h).agg(*[F.first(c).alias(c) for c in rest])
    return single.join(one, (single[h] == one["k_hash"]) & single[doc_id].eqNullSafe(one["k_id"]), "left_semi").select(*docs.columns)
