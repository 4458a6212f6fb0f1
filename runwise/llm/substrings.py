"""Removal of every byte inside a long string that the corpus has twice, by suffix arrays of shards.

Every string of LENGTH bytes is handed to the smallest of the hashes of its GRAM-byte parts, its
anchor, so equal strings meet at equal anchors, and neighbouring strings share one. The text around
an anchor with all its strings is a piece. Pieces that occur twice are settled by counting. Only
pieces that share an anchor and differ go into suffix arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from runwise.session import scratch_path

from .suffixes import common_prefixes, suffix_array

LENGTH, GRAM = 400, 128
#: Bytes whose strings are handled together, and bytes of a shard's suffix array.
TOGETHER, SHARD = 1_000_000, 1_000_000
#: Pieces of one anchor that may meet in a shard. More are cut anew at anchors of longer parts, and what
#: meets in greater number even then is compared by the hashes of its strings.
MEET = 200
LONGER = (256, 384)
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[:1] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class Hashes:
    """Hashes of all parts of a byte string, from its prefix sums."""

    def __init__(self, size: int):
        letters = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
        self.letters, (self.up, self.down) = letters, _powers(size + 1)

    def parts(self, data: np.ndarray, length: int) -> np.ndarray:
        n = len(data)
        if n >= len(self.up):
            self.up, self.down = _powers(2 * n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.letters[data] * self.up[:n], out=sums[1:])
        h = (sums[length:] - sums[: n - length + 1]) * self.down[: n - length + 1]
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


def anchored(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: Hashes, length: int, gram: int):
    """For concatenated texts: arrays first, last (strings of a piece), and the hash of its anchor and its place."""
    width = length - gram + 1
    h = hashes.parts(data, gram)
    # the place breaks ties to the left; it is in the low bits, which the hash can spare
    key = (h & ~_U(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    low = key
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    at = (low & _U(0xFFFFFF)).astype(np.int64)
    n = len(data) - length + 1
    valid = np.zeros(n + 1, np.int64)
    ok = sizes >= length
    np.add.at(valid, starts[ok], 1)
    np.add.at(valid, starts[ok] + sizes[ok] - length + 1, -1)
    at = np.where(np.cumsum(valid[:n]) > 0, at[:n], -1)
    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(cut[1:], n) - 1
    some = at[cut] >= 0
    first, last = cut[some], last[some]
    return first, last, h[at[first]].view(np.int64), at[first]


def pieces(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """anchor, piece (a hash), key, first, last for every piece of ``docs`` (key, text as bytes)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = Hashes(2 * TOGETHER)

        def done(keys, offsets, texts):
            sizes = np.array([len(x) for x in texts])
            starts = np.cumsum(sizes) - sizes
            joined = b"".join(texts)
            first, last, anchor, place = anchored(np.frombuffer(joined, np.uint8), starts, sizes, hashes, length, gram)
            own = np.searchsorted(starts, first, side="right") - 1
            # the place of the anchor is part of what makes two pieces equal
            piece = [xxhash.xxh3_64_intdigest(joined[a : b + length], p) - (1 << 63)
                     for a, b, p in zip(first.tolist(), last.tolist(), (place - first).tolist())]
            shift = np.array(offsets)[own] - starts[own]
            return pa.record_batch(
                [pa.array(anchor), pa.array(piece, pa.int64()), pa.array([keys[i] for i in own.tolist()], pa.binary()),
                 pa.array((first + shift).astype(np.int64)), pa.array((last + shift).astype(np.int64))],
                names=["anchor", "piece", "key", "first", "last"])

        keys, offsets, texts, size = [], [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i in range(0, len(text) - length + 1, TOGETHER):
                    part = text[i : i + TOGETHER + length - 1]
                    keys.append(key)
                    offsets.append(i)
                    texts.append(part)
                    size += len(part)
                    if size > TOGETHER:
                        yield done(keys, offsets, texts)
                        keys, offsets, texts, size = [], [], [], 0
        if texts:
            yield done(keys, offsets, texts)

    return docs.select("key", "text").mapInArrow(cut, "anchor bigint, piece bigint, key binary, first bigint, last bigint")


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - 1


def repeated_in_shard(texts: list[bytes], owned: list[int], length: int) -> list[np.ndarray]:
    """Of each text, which of its first ``owned`` strings of ``length`` bytes the others, or itself, have too."""
    sizes = np.array([len(x) + 1 for x in texts])
    starts = np.cumsum(sizes) - sizes
    s = np.zeros(int(sizes.sum()), np.uint16)
    wanted = np.zeros(len(s), bool)
    for x, at, n in zip(texts, starts.tolist(), owned):
        s[at : at + len(x)] = np.frombuffer(x, np.uint8)
        s[at : at + len(x)] += 1
        wanted[at : at + n] = True
    order = suffix_array(s)
    order = order[wanted[order]]
    same = common_prefixes(s, order, length) >= length
    found = same.copy()
    second = np.flatnonzero(same[order])
    found[order[second - 1]] = True
    return [found[at : at + n] for at, n in zip(starts.tolist(), owned)]


def _shards(length: int):
    """Pieces, sorted by anchor, to the spans of those that occur once; whole anchors share a suffix array."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows):
            out: list[tuple] = []
            owned = [r["last"] - r["first"] + 1 for r in rows]
            for r, found in zip(rows, repeated_in_shard([r["text"] for r in rows], owned, length)):
                if r["n"] == 1:
                    a, b = _runs(found)
                    out += [(r["key"], r["first"] + i, r["first"] + j + length) for i, j in zip(a.tolist(), b.tolist())]
            k, a, b = zip(*out) if out else ((), (), ())
            return pa.record_batch([pa.array(k, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["key", "start", "stop"])

        rows, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if size > SHARD and r["anchor"] != rows[-1]["anchor"]:
                    yield done(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r["text"])
        if rows:
            yield done(rows)

    return search


def _finer(length: int, gram: int):
    """Pieces to the pieces of their own strings at anchors of ``gram`` bytes."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = Hashes(2 * TOGETHER)
        names = ("anchor", "piece", "n", "key", "first", "last", "text")

        def done(rows):
            sizes = np.array([len(r["text"]) for r in rows])
            starts = np.cumsum(sizes) - sizes
            joined = b"".join(r["text"] for r in rows)
            first, last, anchor, place = anchored(np.frombuffer(joined, np.uint8), starts, sizes, hashes, length, gram)
            own = np.searchsorted(starts, first, side="right") - 1
            out: dict[str, list] = {k: [] for k in names}
            for a, b, h, p, i in zip(first.tolist(), last.tolist(), anchor.tolist(), place.tolist(), own.tolist()):
                text, shift = joined[a : b + length], rows[i]["first"] - int(starts[i])
                for k, v in zip(names, (h, xxhash.xxh3_64_intdigest(text, p - a) - (1 << 63), rows[i]["n"], rows[i]["key"], a + shift, b + shift, text)):
                    out[k].append(v)
            return pa.record_batch(list(out.values()), names=names)

        rows, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                rows.append(r)
                size += len(r["text"])
                if size > TOGETHER:
                    yield done(rows)
                    rows, size = [], 0
        if rows:
            yield done(rows)

    return cut


def _strings(length: int):
    """Pieces to one row per string: hash (two numbers), key, start, n."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for r in batch.to_pylist():
                t, n = r["text"], r["last"] - r["first"] + 1
                h = [xxhash.xxh3_128_digest(t[i : i + length]) for i in range(n)]
                yield pa.record_batch([pa.array(h, pa.binary()), pa.array([r["key"]] * n, pa.binary()),
                                       pa.array(np.arange(r["first"], r["last"] + 1)), pa.array([r["n"]] * n, pa.int64())],
                                      names=["string", "key", "start", "n"])

    return each


def _take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {k: [] for k in ("anchor", "piece", "n", "key", "first", "last", "text")}
        size = 0
        for key, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "wanted"))):
            for w in wanted:
                for c in ("anchor", "piece", "n", "first", "last"):
                    out[c].append(w[c])
                out["key"].append(key)
                out["text"].append(text[w["first"] : w["stop"]])
                size += len(out["text"][-1])
            if size > 16_000_000:
                yield pa.record_batch(list(out.values()), names=list(out))
                out, size = {k: [] for k in out}, 0
        if size:
            yield pa.record_batch(list(out.values()), names=list(out))


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, spans) for each text that shares bytes: the md5 of the text, and start and stop of covered runs.

    A byte is covered if it is inside a string of ``length`` bytes that starts at another place of
    the corpus too, in the same text or in another row. Spans may touch and overlap.
    """
    spark = docs.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    keyed = docs.select(F.unhex(F.md5(F.col(text).cast("binary"))).alias("key"), F.col(text).cast("binary").alias("text")).filter(
        F.octet_length("text") >= length)
    every = kept(pieces(keyed, length, gram), "pieces")
    # each count is a table before rows meet it, so that both sides of the join are shuffles that a hot key can be split in
    common = kept(every.groupBy("anchor").count().filter("count > 1").select(F.col("anchor").alias("c_anchor")), "common")
    shared = kept(every.join(common, F.col("anchor") == F.col("c_anchor"), "left_semi"), "shared")
    kinds = kept(shared.groupBy("anchor", "piece").agg(F.count("*").alias("n"), F.min(F.struct("key", "first", "last")).alias("at")), "kinds")
    twice = kinds.filter("n > 1").select(F.col("anchor").alias("k_anchor"), F.col("piece").alias("k_piece"))
    whole = shared.join(twice, (F.col("anchor") == F.col("k_anchor")) & (F.col("piece") == F.col("k_piece")), "left_semi").select(
        "key", F.col("first").alias("start"), (F.col("last") + length).alias("stop")).distinct()

    # pieces that differ at an anchor
    mixed = kept(kinds.groupBy("anchor").count().filter("count > 1").select(F.col("anchor").alias("m_anchor")), "mixed")
    unlike = kinds.join(mixed, F.col("anchor") == F.col("m_anchor"), "left_semi").select("anchor", "piece", "n", "at.*")
    wanted = kept(unlike.groupBy("key").agg(F.collect_list(F.struct(
        "anchor", "piece", F.col("n"), "first", "last", (F.col("last") + length).alias("stop"))).alias("wanted")).withColumnRenamed("key", "w_key"), "wanted")
    taken = keyed.join(wanted, F.col("key") == F.col("w_key")).select("key", "text", "wanted").mapInArrow(
        _take, "anchor bigint, piece bigint, n bigint, key binary, first bigint, last bigint, text binary")
    # rows of the same text give the same pieces
    taken = kept(taken.dropDuplicates(["anchor", "piece"]), "unlike")
    spans = whole
    for longer in (*LONGER, None):
        size = kept(taken.groupBy("anchor").count().withColumnsRenamed({"anchor": "s_anchor"}), "sizes")
        sized = taken.join(size, F.col("anchor") == F.col("s_anchor")).select(*taken.columns, "count")
        few = sized.filter(f"count <= {MEET}").repartition("anchor").sortWithinPartitions("anchor", "piece").select(*taken.columns)
        spans = spans.unionByName(few.mapInArrow(_shards(length), "key binary, start bigint, stop bigint"))
        many = kept(sized.filter(f"count > {MEET}").select(*taken.columns), "many")
        if longer is None or many.isEmpty():
            break
        cut = kept(many.mapInArrow(_finer(length, longer), taken.schema.simpleString()[7:-1].replace(":", " ")), "finer")
        same = kept(cut.groupBy("anchor", "piece").agg(F.sum("n").alias("all"), F.min(F.struct("key", "first")).alias("at")).withColumnsRenamed(
            {"anchor": "a_anchor", "piece": "a_piece"}), "same")
        cut = kept(cut.join(same, (F.col("anchor") == F.col("a_anchor")) & (F.col("piece") == F.col("a_piece"))), "finer")
        spans = spans.unionByName(cut.filter("n = 1 and all > 1").select("key", F.col("first").alias("start"), (F.col("last") + length).alias("stop")))
        # one of each kind goes on, where its anchor has several
        one = cut.filter("key = at.key and first = at.first").withColumn("n", F.col("all")).select(*taken.columns)
        several = kept(one.groupBy("anchor").count().filter("count > 1").select(F.col("anchor").alias("m_anchor")), "several")
        taken = kept(one.join(several, F.col("anchor") == F.col("m_anchor"), "left_semi"), "unlike")
    strings = kept(many.mapInArrow(_strings(length), "string binary, key binary, start bigint, n bigint"), "strings")
    again = kept(strings.groupBy("string").count().filter("count > 1").select(F.col("string").alias("a_string")), "again")
    spans = spans.unionByName(strings.filter("n = 1").join(again, F.col("string") == F.col("a_string"), "left_semi").select(
        "key", "start", (F.col("start") + length).alias("stop")))
    return kept(spans.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans")), "spans")


def cut_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of each row, and n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay).

    Judged on the input: each covered byte goes, whatever else goes. A null or empty text, or one
    shorter than ``length``, keeps all. Rows of the same text lose all of it, if it is long enough,
    and a row repeats as often as it is there. A very long text is cut into overlapping parts for the
    search only, an empty table gives an empty one, and other columns play no part.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, digests, kept = [], [], [], [], []
            for t, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                t, at, parts, n, gone = t or b"", 0, [], 0, 0
                end = -1
                for s in spans or []:
                    a, b = s["start"], s["stop"]
                    if a > end:
                        n += 1
                    if b > end:
                        gone += b - max(a, end, 0)
                        if a > at:
                            parts.append(t[at:a])
                        at = end = b
                parts.append(t[at:])
                rest = b"".join(parts)
                sizes.append(len(t))
                removed.append(gone)
                runs.append(n)
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.record_batch([*(batch.column(i) for i in range(len(columns))), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                                   pa.array(runs, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())],
                                  names=[*columns, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    spans = repeated_spans(docs, text, length, gram).withColumnRenamed("key", "s_key")
    rows = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)), F.col(text).cast("binary").alias("text"))
    rows = rows.withColumn("key", F.unhex(F.md5("text")))
    joined = rows.join(spans, F.col("key") == F.col("s_key"), "left").select(*(F.col(f"c{i}") for i in range(len(columns))), "text", "spans")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return joined.mapInArrow(cut, f"{schema}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
