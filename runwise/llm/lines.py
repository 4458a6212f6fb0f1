"""Removal of repeated runs of lines: chunks cut where the content says so, and whole passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from runwise.session import written

#: A border follows a line for one in EVERY values of the hash rolled over the last ROLL lines.
ROLL, EVERY, LEAST = 2, 2, 2
#: Rows of a batch that are Python objects at a time, and bytes, with some for each row and line, that leave together.
ROWS_AT_ONCE, BYTES_OUT, ROW_BYTES, LINE_BYTES = 200, 8_000_000, 400, 100
_U = np.uint64


def borders(hashes: np.ndarray, every: int = EVERY, least: int = LEAST) -> list[tuple[int, int]]:
    """Chunks (first line, line behind the last) of a text with the given line hashes.

    The hash rolls over ROLL lines, so that a chunk's borders depend on the lines at them and not
    on their number. A chunk has at least ``least`` lines, unless the text ends before.
    """
    n = len(hashes)
    rolled = hashes.copy()
    for j in range(1, ROLL):
        rolled[j:] = rolled[j:] * _U(0x9E3779B97F4A7C15) + hashes[:-j]
    x = (rolled ^ (rolled >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    ends = np.flatnonzero((x >> _U(40)) % _U(every) == 0) + 1
    out, at = [], 0
    for e in ends.tolist():
        if e - at >= least and e < n:
            out.append((at, e))
            at = e
    if at < n:
        out.append((at, n))
    return out


def _rows(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    """The rows of batches, of which only a few are Python objects at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(first, ROWS_AT_ONCE)
            yield from zip(*(part.column(c).to_pylist() for c in columns))


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, chunk, lines, chars, key, body, at, pairs: the chunks of each text in order, and their bytes.

    Chunks of two lines or more have a key, the hash of their bytes. A null text is one chunk
    without lines and with a null body. ``at`` is the number of the chunk's first line, ``pairs``
    the hash of each of its lines with the one behind it (null where there is none, or both are
    blank). ``row`` numbers the rows of ``docs``, so write the result before joining it with itself.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        import xxhash
        from pyspark import TaskContext

        names = ("row", "doc_id", "chunk", "lines", "chars", "key", "body", "at", "pairs")
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.binary()))
        row, out, size = TaskContext.get().partitionId() << 40, {k: [] for k in names}, 0

        def done():
            return pa.record_batch([pa.array(out[k], t) for k, t in zip(names, kinds)], names=names)

        for i, t in _rows(batches, ("doc_id", "text")):
            lines = t.split(b"\n") if t is not None else []
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))
            pairs = [blake2b(x + b"\n" + y, digest_size=16).digest() if x.strip() or y.strip() else None for x, y in zip(lines, lines[1:])] + [None]
            for k, (a, b) in enumerate(borders(h) if lines else [(0, 0)]):
                body = b"\n".join(lines[a:b]) if lines else None
                chars = sum(map(len, lines[a:b])) + b - a
                for c, v in zip(names, (row, i, k, b - a, chars, xxhash.xxh3_128_digest(body) if b - a > 1 else None, body, a, pairs[a:b])):
                    out[c].append(v)
                size += chars + ROW_BYTES + LINE_BYTES * (b - a)
            row += 1
            if size > BYTES_OUT:
                yield done()
                out, size = {k: [] for k in names}, 0
        if out["row"]:
            yield done()

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(
        cut, "row bigint, doc_id bigint, chunk int, lines bigint, chars bigint, key binary, body binary, at bigint, pairs array<binary>")


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that are asked for of each chunk: all of it (part -1), or the first or second line of a pair (0, 1)."""
    names = ("key", "part", "row", "chunk", "line", "stays", "body", "claims")
    kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(),
             pa.list_(pa.struct([("line", pa.int64()), ("size", pa.int64())])))
    out, size = {k: [] for k in names}, 0
    for row, chunk, at, body, asks in _rows(batches, ("row", "chunk", "at", "body", "asks")):
        lines = body.split(b"\n")
        for ask in asks:
            if ask["part"] < 0:
                full = [False, *(bool(x.strip()) for x in lines), False]
                taken, place = body, at
                claims = [{"line": at + i, "size": len(x) + 1} for i, x in enumerate(lines) if any(full[i : i + 3])]
            else:
                place = ask["line"]
                taken = lines[place + ask["part"] - at]
                claims = [{"line": place + ask["part"], "size": len(taken) + 1}]
            for c, v in zip(names, (ask["key"], ask["part"], row, chunk, place, ask["stays"], taken, claims)):
                out[c].append(v)
            size += len(taken) + ROW_BYTES + LINE_BYTES * len(claims)
            if size > BYTES_OUT:
                yield pa.record_batch([pa.array(out[k], t) for k, t in zip(names, kinds)], names=names)
                out, size = {k: [] for k in names}, 0
    if out["row"]:
        yield pa.record_batch([pa.array(out[k], t) for k, t in zip(names, kinds)], names=names)


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``chunks`` as a table, the (row, chunk) that are copies, and the (row, line, size) inside repeated passages.

    Of the chunks with a key that occurs twice or more, in one text or in several, the first stays:
    that of the smallest id (null first), row and place. The others are copies if their bytes equal its bytes.

    A passage is any run of two lines or more that also stands at an earlier place, in another text
    or in the same one, whatever stands around it and wherever chunks end. What is inside a copy is part
    of one. From there to the edges of the passage, and where it holds no whole chunk, each two lines that
    follow each other are looked up, and taken if their bytes equal those of the first such pair. That
    first one stays, and so do lines that another pair has its first occurrence in. Blank lines alone are no passage.

    Hashes of 128 bits only propose, for chunks and pairs alike: what differs stays. Bytes are fetched
    for what is proposed, once for both.
    """
    every = written(chunks(docs, doc_id, text), "chunks")
    keyed = every.filter("key is not null").select("key", "doc_id", "row", "chunk")
    place = F.struct("doc_id", "row", "chunk")
    # proposed keys and pairs grow with the input, so they are never broadcast; as tables they let joins split a hot one
    many = written(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").select(
        F.col("key").alias("m_key"), F.col("first.row").alias("m_row"), F.col("first.chunk").alias("m_chunk")), "repeated")
    whole = keyed.join(many.hint("merge"), F.col("key") == F.col("m_key")).select(
        "row", "chunk", "key", F.lit(-1).alias("part"), F.lit(None).cast("bigint").alias("line"), F.lit(False).alias("across"),
        ((F.col("row") == F.col("m_row")) & (F.col("chunk") == F.col("m_chunk"))).alias("stays"))

    pairs = every.select("row", "doc_id", "chunk", "at", "lines", F.posexplode("pairs")).filter("col is not null").select(
        F.col("col").alias("pair"), "doc_id", "row", "chunk", (F.col("at") + F.col("pos")).alias("line"),
        (F.col("pos") + 1 == F.col("lines")).alias("across"))
    twice = pairs.groupBy("pair").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "line")).alias("first")).filter("n > 1")
    twice = written(twice.select(F.col("pair").alias("m_pair"), F.col("first.row").alias("m_row"), F.col("first.line").alias("m_line")), "pairs")
    halves = F.explode(F.array(F.struct(F.lit(0).alias("part"), "chunk"), F.struct(F.lit(1).alias("part"), (F.col("chunk") + F.col("across").cast("int")).alias("chunk"))))
    lines = pairs.join(twice.hint("merge"), F.col("pair") == F.col("m_pair")).select(
        "row", "pair", "line", "across", ((F.col("row") == F.col("m_row")) & (F.col("line") == F.col("m_line"))).alias("stays"), halves.alias("x")).select(
        "row", "x.chunk", F.col("pair").alias("key"), "x.part", "line", "across", "stays")

    # inside a chunk that may be a copy, its own comparison decides
    asks = whole.unionByName(lines).groupBy(F.col("row").alias("a_row"), F.col("chunk").alias("a_chunk")).agg(
        F.collect_list(F.struct("key", "part", "line", "across", "stays")).alias("asks"), F.max((F.col("part") < 0) & ~F.col("stays")).alias("copy"))
    asks = written(asks.select("a_row", "a_chunk", F.filter("asks", lambda a: (a["part"] < 0) | a["stays"] | a["across"] | ~F.col("copy")).alias("asks")), "asks")
    given = written(every.select("row", "chunk", "at", "body").join(asks.hint("merge"), (F.col("row") == F.col("a_row")) & (F.col("chunk") == F.col("a_chunk"))).select(
        "row", "chunk", "at", "body", "asks").mapInArrow(
        _asked, "key binary, part int, row bigint, chunk int, line bigint, stays boolean, body binary, claims array<struct<line:bigint,size:bigint>>"), "given")
    first = given.filter("stays").select(F.col("key").alias("f_key"), F.col("part").alias("f_part"), F.col("body").alias("f_body"))
    equal = written(given.filter("not stays").join(
        first.hint("merge"), (F.col("key") == F.col("f_key")) & (F.col("part") == F.col("f_part")) & (F.col("body") == F.col("f_body"))).select(
        "part", "row", "chunk", "line", "claims"), "equal")

    # a pair is equal if both of its lines are
    both = equal.filter("part >= 0").groupBy("row", "line").agg(F.flatten(F.collect_list("claims")).alias("claims")).filter("size(claims) = 2")
    claims = equal.filter("part < 0").select("row", "claims", F.lit(False).alias("stays")).unionByName(
        both.select("row", "claims", F.lit(False).alias("stays"))).unionByName(
        given.filter("stays and part >= 0").select("row", "claims", "stays")).select("row", "stays", F.inline("claims"))
    passages = claims.groupBy("row", "line").agg(F.max("stays").alias("stays"), F.max("size").alias("size")).filter("not stays").drop("stays")
    return every, equal.filter("part < 0").select("row", "chunk"), passages


def line_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_chunks, n_removed_chunks, n_removed_lines, n_removed_bytes, n_passage_lines, n_passage_bytes.

    The removed chunks, lines and bytes are those of ``remove_repeats``, which takes whole chunks
    only; the last two columns count what ``remove_passages`` takes.
    A removed line counts with its line break. A null text has no line, an empty one has one.
    Repeated rows are told apart; the first of them keeps its chunks. Texts of a single line, of any
    length, keep it. An empty table gives an empty one, and other columns play no part, whatever their names.
    """
    every, gone, passages = repeats(docs, doc_id, text)
    gone = gone.withColumnsRenamed({"row": "g_row", "chunk": "g_chunk"})
    marked = every.select("row", "doc_id", "chunk", "lines", "chars").join(
        gone.hint("merge"), (F.col("row") == F.col("g_row")) & (F.col("chunk") == F.col("g_chunk")), "left")
    out = F.col("g_row").isNotNull()
    counts = marked.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("lines").alias("n_lines"), F.count(F.when(F.col("lines") > 0, 1)).alias("n_chunks"),
        F.count(F.when(out, 1)).alias("n_removed_chunks"), F.sum(F.when(out, F.col("lines")).otherwise(0)).alias("n_removed_lines"),
        F.sum(F.when(out, F.col("chars")).otherwise(0)).alias("n_removed_bytes"))
    passages = passages.groupBy(F.col("row").alias("p_row")).agg(F.count("*").alias("p_lines"), F.sum("size").alias("p_bytes"))
    return counts.join(passages.hint("merge"), F.col("row") == F.col("p_row"), "left").withColumns(
        {"n_passage_lines": F.coalesce("p_lines", F.lit(0)), "n_passage_bytes": F.coalesce("p_bytes", F.lit(0))}).drop("row", "p_row", "p_lines", "p_bytes")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text per row, without the removed chunks.

    Empty where all lines went, null where it was null.
    """
    every, gone, _ = repeats(docs, doc_id, text)
    gone = gone.withColumnsRenamed({"row": "g_row", "chunk": "g_chunk"})
    marked = every.join(gone, (F.col("row") == F.col("g_row")) & (F.col("chunk") == F.col("g_chunk")), "left")
    stays = F.when(F.col("g_row").isNull(), F.struct("chunk", F.col("body").cast("string").alias("body")))
    whole = marked.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max(F.col("body").isNotNull()).alias("real"), F.sort_array(F.collect_list(stays)).alias("parts"))
    return whole.select("doc_id", F.when(F.col("real"), F.array_join(F.transform("parts", lambda p: p["body"]), "\n")).alias("text"))


def remove_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text per row, without the lines of repeated passages.

    Empty where all lines went, null where it was null.
    """
    every, _, passages = repeats(docs, doc_id, text)
    gone = passages.select(F.col("row").alias("g_row"), F.col("line").alias("g_line"))
    lines = every.select("row", "doc_id", "at", F.posexplode_outer(F.split(F.col("body").cast("string"), "\n"))).select(
        "row", "doc_id", (F.col("at") + F.coalesce("pos", F.lit(0))).alias("line"), F.col("col").alias("body"))
    marked = lines.join(gone.hint("merge"), (F.col("row") == F.col("g_row")) & (F.col("line") == F.col("g_line")), "left")
    stays = F.when(F.col("g_row").isNull(), F.struct("line", "body"))
    whole = marked.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max(F.col("body").isNotNull()).alias("real"), F.sort_array(F.collect_list(stays)).alias("parts"))
    return whole.select("doc_id", F.when(F.col("real"), F.array_join(F.transform("parts", lambda p: p["body"]), "\n")).alias("text"))
