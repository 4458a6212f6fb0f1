"""Fill-in-middle: texts cut in three, whose parts change places inside one buffer."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: What stands before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
SCHEMA = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
#: Bytes of output that a batch holds before it is handed on, and texts that are Python objects at a time.
BATCH_BYTES, ROWS_AT_ONCE = 16_000_000, 200


def unit_ends(data: bytes) -> np.ndarray:
    """Where the lines of a text end; the last may lack its line feed."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    if len(data) and not (len(ends) and ends[-1] == len(data)):
        ends = np.append(ends, len(data))
    return ends


def code_points(data: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return int(((np.frombuffer(data, np.uint8) & 0xC0) != 0x80).sum())


def rotate(buffer: bytearray, first: int, middle: int, last: int) -> None:
    """Let ``buffer[first:middle]`` and ``buffer[middle:last]`` change places, by three reversals."""
    view = np.frombuffer(buffer, np.uint8)
    for a, b in ((first, middle), (middle, last), (first, last)):
        view[a:b] = view[a:b][::-1]


def arrange(data: bytes, cuts: tuple[int, int], form: str, sentinels: tuple[bytes, bytes, bytes]) -> bytearray:
    """The text with its sentinels, the suffix before the middle (psm) or before the prefix (spm)."""
    p, s, m = sentinels
    a, b = cuts
    buffer = bytearray(data)
    buffer[b:b] = s
    buffer[a:a] = m
    buffer[0:0] = p
    rotate(buffer, len(p) + a if form == "psm" else 0, len(p) + len(m) + b, len(buffer))
    return buffer


def restore(output: bytes, form: str, sentinels: tuple[bytes, bytes, bytes]) -> bytearray:
    """The text of an ``arrange``d one: the inverse rotation, then the sentinels go."""
    p, s, m = sentinels
    buffer = bytearray(output)
    if form == "plain":
        return buffer
    # no sentinel is in the text, so the first of each kind is the one that was put in
    at = {x: buffer.index(x) for x in sentinels}
    first = at[s]  # the suffix moved to here
    moved = at[m] if form == "psm" else at[p]
    rotate(buffer, first, moved, len(buffer))
    for x in (s, m, p):
        k = buffer.index(x)
        del buffer[k : k + len(x)]
    return buffer


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers that depend on the seed and the id alone."""
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])


def transform(data: bytes, doc_id: int | None, seed: int, percent: int, spm_percent: int, sentinels: tuple[bytes, bytes, bytes]) -> tuple:
    """n, form, prefix_chars, middle_chars and the output of one text."""
    ends = unit_ends(data)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not data or h3 % 100 >= percent or any(x in data for x in sentinels):
        return n, "plain", None, None, data
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (low, high))
    form = "spm" if h4 % 100 < spm_percent else "psm"
    return n, form, code_points(data[:a]), code_points(data[a:b]), bytes(arrange(data, (a, b), form, sentinels))


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 7, percent: int = 100,
                   spm_percent: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Per row of ``docs``: doc_id, n, form, prefix_chars, middle_chars, output.

    A text of ``n`` lines is cut behind two of them, or before the first, as its id and ``seed`` say;
    prefix, middle and suffix may be empty. ``percent`` of the ids are rearranged, and of these
    ``spm_percent`` put the suffix first; the others put it second. ``form`` is plain, with the
    text as it was and no counts, for the rest, for empty texts and for those that hold a sentinel.

    A null text is an empty one. A null id is the empty string where it is hashed. Rows are handled
    alone, so repeated rows give equal rows, rows that share an id share their draws, ties do not
    arise, and an empty table gives an empty one. Texts are handled whole, whatever their length.
    Other columns play no part.
    """
    marks = _bytes(sentinels)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, size = [], [], 0
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                for i, t in zip(*(batch.column(c).slice(at, ROWS_AT_ONCE).to_pylist() for c in ("doc_id", "text"))):
                    ids.append(i)
                    rows.append(transform(t or b"", i, seed, percent, spm_percent, marks))
                    size += len(rows[-1][-1])
                    if size > BATCH_BYTES:
                        yield done(ids, rows)
                        ids, rows, size = [], [], 0
            if ids:
                yield done(ids, rows)

    def done(ids, rows):
        n, form, prefix, middle, output = zip(*rows)
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()),
                                pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                               names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(each, f"doc_id bigint, {SCHEMA}")


def restored(output: str | Column, form: str | Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact texts of columns ``output`` and ``form``, from these alone. A null output gives null."""
    marks = _bytes(sentinels)

    @F.arrow_udf("string")
    def back(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.string())]
        for at in range(0, len(outputs), ROWS_AT_ONCE):
            pairs = zip(*(x.slice(at, ROWS_AT_ONCE).to_pylist() for x in (outputs.cast(pa.binary()), forms)))
            parts.append(pa.array([None if o is None else restore(o, f, marks) for o, f in pairs], pa.binary()).cast(pa.string()))
        return pa.concat_arrays(parts)

    return back(output, form)


def _bytes(sentinels: tuple[str, str, str]) -> tuple[bytes, bytes, bytes]:
    marks = tuple(x.encode() for x in sentinels)
    if not all(marks) or any(x != y and y.startswith(x) or x[0] in y[1:] for x in marks for y in marks) or len(set(marks)) != 3:
        raise ValueError("sentinels must be three strings, none the start of another, whose first bytes are nowhere else in them")
    return marks
