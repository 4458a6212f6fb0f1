"""Line-first cleaning: lines are judged one by one, then documents by what is left of them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SYMBOLS = b"#*$%&|<>"
#: Words that stand between the entries of a menu.
SEPARATORS = frozenset(x.encode() for x in ("|", "»", "›", "•", "·", ">", "<", "/", "-", "–"))
BOILERPLATE = re.compile(
    rb"cookie (?:policy|settings)|all rights reserved|privacy policy|terms of (?:use|service)"
    rb"|enable javascript|subscribe to|click here|sign up for|share this",
    re.IGNORECASE,
)
# Marks that end or part sentences, beyond ASCII: ellipsis; Greek; Armenian; Arabic, Urdu and
# Syriac; Devanagari; Sinhala; Thai; Tibetan; Burmese; Ethiopic; Khmer; Mongolian; Chinese and Japanese; wide forms.
MARKS = "…\u037e։՝՜՞،؛؟۔܀।॥෴ฯ๚๛།༎၊။፠።፣፤፥፦፧፨។៕៖᠂᠃᠅、。，．：；！？｡､"
MARK = re.compile(b"|".join(x.encode() for x in MARKS))
SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_lines bigint, n_bad_lines bigint, lost_chars bigint, base_failed boolean, kept boolean, clean_text string"
)
_ARROW = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
#: Texts that are Python objects at a time.
ROWS_AT_ONCE = 200
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that the text has twice or more."""
    n = len(words) - 7
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    h = ids[:n] * _MIX[0]
    for j in range(1, 8):
        h += ids[j : j + n] * _MIX[j]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += twice
    edges[8 : n + 8] -= twice
    return int((np.cumsum(edges[:-1]) > 0).sum())


def bad_line(line: bytes, words: list[bytes]) -> bool:
    """Whether a line with words fails one of the line rules.

    Punctuation: ten words or more without any mark of any script. Navigation: a third of the words are
    separators. Symbols or exclamation marks: more than one to two words. Repetition: ten words
    or more, a fifth of them different at most. Boilerplate: one of the fixed phrases.
    """
    n = len(words)
    if n >= 10 and (len(set(words)) * 5 <= n or not re.search(rb"[.,;:!?]", line) and not (not line.isascii() and MARK.search(line))):
        return True
    if 2 * sum(map(line.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))) > n or 2 * line.count(b"!") > n:
        return True
    if n >= 3 and 3 * sum(w in SEPARATORS for w in words) >= n:
        return True
    return BOILERPLATE.search(line) is not None


def _chars(words: list[bytes]) -> int:
    """Code points of UTF-8 words."""
    data = b"".join(words)
    return len(data) if data.isascii() else len(data.decode("utf-8", "replace"))


def judge_text(data: bytes | None, min_words: int, repeat_percent: int, lost_percent: int) -> tuple:
    """The values of ``SCHEMA`` for one text; the last is None where no line goes."""
    if data is None:
        return 0, 0, 0, 0, 0, 0, 0, 0, min_words > 0, min_words <= 0, None
    lines, seen = data.split(b"\n"), set()
    all_words: list[bytes] = []
    good, chars, lost, dup, bad = [], 0, 0, 0, 0
    for line in lines:
        words = line.split()
        if not words:
            good.append(line)
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        all_words += words
        c = _chars(words)
        chars += c
        if bad_line(line, words):
            bad += 1
            lost += c
        else:
            good.append(line)
    n = len(all_words)
    repeat = repeated_words(all_words)
    failed = n < min_words or 100 * repeat > repeat_percent * n
    kept = not failed and 100 * lost <= lost_percent * chars
    symbols = sum(data.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    return (n, chars, symbols, dup, repeat, len(lines), bad, lost, failed, kept,
            b"\n".join(good) if bad else None)


def line_quality(text: str | Column, min_words: int = 20, repeat_percent: int = 30, lost_percent: int = 50) -> Column:
    """A struct of ``SCHEMA`` with the counts and the verdict of a text column.

    ``base_failed``: fewer than ``min_words`` words, or more than ``repeat_percent`` of them in
    8-word windows that occur twice. ``kept``: not that, and the lines that fail ``bad_line`` hold
    at most ``lost_percent`` of the characters in words. ``clean_text`` is the text without failing
    lines, null where none fails; lines without a word stay. Null: no words; it and an empty text
    fail by their word count. Each row is judged alone, so ties, repeated rows and other columns
    play no part, an empty table gives an empty one, and a text is handled whole, whatever its length.
    """
    fields = [(c.split()[0], _ARROW[c.split()[1]]) for c in SCHEMA.split(", ")]

    @F.arrow_udf(SCHEMA)
    def judge(texts: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.struct(fields))]
        for at in range(0, len(texts), ROWS_AT_ONCE):
            rows = [judge_text(x, min_words, repeat_percent, lost_percent) for x in texts.slice(at, ROWS_AT_ONCE).to_pylist()]
            columns = [pa.array([x and x.decode("utf-8", "replace") for x in c] if t == pa.string() else c, t) for c, (_, t) in zip(zip(*rows), fields)]
            parts.append(pa.StructArray.from_arrays(columns, names=[n for n, _ in fields]))
        return pa.concat_arrays(parts)

    c = F.col(text) if isinstance(text, str) else text
    return judge(c.cast("string").cast("binary"))


def clean_documents(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", min_words: int = 20, repeat_percent: int = 30,
                    lost_percent: int = 50) -> DataFrame:
    """The documents that pass, without their failing lines and with the same columns.

    ``n_chars``, if it is a column, is set to the new length where lines went. Nulls, empty and long texts and
    repeated rows are as in ``line_quality``. Documents go through the workers a few at a time, and each comes
    back once, so that neither side holds more than a batch.
    """
    at, length = docs.columns.index(text), docs.columns.index(n_chars) if n_chars in docs.columns else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(first, ROWS_AT_ONCE)
                rows = [judge_text(x, min_words, repeat_percent, lost_percent) for x in part.column(at).cast(pa.binary()).to_pylist()]
                keep = pa.array([r[-2] for r in rows])
                changed = [None if r[-1] is None else r[-1].decode("utf-8", "replace") for r in rows]
                columns = list(part.columns)
                if any(x is not None for x in changed):
                    old = part.column(at).to_pylist()
                    columns[at] = pa.array([x if new is None else new for x, new in zip(old, changed)], columns[at].type)
                    if length is not None:
                        old = part.column(length).to_pylist()
                        columns[length] = pa.array([x if new is None else len(new) for x, new in zip(old, changed)], columns[length].type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(keep)

    return docs.mapInArrow(clean, docs.schema)
