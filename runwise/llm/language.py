"""Language identification by bit-sliced Bloom filters of n-grams.

One table of slots serves all languages: bit ``l`` of a slot belongs to the filter of language
``l``, so the slots of an n-gram, combined with AND, name all languages whose filter holds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Bytes of an n-gram; slots of a filter (its size, whatever the input); two slots per n-gram.
N, SLOTS = 4, 1 << 21
HASHES = (1_640_531_527, 2_043_128_591)
#: An n-gram belongs to the languages that use it at least this share as often as the one that uses it most.
SHARE = 0.3
#: Everything in ASCII but letters separates words.
TO_SPACE = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(TO_SPACE)


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts as numbers, which of them count, and where each text starts.

    Windows with two spaces in a row, which are all those between texts, don't count.
    """
    a = np.frombuffer(b"".join(b"  " + x + b"  " for x in texts), np.uint8)
    starts = np.cumsum([0] + [len(x) + 4 for x in texts[:-1]]) if texts else np.array([], np.int64)
    code = a[: 1 - N].astype(np.uint32)
    for i in range(1, N):
        code |= a[i : len(a) - N + 1 + i].astype(np.uint32) << np.uint32(8 * i)
    gap = (a[:-1] == 32) & (a[1:] == 32)
    counts = ~(gap[: 2 - N] | gap[1 : 3 - N if N > 3 else None] | gap[N - 2 :])
    return code, counts, starts


def slots(gram: np.ndarray) -> list[np.ndarray]:
    g = gram.astype(np.uint64)
    return [((g * np.uint64(h)) >> np.uint64(21)) & np.uint64(SLOTS - 1) for h in HASHES]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            by_lang.setdefault(lang, []).append(_bytes(text))
        for lang, texts in by_lang.items():
            code, counts, _ = ngrams(texts)
            gram, n = np.unique(code[counts], return_counts=True)
            yield pa.record_batch([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))],
                                  names=["lang", "gram", "n"])


@dataclass
class LanguageFilters:
    """``langs`` in order; ``table`` has SLOTS rows of 64-bit words, bit ``l % 64`` of word ``l // 64`` for language ``l``."""

    langs: list[str]
    table: np.ndarray
    usual: str

    def __post_init__(self):
        set_bits = [(self.table[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(self.langs))]
        #: The chance that a foreign n-gram finds all its slots set.
        self.false_positive = np.array(set_bits) ** len(HASHES)

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the n-grams, and per language those that its filter holds less those expected by chance."""
        code, counts, starts = ngrams([_bytes(x or "") for x in texts])
        one, two = slots(code)
        hits = np.zeros((len(texts), len(self.langs)))
        starts = np.minimum(starts, max(0, len(code) - 1))
        n = np.add.reduceat(counts.astype(np.int64), starts)
        for w in range(self.table.shape[1]):
            mask = self.table[one, w] & self.table[two, w]
            mask[~counts] = 0
            for l in range(64 * w, min(64 * w + 64, len(self.langs))):
                hits[:, l] = np.add.reduceat((mask >> np.uint64(l % 64)) & np.uint64(1), starts)
        fp = np.minimum(self.false_positive, 0.999)
        return n, np.maximum(0.0, (hits - n[:, None] * fp) / (1 - fp))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not texts:
            return [], []
        n, held = self.scores(texts)
        langs, scores = [], []
        for text, row in zip(texts, held):
            # number signs, such as fractions and Roman numerals, are no letters
            if text is None or not any(map(str.isalpha, text)) or not self.langs:
                langs.append("und")
                scores.append(0.0)
                continue
            total, best = row.sum(), int(row.argmax())
            langs.append(self.langs[best] if total > 0 else self.usual)
            scores.append(float(min(1.0, row[best] / total)) if total > 0 else 0.0)
        return langs, scores


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", share: float = SHARE, least: int = 2) -> LanguageFilters:
    """Filters of all languages in ``labelled``; rows without language or text are left out.

    The n-grams of all texts are counted. What reaches the driver is the list of languages and the
    table of the filters, whose size is fixed for every 64 languages: there must be few enough for a task to hold it.
    Repeated rows count as often as they are there. An empty table, or one without languages, teaches none. Texts
    count whole, whatever their length, and other columns play no part.
    """
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).dropna()
    counts = rows.mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # one row per n-gram, whose list is no longer than the languages are
    by_gram = counts.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("uses"))
    totals = {r["lang"]: (r["n"], r["docs"]) for r in rows.groupBy("lang").agg(
        F.sum(F.length("text")).alias("n"), F.count("*").alias("docs")).collect()}
    langs = sorted(totals)
    usual = max(langs, key=lambda x: (totals[x][1], x), default="und")
    words = max(1, -(-len(langs) // 64))
    filters = np.zeros((SLOTS, words), np.uint64)
    if not langs:
        return LanguageFilters(langs, filters, usual)
    total = F.create_map(*[F.lit(v) for x in langs for v in (x, float(totals[x][0] or 1))])
    number = F.create_map(*[F.lit(v) for i, x in enumerate(langs) for v in (x, i)])
    rates = F.transform("uses", lambda u: F.struct(number[u["lang"]].alias("l"), u["n"].alias("n"), (u["n"] / total[u["lang"]]).alias("rate")))
    most = F.array_max(F.transform("rates", lambda u: u["rate"]))
    held = (
        by_gram.select("gram", rates.alias("rates")).select("gram", "rates", most.alias("most"))
        .select("gram", "most", F.explode("rates").alias("u"))
        .filter((F.col("u.n") >= least) & (F.col("u.rate") >= share * F.col("most")))
        .select(F.explode(F.array(*[F.shiftrightunsigned(F.col("gram") * h, 21).bitwiseAND(SLOTS - 1) for h in HASHES])).alias("slot"), "u.l")
        .groupBy("slot", F.floor(F.col("l") / 64).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(l % 64 as int))")).alias("bits"))
    ).toPandas()
    filters[held["slot"].to_numpy(), held["word"].to_numpy()] = held["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return LanguageFilters(langs, filters, usual)


def identify(docs: DataFrame, model: LanguageFilters, text: str = "text") -> Column:
    """A struct (lang_pred, score) for the text column.

    ``und`` with score 0 where the text is null or has no letter, or no language was learned. A
    text none of whose n-grams is known gets the most frequent language and score 0. The first of
    equal languages in order wins. The whole text counts, whatever its length, and nothing but the text. Repeated rows
    are judged alike, and an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.table, model.usual))

    @F.pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        filters = LanguageFilters(*sent.value)
        for texts in batches:
            found: tuple[list, list] = ([], [])
            texts = texts.tolist()
            for i in range(0, len(texts), 1000):
                for all_, some in zip(found, filters.predict(texts[i : i + 1000])):
                    all_.extend(some)
            yield pd.DataFrame({"lang_pred": pd.Series(found[0], dtype=object), "score": pd.Series(found[1], dtype=float)})

    return judge(F.col(text))
