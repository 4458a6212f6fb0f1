"""Class-based n-gram language model: exchange clustering, class transitions, word emissions."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from runwise.session import scratch_path

#: The most frequent words, whose exchange clustering makes the CLASSES classes.
CLUSTERED, CLASSES = 1024, 64
#: All other words with this count or more are dealt to the classes.
LEAST_COUNT = 3
#: Added to the number of a dictionary word that is to be dealt.
DEALT = 1 << 16
#: The most frequent words, whose counts every worker holds; the others are joined.
DICTIONARY = 200_000
#: Classes of the words that are neither clustered nor dealt: by their last byte, and by length.
ENDS, SHAPES = (b".!?", b",;:", b"0123456789"), 10
END = ""  # no word is empty
PRIOR, PASSES = 0.5, 5
#: Distinct words that a task counts before it hands them on.
COUNTED_TOGETHER = 400_000


def _end_table() -> list[int]:
    table = [4 if c > 127 else 3 for c in range(256)]
    for c in range(97, 123):
        table[c] = 4
    for k, chars in enumerate(ENDS):
        for c in chars:
            table[c] = k
    return table


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or b"").lower().split()


def count_words(texts: DataFrame) -> DataFrame:
    """word, shape, n over the column ``text`` (as bytes) of all rows; the end of a text is a word."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = _end_table()

        def handed_on(c):
            words = list(c)
            shapes = [ends[w[-1]] * 2 + (len(w) > 8) if w else -1 for w in words]
            return pa.record_batch([pa.array(words, pa.binary()), pa.array(shapes, pa.int32()), pa.array(list(c.values()), pa.int64())],
                                   names=["word", "shape", "n"])

        c: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                c.update(words_of(text))
                c[b""] += 1
                if len(c) > COUNTED_TOGETHER:
                    yield handed_on(c)
                    c = Counter()
        if c:
            yield handed_on(c)

    return texts.select("text").mapInArrow(count, "word binary, shape int, n bigint").groupBy("word", "shape").agg(F.sum("n").alias("n"))


@dataclass
class Classes:
    """Numbers of words: those of ``known`` by rank, of all others by shape.

    ``plain`` is the first of the SHAPES numbers by shape; the end of a text follows them.
    """

    known: dict[bytes, int]  # rank
    of_rank: np.ndarray
    plain: int

    def __post_init__(self):
        self.end = self.plain + SHAPES
        self.size = self.end + 1
        self.ends = _end_table()

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ranks, -1 where ``known`` lacks the word, and numbers."""
        ranks = np.fromiter(map(self.known.get, words, _minus), np.int64, len(words))
        out = self.of_rank[ranks]  # the last one stands for -1
        for i in np.flatnonzero(ranks < 0).tolist():
            w = words[i]
            out[i] = self.plain + self.ends[w[-1]] * 2 + (len(w) > 8)
        return ranks, out


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The same as Spark's xxhash64 of binary values."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words)).view(np.int64)


class _Minus:
    def __iter__(self):
        return self

    def __next__(self):
        return -1


_minus = _Minus()


def count_pairs(lines, rows: DataFrame, size: int) -> np.ndarray:
    """How often number i is followed by number j in the lines that ``lines`` makes of each batch of ``rows``.

    A line is the numbers of a text with the end before and behind them.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            codes, held = [], 0
            for line in lines(batch):
                codes.append(line[:-1] * size + line[1:])
                held += len(line)
                if held > 1_000_000:
                    total += np.bincount(np.concatenate(codes), minlength=len(total))
                    codes, held = [], 0
            if codes:
                total += np.bincount(np.concatenate(codes), minlength=len(total))
        pair = np.flatnonzero(total)
        for i in range(0, len(pair), 100_000):
            p = pair[i : i + 100_000]
            yield pa.record_batch([pa.array(p), pa.array(total[p])], names=["pair", "n"])

    # size * size rows at most, whatever the input
    found = rows.mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    pairs = np.zeros(size * size)
    pairs[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return pairs.reshape(size, size)


def deal(texts: DataFrame, sent, pairs: np.ndarray, plain: int, least_count: int) -> DataFrame:
    """h, class: for the hash of each word to be dealt, the class that makes its occurrences likeliest.

    To be dealt are the dictionary's words whose number has DEALT added, and of those beyond it the
    ones that occur ``least_count`` times. ``pairs`` counts how classes follow each other. Words are
    counted with the classes on either side, and all move at once, by what precedes, what follows
    and the size of the class. Ties: the lower class.
    """
    size = len(pairs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, codes, beyond, held = sent.value, [], [], 0
        known = word_hashes(s.known)

        def handed_on():
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            h, c = (np.concatenate(x) for x in zip(*beyond))  # these hardly repeat
            return pa.record_batch([pa.array(np.concatenate([known[code // (2 * size)], h])),
                                    pa.array(np.concatenate([code % (2 * size), c]), pa.int32()),
                                    pa.array(np.concatenate([n, np.ones(len(h), np.int64)]))], names=["h", "code", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                ranks, numbers = s.of(words)
                line = np.concatenate([[s.end], numbers % DEALT, [s.end]])
                moves, others = np.flatnonzero(numbers >= DEALT), np.flatnonzero(ranks < 0)
                at, h = ranks[moves] * (2 * size), word_hashes([words[i] for i in others.tolist()])
                codes += [at + line[moves + 2], at + size + line[moves]]
                beyond += [(h, line[others + 2]), (h, size + line[others])]
                held += 2 * (len(moves) + len(others))
                if held > COUNTED_TOGETHER * 8:
                    yield handed_on()
                    codes, beyond, held = [], [], 0
        if held:
            yield handed_on()

    follows = np.log((pairs + PRIOR) / (pairs.sum(1, keepdims=True) + PRIOR * size))
    gains = np.concatenate([follows[:plain].T, follows[:, :plain]])  # [code, class]
    sizes = np.log(pairs.sum(0)[:plain] + 1)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2_000):
                part = batch.slice(k, 2_000)
                counts = np.zeros((part.num_rows, 2 * size))
                found = part.column(1)
                code, n = found.flatten().flatten()
                counts[np.repeat(np.arange(len(found)), found.value_lengths().to_numpy()), code.to_numpy()] = n.to_numpy()
                best = (counts @ gains - counts[:, :size].sum(1, keepdims=True) * sizes).argmax(1)
                yield pa.record_batch([part.column(0), pa.array(best, pa.int32())], names=["h", "class"])

    # tasks have summed what they hand on, and a word meets each class on either side, so its list is short
    sums = texts.select("text").mapInArrow(count, "h bigint, code int, n bigint").repartition("h").groupBy("h", "code").agg(F.sum("n").alias("n"))
    words = sums.groupBy("h").agg(F.collect_list(F.struct("code", "n")).alias("codes"), F.sum("n").alias("sides")).filter(
        F.col("sides") >= 2 * least_count)
    return words.select("h", "codes").mapInArrow(choose, "h bigint, class int")


def exchange(pairs: np.ndarray, clustered: int, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """The class of each symbol, by exchange clustering.

    Words in order of frequency go round to the classes; then each word in turn moves to the class
    that gives the corpus the highest likelihood under class bigrams, until a pass moves none or
    ``passes`` are over. Symbols that are not words keep a class of their own. Ties: the lower class.
    """
    size = len(pairs)
    classes = max(1, min(classes, clustered))
    of = np.concatenate([np.arange(clustered) % classes, classes + np.arange(size - clustered)]).astype(np.int64)
    k = classes + size - clustered
    onehot = np.zeros((size, k))
    onehot[np.arange(size), of] = 1
    right, left = pairs @ onehot, (onehot.T @ pairs).T  # of each symbol: to and from classes
    n = onehot.T @ right

    def f(x):
        return x * np.log(np.maximum(x, 1e-300))

    for _ in range(passes):
        moved = 0
        for w in range(clustered):
            a, own = of[w], pairs[w, w]
            r, l = right[w].copy(), left[w].copy()
            r[a] -= own
            l[a] -= own  # without the pair of w with itself
            n[a] -= r
            n[:, a] -= l
            n[a, a] -= own
            cols, rows = n.sum(0) + r, n.sum(1) + l  # what stands next to w counts, whatever the class of w
            c = np.arange(classes)
            gain = (f(n[:classes] + r) - f(n[:classes])).sum(1) + (f(n[:, :classes].T + l) - f(n[:, :classes].T)).sum(1)
            d = n[c, c]
            gain += f(d + r[:classes] + l[:classes] + own) - f(d + r[:classes]) - f(d + l[:classes]) + f(d)
            all_r, all_l = r.sum() + own, l.sum() + own
            gain -= f(rows[:classes] + all_r) - f(rows[:classes]) + f(cols[:classes] + all_l) - f(cols[:classes])
            best = int(gain.argmax())
            if gain[best] <= gain[a] + 1e-9:
                best = int(a)
            n[best] += r
            n[:, best] += l
            n[best, best] += own
            if best != a:
                moved += 1
                of[w] = best
                right[:, a] -= pairs[:, w]
                right[:, best] += pairs[:, w]
                left[:, a] -= pairs[w]
                left[:, best] += pairs[w]
        if not moved:
            break
    return of


@dataclass
class Vocabulary:
    """All words with their counts and classes as a table, and of these the dictionary that workers hold."""

    path: str  # Parquet of word, shape, n, class; of all words
    total: int
    distinct: int
    end_count: int
    words: Classes
    counts: np.ndarray  # by rank

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


@dataclass
class ClassModel:
    vocabulary: Vocabulary
    step: np.ndarray  # [i, j] of classes: log10 probability of j behind i, less j's emission denominator

    @property
    def total(self) -> int:
        return self.vocabulary.total

    @property
    def distinct(self) -> int:
        return self.vocabulary.distinct

    @property
    def classes(self) -> Classes:
        """All words with a learned class, on the driver: to look at small models. Neither fit nor score uses it."""
        plain = self.vocabulary.words.plain
        rows = self.vocabulary.read(SparkSession.active()).filter(F.col("class") < plain).select("word", "class").toArrow()
        return Classes({w: i for i, w in enumerate(rows["word"].to_pylist())}, np.append(rows["class"].to_numpy(), -1).astype(np.int64), plain)


def learn_classes(spark: SparkSession, texts: DataFrame, clustered: int = CLUSTERED, classes: int = CLASSES, dictionary: int = DICTIONARY,
                  least_count: int = LEAST_COUNT) -> Vocabulary:
    """Count the words of the column ``text`` (as bytes) of all rows and give them classes.

    The ``clustered`` most frequent words (ties: the lower word) found the classes by exchange; then
    all others of ``least_count`` or more are dealt to these classes, in parallel. The counts and
    classes of all words stay a table in the shared folder. The driver and the workers hold the pairs
    of classes and ``dictionary`` words at most, or ``clustered``, if that is more; all other words meet
    their counts and classes by joins.
    """
    path = scratch_path(spark, "vocabulary")
    count_words(texts).write.parquet(path)
    vocabulary = spark.read.parquet(path)
    shapes = vocabulary.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    total, distinct = sum(r["n"] for r in shapes), sum(r["v"] for r in shapes)
    ends = sum(r["n"] for r in shapes if r["shape"] < 0)
    real = vocabulary.filter("shape >= 0")
    head = real.orderBy(F.desc("n"), "word").limit(clustered).collect()
    first = [bytes(r["word"]) for r in head]
    clustered = len(head)

    founders = spark.sparkContext.broadcast(Classes({w: i for i, w in enumerate(first)}, np.append(np.arange(clustered), -1), clustered))

    def lines(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        s = founders.value
        for text in batch.column(0).to_pylist():
            yield np.concatenate([[s.end], s.of(words_of(text))[1], [s.end]])

    pairs = count_pairs(lines, texts.select("text"), clustered + SHAPES + 1)
    founders.destroy()
    of = exchange(pairs, clustered, classes)
    k = int(of.max()) + 1
    plain = k - SHAPES - 1
    onehot = np.zeros((len(of), k))
    onehot[np.arange(len(of)), of] = 1
    # the count from which words fit the dictionary, from the number of words by order of magnitude
    step = F.floor(F.log2("n") * 8)
    least, room = None, dictionary
    for r in real.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]

    def held(words: DataFrame) -> tuple[Classes, np.ndarray]:
        """The dictionary, clustered words first, with the column ``class``, and its counts."""
        top = words.filter("shape >= 0").filter(step >= F.lit(least)).select("word", "class", "n").toArrow()
        fixed = set(first)
        top = top.filter(pa.array([w not in fixed for w in top["word"].to_pylist()], pa.bool_()))
        names = first + top["word"].to_pylist()
        numbers = np.concatenate([of[:clustered], top["class"].to_numpy(), [-1]]).astype(np.int64)
        counts = np.concatenate([[r["n"] for r in head], top["n"].to_numpy()]).astype(np.int64)
        return Classes({w: i for i, w in enumerate(names)}, numbers, plain), counts

    moving = vocabulary.withColumn("class", (F.col("shape") + plain + F.when(F.col("n") >= least_count, DEALT).otherwise(0)).cast("int"))
    sent = spark.sparkContext.broadcast(held(moving)[0])
    dealt = deal(texts, sent, onehot.T @ pairs @ onehot, plain, least_count).withColumnsRenamed({"h": "d_h", "class": "d_class"})
    found = spark.createDataFrame([(w, int(c)) for w, c in zip(first, of)], "f_word binary, f_class int")  # ``clustered`` rows
    by_shape = F.when(F.col("shape") < 0, k - 1).otherwise(F.col("shape") + plain)
    path = scratch_path(spark, "classes")
    vocabulary.join(F.broadcast(found), F.col("word") == F.col("f_word"), "left").join(
        dealt.hint("merge"), F.when((F.col("shape") >= 0) & (F.col("n") >= least_count), F.xxhash64("word")) == F.col("d_h"), "left").select(
        "word", "shape", "n", F.coalesce("f_class", "d_class", by_shape).cast("int").alias("class")).write.parquet(path)
    sent.destroy()
    words, counts = held(spark.read.parquet(path))
    return Vocabulary(path, total, distinct, ends, words, counts)


def encode(spark: SparkSession, rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, training, n_tokens, n_known, logs, numbers (classes of the words, as bytes) for each row of doc_id, training, text.

    ``logs`` sums log10(count + 0.1) over the tokens. Words of the dictionary are looked up where the text
    is; the others go by themselves to a join with the vocabulary, none of them being frequent, and come
    back by row and place. The result is a table, so all that follows reads no text.
    """
    sent = spark.sparkContext.broadcast((vocabulary.words, vocabulary.counts))
    ends, kind = vocabulary.end_count, _kind(vocabulary.words.size)
    names = ("row", "place", "word", "doc_id", "training", "known", "logs", "numbers")
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.binary())

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        s, counts = sent.value
        log_count, log_end = np.append(np.log10(counts + 0.1), 0.0), math.log10(ends + 0.1)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: dict[str, list] = {k: [] for k in names}
            held = 0
            for i, training, t in zip(*(batch.column(c).to_pylist() for c in range(3))):
                words = words_of(t)
                ranks, numbers = s.of(words)
                beyond = np.flatnonzero(ranks < 0).tolist()
                out["row"] += [row] * (len(beyond) + 1)
                out["place"] += [-1, *beyond]
                out["word"].append(b"\n%d" % row)  # no word; it meets nothing, and all such rows don't meet in one task
                out["word"] += [words[j] for j in beyond]
                for c, v in (("doc_id", i), ("training", training), ("known", len(words) - len(beyond) + (ends > 0)),
                             ("logs", float(log_count[ranks].sum()) + log_end), ("numbers", numbers.astype(kind).tobytes())):
                    out[c].append(v)
                    out[c] += [None] * len(beyond)
                row += 1
                held += len(words)
                if held > 200_000:
                    yield _batch(out)
                    out, held = {k: [] for k in names}, 0
            if out["row"]:
                yield _batch(out)

    def _batch(out):
        return pa.record_batch([pa.array(out[k], t) for k, t in zip(names, kinds)], names=list(names))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, out, size = None, [], 0

        def done():
            d, t, n, *rest = zip(*out)
            return pa.record_batch([pa.array(x, y) for x, y in zip((d, t, n, *rest), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary()))],
                                   names=["doc_id", "training", "n_tokens", "n_known", "logs", "numbers"])

        def closed(o):
            return o[0], o[1], len(o[4]) + 1, o[2], o[3], o[4].tobytes()

        for batch in batches:
            place, n, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("place", "n", "class"))
            starts = np.flatnonzero(place < 0)
            logs = np.log10(n + 0.1)
            for k, (a, b) in enumerate(zip([0, *starts.tolist()], [*starts.tolist(), len(place)])):
                if k:  # the part before the first start belongs to the text that is open
                    if open_:
                        out.append(closed(open_))
                        size += len(out[-1][5])
                        if size > 4_000_000:
                            yield done()
                            out, size = [], 0
                    open_ = [*(batch.column(c)[a].as_py() for c in ("doc_id", "training", "known", "logs")),
                             np.frombuffer(batch.column("numbers")[a].as_py(), kind).copy()]
                    a += 1
                if a < b:
                    at, c = place[a:b], number[a:b]
                    open_[2] += int((n[a:b] > 0).sum())
                    open_[3] += float(logs[a:b].sum())
                    open_[4][at[c >= 0]] = c[c >= 0]
        if open_:
            out.append(closed(open_))
        if out:
            yield done()

    words = vocabulary.read(spark).select(F.col("word").alias("v_word"), "n", "class")
    parts = rows.select(F.col("doc_id").cast("bigint"), "training", F.col("text").cast("binary")).mapInArrow(
        local, "row bigint, place int, word binary, doc_id bigint, training boolean, known bigint, logs double, numbers binary")
    met = parts.join(words, F.col("word") == F.col("v_word"), "left").select(
        "row", "place", "doc_id", "training", "known", "logs", "numbers", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", F.lit(-1)).alias("class"))
    path = scratch_path(spark, "encoded")
    met.repartition("row").sortWithinPartitions("row", "place").mapInArrow(
        whole, "doc_id bigint, training boolean, n_tokens bigint, n_known bigint, logs double, numbers binary").write.parquet(path)
    sent.destroy()
    return spark.read.parquet(path)


def _kind(size: int):
    return np.uint8 if size <= 1 << 8 else np.uint16 if size <= 1 << 16 else np.uint32


def _lines(size: int):
    """From a batch of encoded texts to their numbers, the last one, the end, before and behind them."""
    kind, end = _kind(size), np.array([size - 1])

    def lines(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for numbers in batch.column("numbers").to_pylist():
            yield np.concatenate([end, np.frombuffer(numbers, kind), end]).astype(np.int64)

    return lines


def _model(spark: SparkSession, encoded: DataFrame, vocabulary: Vocabulary) -> ClassModel:
    """Transitions and emissions from the encoded training texts."""
    k = vocabulary.words.size
    n = count_pairs(_lines(k), encoded.filter("training").select("numbers"), k)
    transition = np.log10((n + PRIOR) / (n.sum(1, keepdims=True) + PRIOR * k))
    v, c = np.zeros(k), np.zeros(k)  # words of each class and their counts
    for r in vocabulary.read(spark).groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        v[r["class"]], c[r["class"]] = r["v"], r["n"]
    return ClassModel(vocabulary, transition - np.log10(c + 0.1 * (v + 1)))


def _scores(encoded: DataFrame, model: ClassModel) -> DataFrame:
    step, lines = model.step, _lines(len(model.step))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [float(step[line[:-1], line[1:]].sum()) for line in lines(batch)]
            yield pa.record_batch([*(batch.column(i) for i in range(5)), pa.array(sums, pa.float64())],
                                  names=["doc_id", "training", "n_tokens", "n_known", "logs", "steps"])

    denominator = math.log10(model.total + 0.1 * (model.distinct + 1))
    rows = encoded.select("doc_id", "training", "n_tokens", "n_known", "logs", "numbers").mapInArrow(
        steps, "doc_id bigint, training boolean, n_tokens bigint, n_known bigint, logs double, steps double")
    return rows.select("doc_id", "training", "n_tokens", "n_known", F.lit(model.total).cast("bigint").alias("train_tokens"),
                       (F.col("logs") - F.col("n_tokens") * denominator).alias("base_score"), (F.col("logs") + F.col("steps")).alias("score"))


def _rows(docs: DataFrame, doc_id, text, training) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(training, F.lit(False)).alias("training"), F.col(text).alias("text"))


def fit(spark: SparkSession, texts: DataFrame, clustered: int = CLUSTERED, classes: int = CLASSES, dictionary: int = DICTIONARY,
        least_count: int = LEAST_COUNT) -> ClassModel:
    """Learn from the column ``text`` (as bytes) of all rows, none of which may be left out; see ``learn_classes``.

    Null and empty texts have an end and no word, rows that repeat count each time, very long texts count
    whole, an empty table gives a model without words, and other columns play no part.
    """
    vocabulary = learn_classes(spark, texts, clustered, classes, dictionary, least_count)
    rows = texts.select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(True).alias("training"), "text")
    return _model(spark, encode(spark, rows, vocabulary), vocabulary)


def score(spark: SparkSession, docs: DataFrame, model: ClassModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``base_score`` is the unigram log10 probability with 0.1 added to each count, ``score`` that of
    the class model: class after class, and word by class. A null text is an empty one, which has
    one token, its end. Repeated rows and rows that share an id keep their own scores, null ids too. Very
    long texts are scored whole, an empty table gives an empty one, and other columns play no part. Words beyond
    the dictionary get their counts and classes by a join, so the model is the same however large it is.
    """
    return _scores(encode(spark, _rows(docs, doc_id, text, F.lit(False)), model.vocabulary), model).drop("training")


def fit_and_score(spark: SparkSession, docs: DataFrame, training, doc_id: str = "doc_id", text: str = "text", **kwargs) -> DataFrame:
    """The rows of ``score`` and the column training, by the model that ``fit`` learns from the rows where ``training`` holds.

    The same as ``fit`` and then ``score``, but words beyond the dictionary are joined once for both.
    """
    rows = _rows(docs, doc_id, text, training)
    vocabulary = learn_classes(spark, rows.filter("training").select(F.col("text").cast("binary").alias("text")), **kwargs)
    encoded = encode(spark, rows, vocabulary)
    return _scores(encoded, _model(spark, encoded, vocabulary))
