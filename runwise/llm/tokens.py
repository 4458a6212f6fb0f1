"""Token ids as Arrow files of equal-length sequences, written and read by executors."""

from __future__ import annotations

import re
import sys
import types
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from runwise.sources.files import resolver, store_options

#: A place after a letter and before a mark, and any place between other characters and white
#: space, is a border of the tokenizer's own pieces, whatever stands around it.
PIECES = re.compile(r"\s*[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\s.,!]|\Z)|\s*\S+|\s+")
#: Characters that are white space to Python and not to the tokenizer.
UNSURE = re.compile("[\x1c-\x1f]")
#: Characters that a call to the tokenizer gets, and pieces, and characters of them, that a worker remembers, at most.
CALL_CHARS, REMEMBERED, REMEMBERED_CHARS = 1_000_000, 1_000_000, 32_000_000
INDEX = "doc_id bigint, shard int, start bigint, n_tokens bigint"


class Encoder:
    """A tokenizer that remembers the ids of pieces, as bytes of ``dtype``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.known_chars = 0

    @classmethod
    def of_worker(cls, path: str) -> Encoder:
        """The one of this worker process, which serves one task after another."""
        kept = sys.modules.setdefault("_token_encoders", types.ModuleType("_token_encoders")).__dict__
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, the same as of the tokenizer on whole texts."""
        known = self.known
        if len(known) > REMEMBERED or self.known_chars > REMEMBERED_CHARS:
            known.clear()
            self.known_chars = 0
        split = [None if UNSURE.search(x) else PIECES.findall(x) for x in texts]
        new, size = [], 0
        for p in dict.fromkeys(p for x in split if x for p in x if p not in known):
            new.append(p)
            size += len(p)
            self.known_chars += len(p)
            if size > CALL_CHARS:
                known.update(zip(new, self._encode(new)))
                new, size = [], 0
        if new:
            known.update(zip(new, self._encode(new)))
        get = known.__getitem__
        return [b"".join(map(get, x)) if x is not None else self._encode([t])[0] for t, x in zip(texts, split)]


def shard_name(path: str, shard: int) -> str:
    return f"{path.rstrip('/')}/{shard:06d}.arrow"


class ShardWriter:
    """One Arrow file: record batches of ``rows`` sequences of ``length`` ids, with a mask of the real ones.

    Every batch but the last has the same size, and every sequence the same length, so position
    ``i`` of the shard is in batch ``i // (rows * length)`` at ``i % (rows * length)``. The ids use
    the narrowest type for the vocabulary. A reader maps the file and takes slices without a copy.
    The file gets its name when it is complete, so that a lost task leaves none.
    """

    def __init__(self, path: str, dtype: np.dtype, length: int, rows: int, resolve=None):
        self.fs, self.name = (resolve or resolver())(path)
        context = TaskContext.get()
        self.draft = f"{self.name}.{context.taskAttemptId() if context else 0}.draft"
        self.fs.create_dir(self.name.rpartition("/")[0], recursive=True)
        self.length, self.rows, self.dtype, self.buffer = length, rows, dtype, bytearray()
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = self.fs.open_output_stream(self.draft)
        self.file = pa.ipc.new_file(self.out, self.schema)

    def add(self, ids: bytes) -> None:
        self.buffer += ids
        step = self.length * self.rows * self.dtype.itemsize
        while len(self.buffer) >= step:
            self._batch(np.frombuffer(bytes(self.buffer[:step]), self.dtype), self.length * self.rows)
            del self.buffer[:step]

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        self.file.write_batch(pa.record_batch(
            [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(mask, self.length)],
            schema=self.schema))

    def close(self) -> None:
        if self.buffer:
            ids = np.frombuffer(bytes(self.buffer), self.dtype)
            self._batch(np.concatenate([ids, np.zeros(-len(ids) % self.length, self.dtype)]), len(ids))
        self.file.close()
        self.out.close()
        self.fs.move(self.draft, self.name)


class Shard:
    """Random access to the ids of a shard; local files are mapped and not read."""

    def __init__(self, path: str, resolve=None):
        from pyarrow import fs

        store, name = (resolve or resolver())(path)
        self.source = pa.memory_map(name) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(name)
        self.file = pa.ipc.open_file(self.source)
        self.at, self.ids = -1, np.array([])
        self.step = len(self._of(0)) if self.file.num_record_batches else 0

    def _of(self, k: int) -> np.ndarray:
        if k != self.at:
            self.at, self.ids = k, self.file.get_batch(k).column(0).values.to_numpy()
        return self.ids

    def sequence(self, i: int) -> np.ndarray:
        """The ids of sequence ``i``."""
        length = self.file.schema.field("ids").type.list_size
        return self.slice(i * length, length)

    def slice(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from position ``start``: a view, unless they are in more than one batch."""
        parts, end = [], start + n
        while start < end:
            k, i = divmod(start, self.step)
            parts.append(self._of(k)[i : i + end - start])
            start += len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.array([], np.uint16)])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0,
                 length: int = 2048, rows: int = 256, order: Sequence[Column] = (), filesystem=None) -> DataFrame:
    """Encode all texts, in ascending order of the id or of the columns ``order``, into the Arrow shards below ``path``.

    Returns doc_id, shard, start (in the shard) and n_tokens (with ``end_id``, which ends each
    document) per row of ``docs``; the files are written as that result is, so write it. Shard by
    shard the files hold one long run of ids; documents may cross sequences but no shards, and each
    shard's last sequence is padded and masked. A null text is an empty one; null ids come first;
    rows that share an id, or a place in ``order``, follow each other by a hash of the text. ``docs`` may be empty: no shard.
    ``path`` must be a folder that all executors share: of a file system they mount, or of a store, which they open with the
    session's options, or as the pyarrow ``filesystem``. Texts are encoded whole, whatever their length; a call to the
    tokenizer takes some of them, and what a worker remembers is bounded by number and by size. Other columns play no part.
    """
    resolve = resolver(store_options(docs.sparkSession), filesystem)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, writer, at = Encoder.of_worker(tokenizer), None, 0
        shard, end = TaskContext.get().partitionId(), np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                if not part.num_rows:
                    continue
                writer = writer or ShardWriter(shard_name(path, shard), encoder.dtype, length, rows, resolve)
                starts, sizes = [], []
                for ids in encoder.encode([x or "" for x in part.column(1).to_pylist()]):
                    writer.add(ids + end)
                    starts.append(at)
                    sizes.append(len(ids) // encoder.dtype.itemsize + 1)
                    at += sizes[-1]
                yield pa.record_batch([part.column(0), pa.array([shard] * len(starts), pa.int32()),
                                       pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())],
                                      names=["doc_id", "shard", "start", "n_tokens"])
        if writer:
            writer.close()

    # the last two keep rows of one id in order, and spread them where they are many
    places = {f"place{k}": c for k, c in enumerate(order)}
    by = [F.col(c) for c in places or ("doc_id",)] + [F.xxhash64("text"), F.col("row")]
    rows_ = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"),
                        F.monotonically_increasing_id().alias("row"), *(c.alias(k) for k, c in places.items()))
    return rows_.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text").mapInArrow(encode, INDEX)


def with_starts(index: DataFrame) -> DataFrame:
    """``index`` with ``start`` counted over all shards, and the place in the shard as ``shard_start``."""
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select(
        F.col("shard").alias("t_shard"),
        F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return index.join(totals, F.col("shard") == F.col("t_shard")).select(
        "doc_id", "shard", F.col("start").alias("shard_start"), (F.col("before") + F.col("start")).alias("start"), "n_tokens")


def read_documents(index: DataFrame, path: str, filesystem=None) -> DataFrame:
    """Per row of ``with_starts``: doc_id, start, n_tokens and ids_crc32, from the ids in the files."""
    resolve = resolver(store_options(index.sparkSession), filesystem)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            sums = []
            for number, start, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "shard_start", "n_tokens"))):
                if number != at:
                    at, shard = number, Shard(shard_name(path, number), resolve)
                sums.append(zlib.crc32(shard.slice(start, n).astype("<u4").tobytes()))
            yield pa.record_batch([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())],
                                  names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = index.select("shard", "shard_start", "doc_id", "start", "n_tokens")
    return placed.repartition("shard").sortWithinPartitions("shard", "shard_start").mapInArrow(
        read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
