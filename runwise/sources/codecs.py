"""Event logs in the codecs that Spark writes and its JSON reader does not know, as lines.

Executors open each file and decode it piece by piece, so a log is never whole in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Suffixes that are decoded here; a compacted part has its codec before ``.compact``.
DECODED = ("lz4", "snappy", "zstd")
#: Files that one job decodes at a time at most; beyond that a task takes several.
MOST_TASKS = 10_000
LINES = "log_file string, log_at bigint, line string"


def codec_of(name: str) -> str | None:
    """The codec of a log by its file name, None if it is plain."""
    for end in (".compact", ".inprogress"):
        name = name.removesuffix(end)
    suffix = name.rpartition(".")[2]
    return suffix if suffix in (*DECODED, "lzf") and suffix != name else None


def _line_reader(resolve, lines_per_batch: int, bytes_per_batch: int):
    """The function the Python workers run; nested, so that it travels by value."""
    PIECE, ZSTD_PIECE = 1 << 20, 1 << 12

    class Truncated(Exception):
        """The file ends inside a block, as that of a running application does."""

    def exactly(source, n: int) -> bytes:
        data = source.read(n)
        if len(data) < n:
            raise Truncated
        return data

    def lz4(source) -> Iterator[bytes]:
        """Blocks of: magic, method, both sizes, checksum, data; an empty block ends a stream."""
        import pyarrow as pa

        codec = pa.Codec("lz4_raw")
        while head := source.read(21):
            if len(head) < 21:
                raise Truncated
            if head[:8] != b"LZ4Block":
                raise ValueError("not a block of an lz4 log")
            packed, size = (int.from_bytes(head[k : k + 4], "little") for k in (9, 13))
            data = exactly(source, packed)
            if size:
                yield data if head[8] & 0xF0 == 0x10 else codec.decompress(data, size).to_pybytes()

    def snappy(source) -> Iterator[bytes]:
        """A header of 16 bytes, then blocks with their packed size before them; streams may follow each other."""
        import pyarrow as pa

        codec, started = pa.Codec("snappy"), False
        while head := source.read(4):
            if len(head) < 4:
                raise Truncated
            if head == b"\x82SNA":
                started = exactly(source, 12)[:4] == b"PPY\0"
                continue
            if not started:
                raise ValueError("not a header of a snappy log")
            data = exactly(source, int.from_bytes(head, "big"))
            size, shift = 0, 0
            for byte in data[:5]:  # the unpacked size, seven bits to a byte, leads a block
                size |= (byte & 0x7F) << shift
                shift += 7
                if byte < 0x80:
                    break
            yield codec.decompress(data, size).to_pybytes()

    def zstd(source) -> Iterator[bytes]:
        import pyarrow as pa

        with pa.CompressedInputStream(source, "zstd") as stream:
            while True:
                try:
                    data = stream.read(ZSTD_PIECE)  # one that meets the end of a file cut short is lost
                except OSError as e:
                    if "runcated" in str(e):
                        raise Truncated from e
                    raise
                if not data:
                    return
                yield data

    def lines_of(path: str, codec: str) -> Iterator[bytes]:
        store, name = resolve(path)
        with store.open_input_stream(name, compression=None, buffer_size=PIECE) as source:
            rest: list[bytes] = []
            try:
                for piece in {"lz4": lz4, "snappy": snappy, "zstd": zstd}[codec](source):
                    first, *others = piece.split(b"\n")
                    rest.append(first)
                    if others:
                        yield b"".join(rest)
                        yield from others[:-1]
                        rest = [others[-1]]
            except Truncated:
                return
            if any(rest):
                yield b"".join(rest)

    def read(batches):
        import pyarrow as pa

        def done(path, start, lines):
            text = pa.array([x.decode("utf-8", "replace") for x in lines])
            return pa.record_batch([pa.array([path] * len(lines)), pa.array(range(start, start + len(lines)), pa.int64()), text],
                                   names=["log_file", "log_at", "line"])

        for batch in batches:
            for file, path, codec in zip(*(batch.column(c).to_pylist() for c in ("log_file", "path", "codec"))):
                lines, size, start = [], 0, 0
                for line in lines_of(path, codec):
                    lines.append(line)
                    size += len(line)
                    if size > bytes_per_batch or len(lines) >= lines_per_batch:
                        yield done(file, start, lines)
                        lines, size, start = [], 0, start + len(lines)
                if lines:
                    yield done(file, start, lines)

    return read


def decoded_lines(spark: SparkSession, files: list[tuple[str, str, str]], resolve, lines_per_batch: int = 5_000, bytes_per_batch: int = 8 << 20) -> DataFrame:
    """``(log_file, log_at, line)`` of ``files`` (name to show, path, codec), ``log_at`` counting a file's lines.

    A file that ends inside a block gives its whole lines, as logs of running applications do; one that is not of its
    codec fails the job. A file is decoded by one task, in order.
    """
    listed = spark.createDataFrame(files, "log_file string, path string, codec string").repartition(max(1, min(len(files), MOST_TASKS)))
    return listed.mapInArrow(_line_reader(resolve, lines_per_batch, bytes_per_batch), LINES)
