"""Token-id files: fixed-width bit packing with block offsets.

Every id takes the fewest bits that hold the vocabulary. A file is a sequence of
blocks in ascending id order and ends with an index of block offsets:

    block   header (magic, bits, documents, tokens, CRC-32 of what follows), null
            flags, document ids, token offset of each document within the block,
            packed ids, newline
    index   magic, number of blocks, (file offset, size, tokens, documents) of each,
            newline
    tail    magic, length of the index, newline

A reader needs only the tail and the index to reach any block, and within a
block a document's ids start at bit ``offset * bits``, so one document or a whole
block unpacks with numpy alone. `RemoteFile` does so on any file system that Spark
reaches: it reads the tail, the index, and then the blocks that are asked for.

Spark's own writer and commit protocol write the files: a lost executor leaves no
partial file, and any file system that Spark reaches will do. Documents are
dealt by ranges of (doc_id, row) into as many files as the texts fill, each of
about ``FILE_BYTES`` of text, so that a task that reads one whole holds a bounded
file, and even rows that share one id spread over files. Only texts are shuffled,
once. (The writer of lines gets the blocks as strings that nobody decodes; the
checksums tell if any layer ever changes a byte.)

Edge cases: null text is empty and holds the end id alone; a null doc_id sorts
first and is kept; repeated rows are each written, in an arbitrary order among
themselves; a document longer than a block has a block of its own, and one longer
than a file a file of its own; an empty table gives no rows; columns other than
the id and text are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.llm.bpe import VOCABULARY, encoder
from sieveline.llm.common import new_path, persist, quoted, small_batches, table, text_or_empty

BLOCK_TOKENS = 65_536
FILE_BYTES = 32 << 20
"""Bytes of text that go to one file, which takes three quarters of that at most in ordinary prose."""
END_ID = 2

_HEAD = struct.Struct("<4sIQQI")
_INDEX = struct.Struct("<4sQ")
_TAIL = struct.Struct("<4sQ")
_BLOCK, _INDEX_MAGIC, _TAIL_MAGIC = b"TKB1", b"TKI1", b"TKT1"


def bits_for(vocabulary_size: int) -> int:
    """Fewest bits that tell ``vocabulary_size`` ids apart."""
    return max(1, (max(vocabulary_size, 1) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive ``bits``-wide big-endian fields, padded to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    fields = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(fields[:, 32 - bits :]).tobytes()


def unpack(data: bytes | memoryview, bits: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from the field ``start`` on."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", count, start * bits // 8).astype("<u4")
    first, last = start * bits // 8, -(-(start + count) * bits // 8)
    field = np.unpackbits(np.frombuffer(data, np.uint8, last - first, first))
    skip = start * bits - first * 8
    wide = np.zeros((count, 32), np.uint8)
    wide[:, 32 - bits :] = field[skip : skip + count * bits].reshape(count, bits)
    return np.packbits(wide).view(">u4").astype("<u4")


def block_bytes(doc_ids: list[int | None], runs: list[np.ndarray], bits: int) -> bytes:
    """One block; ``runs`` holds each document's ids."""
    offsets = np.cumsum([0] + [len(r) for r in runs], dtype="<u8")
    flags = np.array([d is None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    ids = np.concatenate(runs)
    body = flags.tobytes() + numbers.tobytes() + offsets.tobytes() + pack(ids, bits)
    return _HEAD.pack(_BLOCK, bits, len(doc_ids), len(ids), zlib.crc32(body)) + body


class Block:
    """A view of one block's bytes."""

    def __init__(self, data: bytes | memoryview):
        magic, self.bits, n, self.tokens, checksum = _HEAD.unpack_from(data)
        at = _HEAD.size
        size = at + 9 * n + 8 * (n + 1) + -(-self.tokens * self.bits // 8)
        if magic != _BLOCK or zlib.crc32(data[at:size]) != checksum:
            raise ValueError("not a block, or not as it was written")
        flags = np.frombuffer(data, np.uint8, n, at)
        numbers = np.frombuffer(data, "<i8", n, at + n)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at + 9 * n)
        self.doc_ids = [None if f else int(d) for f, d in zip(flags, numbers)]
        self.payload = data[at + 9 * n + 8 * (n + 1) : size]

    def ids(self, k: int | None = None) -> np.ndarray:
        """Ids of document ``k``, or of the whole block."""
        if k is None:
            return unpack(self.payload, self.bits, 0, self.tokens)
        start, end = int(self.offsets[k]), int(self.offsets[k + 1])
        return unpack(self.payload, self.bits, start, end - start)


def read_index(tail: bytes | memoryview, ranged) -> np.ndarray:
    """Rows (offset, size, tokens, documents) of a file's blocks. ``ranged(size)`` reads that many bytes before the tail."""
    magic, length = _TAIL.unpack_from(tail, 0)
    if magic != _TAIL_MAGIC:
        raise ValueError("no index at the end of the file")
    data = ranged(length)
    magic, n = _INDEX.unpack_from(data, 0)
    if magic != _INDEX_MAGIC:
        raise ValueError("no index at the end of the file")
    return np.frombuffer(data, "<u8", 4 * n, _INDEX.size).reshape(n, 4).astype(np.int64)


class TokenFile:
    """Random access to the blocks of a file that is held as a whole."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        end = len(data) - _TAIL.size - 1
        self.index = read_index(self.data[end:], lambda length: self.data[end - length : end])
        self.tokens = int(self.index[:, 2].sum())

    def __len__(self) -> int:
        return len(self.index)

    def block(self, k: int) -> Block:
        return Block(self.data[self.index[k, 0] : self.index[k, :2].sum()])


class RemoteFile:
    """Random access to the blocks of a file on any file system of Spark's, by ranged reads on the driver."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._copy = jvm.org.apache.commons.io.IOUtils.toByteArray
        self._open = lambda: fs.open(place)
        end = fs.getFileStatus(place).getLen() - _TAIL.size - 1
        self.index = read_index(self.read(end, _TAIL.size), lambda length: self.read(end - length, length))

    def __len__(self) -> int:
        return len(self.index)

    def read(self, start: int, size: int) -> bytes:
        stream = self._open()
        try:
            stream.seek(int(start))
            return bytes(self._copy(stream, int(size)))
        finally:
            stream.close()

    def block(self, k: int) -> Block:
        return Block(self.read(*self.index[k, :2].tolist()))


def file_lines(rows: Iterator[tuple[int | None, np.ndarray]], bits: int, block_tokens: int) -> Iterator[bytes]:
    """The pieces of one file, each to be followed by a newline. No rows, no pieces."""
    at, index, doc_ids, runs, held = 0, [], [], [], 0

    def close() -> bytes:
        nonlocal at, held
        data = block_bytes(doc_ids, runs, bits)
        index.append((at, len(data), held, len(doc_ids)))
        at += len(data) + 1
        doc_ids.clear()
        runs.clear()
        held = 0
        return data

    for doc_id, ids in rows:
        doc_ids.append(doc_id)
        runs.append(ids)
        held += len(ids)
        if held >= block_tokens:
            yield close()
    if doc_ids:
        yield close()
    if index:
        data = _INDEX.pack(_INDEX_MAGIC, len(index)) + np.array(index, "<u8").tobytes()
        yield data
        yield _TAIL.pack(_TAIL_MAGIC, len(data) + 1)


def write_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int | None = END_ID, block_tokens: int = BLOCK_TOKENS, file_bytes: int = FILE_BYTES) -> None:
    """Encode every document and write the files to the folder ``path``."""
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text_or_empty(text_col)).cast("long"))).first()[0] or 0
    files = max(1, -(-size // file_bytes))
    tail = np.array([] if end_id is None else [end_id], "<u4")

    def run(batches):
        codec = encoder(vocabulary, "library")

        def rows():
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), codec.each_in_pieces(batch.column(1))):
                    yield doc_id, np.concatenate([*ids, tail])  # of a long text only the ids are held, 4 bytes each

        for line in file_lines(rows(), bits_for(codec.v.size), block_tokens):
            yield pa.RecordBatch.from_arrays([pa.array([line], pa.binary())], ["line"])

    dealt = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), text_or_empty(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    dealt = dealt.repartitionByRange(files, "id", "row").sortWithinPartitions("id", "row").select("id", "text")
    dealt.mapInArrow(run, "line binary").select(F.col("line").cast("string").alias("value")).write.text(path, lineSep="\n")


def read_files(spark: SparkSession, path: str, digests: bool = True) -> DataFrame:
    """Per document: file_no, doc_id, start within the file, n_tokens, and crc32 or the ids."""
    small_batches(spark)
    number = F.regexp_extract(F.substring_index("path", "/", -1), r"^part-(\d+)", 1).cast("long")
    files = spark.read.format("binaryFile").load(path).select(number.alias("file_no"), "content")
    schema = "file_no long, doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digests else "ids array<long>")

    def run(batches):
        for batch in batches:
            for file_no, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                if not data:
                    continue
                file, at = TokenFile(data), 0
                for k in range(len(file)):
                    block = file.block(k)
                    raw, offsets = block.ids(), block.offsets.astype(np.int64)
                    counts = np.diff(offsets)
                    each = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                    last = pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64()) if digests else pa.array(each, pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(counts), file_no, np.int64)), pa.array(block.doc_ids, pa.int64()), pa.array(offsets[:-1] + at), pa.array(counts), last],
                        ["file_no", "doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"],
                    )
                    at += block.tokens

    return files.mapInArrow(run, schema)


def with_global_starts(read: DataFrame) -> DataFrame:
    """Turn starts within a file into starts over all files, in file order.

    The running total goes over one row for each file, not over documents.
    """
    read = persist(read, "token-files-read")
    totals = read.groupBy("file_no").agg(F.sum("n_tokens").alias("__tokens"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file_no", F.coalesce(F.sum("__tokens").over(before), F.lit(0)).alias("__before"))
    return read.join(totals, "file_no").withColumn("start", F.col("start") + F.col("__before")).drop("__before")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of every document and read them back."""
    path = new_path(spark, "token-files")
    write_files(table(spark, sf_dir, "documents", "doc_id", "text"), path)
    return with_global_starts(read_files(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
