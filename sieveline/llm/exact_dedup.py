"""Exact duplicates by composable polynomial fingerprints.

A text's bytes are the coefficients of a polynomial, evaluated modulo two primes.
Spark cuts texts into chunks before they reach Python. A chunk is a row of its own
that knows its place, so it hashes alone, in any order and on any machine:
hash(ab) = hash(a) * base^len(b) + hash(b), and a chunk's share of the whole is its
hash times the base to the number of bytes behind it. A sum by document, partial
sums first, makes the fingerprint. The chunks of documents beyond ``apart`` bytes
are dealt over all tasks.

Equal fingerprints only propose copies. The chunks of every proposed group are
then compared byte for byte: a group is one text exactly when the least and the
greatest chunk at every position are the same. Least and greatest combine before
the shuffle, so a group that holds a third of all rows sends one chunk for each
task and position. Groups that fail (a collision of fingerprints) are told apart
by SHA-256. Whether a text's group is proposed is known only once it is hashed: of
a text of more than ``HELD`` chunks they pass twice, first to hash and then to be
sent, so a worker never holds more than that.

Edge cases: null text is empty, and all empty texts are copies of each other;
rows repeated under one id are copies like others, and one of them stays; a null
id stays only where no copy has an id; an empty table gives no rows; columns
other than the id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import ROW_KEY, persist, release, restored, small_batches, table, with_row_key

CHUNK = 65_536
HELD = 16
"""Most chunks of one text that a worker holds."""
APART = 32 << 20
"""Bytes beyond which the chunks of one text hash in different tasks."""
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_181_783_497, 914_709_557)
FILTER_BITS = 1 << 26
"""Most bits of the broadcast filter of proposed groups: 8 MB at any input size."""

KEY = ["h1", "h2", "n_bytes"]


@dataclass(frozen=True)
class Fingerprint:
    """Hashes modulo both primes and the length; ``+`` appends."""

    h1: int = 0
    h2: int = 0
    length: int = 0

    def append(self, other: Fingerprint, primes: tuple[int, int] = PRIMES) -> Fingerprint:
        shift = [pow(b, other.length, p) for b, p in zip(BASES, primes)]
        return Fingerprint((self.h1 * shift[0] + other.h1) % primes[0], (self.h2 * shift[1] + other.h2) % primes[1], self.length + other.length)

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return self.append(other)


class ChunkHasher:
    """Fingerprints of byte chunks of at most ``size``, by dot products with powers of the bases."""

    def __init__(self, size: int = CHUNK, primes: tuple[int, int] = PRIMES):
        self.primes = primes
        self.powers = []
        for base, prime in zip(BASES, primes):
            powers, x = [], 1
            for _ in range(size):
                powers.append(x)
                x = x * base % prime
            self.powers.append(np.array(powers[::-1], np.uint64))

    def shares(self, data, behind: int) -> tuple[int, int]:
        """What a chunk with ``behind`` bytes after it adds to both hashes of its text."""
        own = self(data)
        return tuple(h * pow(b, behind, p) % p for h, b, p in zip((own.h1, own.h2), BASES, self.primes))

    def __call__(self, data) -> Fingerprint:
        values = np.frombuffer(data, np.uint8).astype(np.uint64)
        n = len(values)
        # 2^16 terms of 8 + 31 bits stay below 2^64.
        h1, h2 = (int(values @ p[len(p) - n :]) % prime if n else 0 for p, prime in zip(self.powers, self.primes))
        return Fingerprint(h1, h2, n)


def chunks(rows: DataFrame, keep: list[str], size: int, held: int | None = None) -> DataFrame:
    """``keep`` of rows with a text, and one row for each chunk: n_bytes, n_chunks, at, chunk. In order, narrow.

    Of texts with more than ``held`` chunks they come twice, with ``at`` counting on.
    """
    data = rows.select(*keep, F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    sized = data.select("*", F.octet_length("data").cast("long").alias("n_bytes"))
    counted = sized.select("*", F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / size)).cast("int").alias("n_chunks"))
    last = F.col("n_chunks") - 1
    if held is not None:
        last = F.when(F.col("n_chunks") > held, 2 * F.col("n_chunks") - 1).otherwise(last)
    each = counted.select("*", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    chunk = F.substring("data", (F.col("at") % F.col("n_chunks")) * size + 1, F.lit(size))
    return each.select(*keep, "n_bytes", "n_chunks", "at", chunk.alias("chunk"))


def _summed(cut: DataFrame, keep: list[str], size: int, primes: tuple[int, int]) -> DataFrame:
    """``keep``, h1, h2 and n_bytes of every text from its chunks, in whatever order and tasks they are."""
    width = len(keep)
    kinds = dict(cut.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in keep) + ", n_bytes long, h1 long, h2 long"

    def run(batches):
        hasher = ChunkHasher(size, primes)
        for batch in batches:
            places = zip(batch.column(width).to_pylist(), batch.column(width + 2).to_pylist(), batch.column(width + 3))
            shares = [hasher.shares(chunk.as_buffer(), max(0, n - (at + 1) * size)) for n, at, chunk in places]
            columns = [pa.array([s[k] for s in shares], pa.int64()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: width + 1], *columns], [*keep, "n_bytes", "h1", "h2"])

    hashed = cut.mapInArrow(run, schema).groupBy(*keep, "n_bytes").agg(F.sum("h1").alias("h1"), F.sum("h2").alias("h2"))
    return hashed.select(*keep, "n_bytes", *[(F.col(f"h{k + 1}") % p).alias(f"h{k + 1}") for k, p in enumerate(primes)])


def fingerprinted(rows: DataFrame, keep: list[str], size: int = CHUNK, primes: tuple[int, int] = PRIMES, apart: int = APART) -> DataFrame:
    """``keep``, h1, h2, n_bytes and text_sha256 of rows with a text and the row key in ``keep``; written."""
    small_batches(rows.sparkSession)
    digested = rows.select(*keep, F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "text")
    names = [*keep, "text_sha256"]
    cut = chunks(digested, names, size)
    # One empty row stands for a text whose chunks are dealt out below.
    here = cut.where((F.col("n_bytes") <= apart) | (F.col("at") == 0)).withColumn("chunk", F.when(F.col("n_bytes") <= apart, F.col("chunk")).otherwise(F.lit("").cast("binary")))
    whole = persist(_summed(here, names, size, primes), "fingerprints")
    if whole.where(F.col("n_bytes") > apart).isEmpty():
        return whole
    huge = chunks(digested.where(F.octet_length("text") > apart), names, size)
    dealt = _summed(huge.repartition(*ROW_KEY, "at"), names, size, primes)
    both = persist(whole.where(F.col("n_bytes") <= apart).unionByName(dealt), "fingerprints")
    release(whole)
    return both


def group_filter(groups: DataFrame, limit: int = FILTER_BITS) -> np.ndarray:
    """A bit for each proposed group, by h2. Of fixed greatest size; it only saves shuffling."""
    bits = 1 << 16
    n = groups.count()
    while bits < min(limit, 16 * n):
        bits *= 2
    place = F.col("h2").bitwiseAND(F.lit(bits - 1))
    words = groups.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((h2 & {bits - 1}) & 63 as int))")).alias("word")).collect()
    out = np.zeros(bits // 64, np.uint64)
    for row in words:
        out[row["at"]] = row["word"] & 0xFFFFFFFFFFFFFFFF
    return out


def disagreeing(rows: DataFrame, groups: DataFrame, size: int = CHUNK, primes: tuple[int, int] = PRIMES, held: int = HELD) -> DataFrame:
    """Keys of proposed groups whose texts are not all the same, by chunkwise comparison."""
    spark = rows.sparkSession
    small_batches(spark)
    known = spark.sparkContext.broadcast(group_filter(groups))

    def run(batches):
        hasher, words = ChunkHasher(size, primes), known.value
        mask = np.uint64(64 * len(words) - 1)
        h1 = h2 = 0
        parts: list[bytes] = []
        wanted = False
        for batch in batches:
            out: list[tuple] = []
            for n, count, at, chunk in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                if at == 0:
                    h1, h2, parts = 0, 0, []
                if at < count:
                    share = hasher.shares(chunk.as_buffer(), max(0, n - (at + 1) * size))
                    h1, h2 = (h1 + share[0]) % primes[0], (h2 + share[1]) % primes[1]
                    if count <= held:
                        parts.append(chunk.as_py())
                    if at == count - 1:
                        place = np.uint64(h2) & mask
                        wanted = bool(words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1))
                        if wanted:
                            out += [(h1, h2, n, k, part) for k, part in enumerate(parts)]
                elif wanted:
                    out.append((h1, h2, n, at - count, chunk.as_py()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], [*KEY, "chunk_no", "chunk"])

    proposed = chunks(rows, [], size, held).mapInArrow(run, "h1 long, h2 long, n_bytes long, chunk_no int, chunk binary")
    span = proposed.groupBy(*KEY, "chunk_no").agg(F.min("chunk").alias("least"), F.max("chunk").alias("greatest"))
    return span.where(F.col("least") != F.col("greatest")).select(*KEY).distinct()


def _grouped(rows: DataFrame, keep: list[str], own: str, size: int, primes: tuple[int, int], held: int = HELD, apart: int = APART) -> DataFrame:
    """``keep``, which holds the row key, with keep_id, group_size, kept and text_sha256. ``own`` is the id."""
    meta = fingerprinted(rows, keep, size, primes, apart)
    groups = meta.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")
    bad = persist(disagreeing(rows, groups, size, primes, held), "disagreeing").withColumn("bad", F.lit(True))
    meta = meta.join(bad, KEY, "left").withColumn("apart", F.when(F.col("bad"), F.col("text_sha256")).otherwise("")).drop("bad")
    key = [*KEY, "apart"]
    mine = F.struct(F.col(own).alias("id"), *ROW_KEY)
    # Written first: a join of two plain shuffles is one that adaptive execution splits where a group is hot.
    ends = meta.groupBy(*key).agg(F.count("*").alias("n"), F.max(mine).alias("last"))
    ends = persist(ends.where("n > 1"), "groups")
    found = meta.join(ends, key, "left").withColumn("stays", F.coalesce("last", mine))
    kept = (F.col(ROW_KEY[0]) == F.col(f"stays.{ROW_KEY[0]}")) & (F.col(ROW_KEY[1]) == F.col(f"stays.{ROW_KEY[1]}"))
    return found.select(*keep, F.col("stays.id").alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")


def exact_duplicates(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK, primes: tuple[int, int] = PRIMES, held: int = HELD, apart: int = APART) -> DataFrame:
    """Every row's ``keep`` columns, the id among them, with keep_id, group_size, kept and text_sha256.

    Of equal texts the row with the largest id stays; among rows that share it,
    the last in an arbitrary but fixed order.
    """
    rows = with_row_key(docs, [*keep, text_col]).withColumnRenamed(f"c{len(keep)}", "text")
    names = [f"c{k}" for k in range(len(keep))]
    found = _grouped(rows, [*names, *ROW_KEY], f"c{keep.index(id_col)}", size, primes, held, apart)
    return restored(found, keep, "keep_id", "group_size", "kept", "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with one row of each text, all columns as they are."""
    columns = docs.columns
    keyed = with_row_key(docs)
    own, text = f"c{columns.index(id_col)}", f"c{columns.index(text_col)}"
    found = _grouped(keyed.select(F.col(own).alias("id"), F.col(text).alias("text"), *ROW_KEY), ["id", *ROW_KEY], "id", CHUNK, PRIMES)
    return restored(keyed.join(found.where("kept").select(*ROW_KEY), ROW_KEY, "left_semi"), columns)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, and the row that stays, for every document."""
    return exact_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"])


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
