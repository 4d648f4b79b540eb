"""Product quantisation of vectors: four codebooks of 256 entries, exact in whole numbers.

Components become whole numbers, floor(1024 x). A vector is cut into equal parts;
the codebook of a part position starts as that part of the first vectors by id, and
each round replaces every entry by the mean of the parts assigned to it, floored.

Assignment is a float32 matrix product that screens, and an exact step that decides.
The product gives ``|c|^2 - 2 x.c`` for all entries of a codebook with an error of at
most ``gamma * (2 |x| |c| + |c|^2)``, where gamma covers the rounding of the inputs, of
every product and of every addition in any order. Entries whose interval reaches below
the upper end of the best interval are computed again in int64, and the least distance
decides, at equal distances the lower index. Equal entries of a codebook are compared
once, under their lowest index, so ties between them cost nothing.

Scale: a round reads the vectors once and each task sends a row of sums for each entry
it used (at most 1024 rows, whatever it read); those are added by Spark. What the driver
holds and every task receives are the codebooks: 256 vectors. Nothing else is gathered.

Edge cases: vectors that are null, empty or hold null or non-finite components take no
part; nor do vectors of another length than the commonest one that the number of parts
divides (of equally common ones the shortest), nor those with a component beyond
``limit(dim)``, whose squared distances would not fit in 64 bits. Fewer vectors than
entries make as many entries as there are vectors. Repeated ids are each a vector;
where they compete for a first entry the lesser vector goes first, and null ids come
last. A sum of errors beyond 64 bits is null. An empty table gives no rows. Columns of
any name pass through.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import persist, positional, quoted, restored, small_batches, table

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
BLOCK = 4096
"""Vectors screened at once: a block's scores take 4 MB."""


def limit(dim: int) -> int:
    """Greatest absolute component for which the squared distance of two vectors stays below 2^62."""
    return math.isqrt((1 << 60) // max(1, dim))


@dataclass(frozen=True)
class Codebooks:
    """``entries`` holds for each part position an (entries, width) array of whole numbers."""

    dim: int
    entries: tuple[np.ndarray, ...]

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(v) for book in self.entries for v in book.ravel().tolist()).encode()).hexdigest()


def finite(vector: Column) -> Column:
    """Whether a vector has components, all of them finite numbers."""
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def fits(vector: Column, dim: int, scale: int = SCALE) -> Column:
    """Whether a finite vector has ``dim`` components within the limit."""
    most = float(limit(dim))
    return finite(vector) & (F.size(vector) == dim) & F.forall(vector, lambda x: (x.cast("double") * scale >= -most) & (x.cast("double") * scale < most))


def dimension(rows: DataFrame, vector: str = "embedding", parts: int = PARTS) -> int | None:
    """The commonest length that ``parts`` divides, at a tie the shortest; None without vectors."""
    v = F.col(quoted(vector))
    sizes = rows.where(finite(v)).groupBy(F.size(v).alias("dim")).agg(F.count("*").alias("n"))
    found = sizes.where(F.col("dim") % parts == 0).orderBy(F.desc("n"), "dim").limit(1).collect()
    return found[0]["dim"] if found else None


def whole_numbers(vectors: pa.Array, dim: int, scale: int = SCALE) -> np.ndarray:
    """The (rows, dim) matrix floor(scale * x) of an array of lists."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(-1, dim)


def screened(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """For each row of ``x`` the mask of entries that may be nearest, by float32 products with their rounding bound."""
    width = book.shape[1]
    left = np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1).astype(np.float32)
    right = np.concatenate([-2.0 * book, (book.astype(np.float64) ** 2).sum(axis=1, keepdims=True)], axis=1).astype(np.float32)
    scores = left @ right.T
    steps = (width + 6) * 2.0**-24  # both inputs rounded, the product, width + 1 additions, and the bound's own rounding
    gamma = steps / (1 - steps)
    greatest = np.sqrt((book.astype(np.float64) ** 2).sum(axis=1).max())
    room = gamma * (2 * np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) * greatest + greatest**2) * (1 + 1e-9)
    bar = np.nextafter((scores.min(axis=1).astype(np.float64) + 2 * room).astype(np.float32), np.float32(np.inf))
    return scores <= bar[:, None]


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Index of the nearest entry for each row, exactly; at equal distances the lower index."""
    distinct, first = np.unique(book, axis=0, return_index=True)
    order = np.argsort(first)  # so that a lower place is a lower index
    distinct, first = distinct[order], first[order]
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), BLOCK):
        rows = x[at : at + BLOCK]
        mask = screened(rows, distinct)
        place = mask.argmax(axis=1)
        open_rows = np.flatnonzero(mask.sum(axis=1) > 1)
        if len(open_rows):
            row, entry = np.nonzero(mask[open_rows])
            gap = rows[open_rows[row]] - distinct[entry]
            distance = np.einsum("ij,ij->i", gap, gap)
            begins = np.flatnonzero(np.diff(row, prepend=-1))
            least = np.repeat(np.minimum.reduceat(distance, begins), np.diff(begins, append=len(row)))
            hits = np.flatnonzero(distance == least)
            of = row[hits]
            once = np.diff(of, prepend=-1) > 0  # entries ascend within a row, so the first hit is the lowest index
            place[open_rows[of[once]]] = entry[hits[once]]
        out[at : at + BLOCK] = first[place]
    return out


def first_entries(rows: DataFrame, dim: int, key: str, vector: str, parts: int, entries: int) -> Codebooks:
    """The parts of the vectors with the smallest ids."""
    found = rows.select(F.col(quoted(key)).alias("id"), F.col(quoted(vector)).alias("v")).where(fits(F.col("v"), dim))
    taken = found.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    matrix = np.floor(np.array([r["v"] for r in taken], np.float64).reshape(-1, dim) * SCALE).astype(np.int64)
    return Codebooks(dim, tuple(np.ascontiguousarray(p) for p in np.split(matrix, parts, axis=1)))


def part_sums(rows: DataFrame, books: Codebooks, vector: str) -> DataFrame:
    """(part, entry, n, s0, s1, ...): how many parts each entry has and their sums. One row for each task and entry meets."""
    width, parts = books.dim // len(books.entries), len(books.entries)
    shared = rows.sparkSession.sparkContext.broadcast(books)
    vectors = rows.select(F.col(quoted(vector)).alias("v")).where(fits(F.col("v"), books.dim))

    def run(batches):
        sums = [np.zeros((len(book), width + 1), np.int64) for book in shared.value.entries]
        for batch in batches:
            matrix = whole_numbers(batch.column(0), books_dim)
            for k, x in enumerate(np.split(matrix, parts, axis=1)):
                entry = nearest(x, shared.value.entries[k])
                order = np.argsort(entry, kind="stable")
                used, begins, counts = np.unique(entry[order], return_index=True, return_counts=True)
                sums[k][used, 0] += counts
                if len(used):
                    sums[k][used, 1:] += np.add.reduceat(x[order], begins, axis=0)
        for k, total in enumerate(sums):
            used = np.flatnonzero(total[:, 0])
            columns = [pa.array(np.full(len(used), k, np.int32)), pa.array(used.astype(np.int32)), *(pa.array(total[used, j]) for j in range(width + 1))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", *(f"s{j}" for j in range(width))])

    books_dim = books.dim
    partial = vectors.mapInArrow(run, "part int, entry int, n long, " + ", ".join(f"s{j} long" for j in range(width)))
    return partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col(f"s{j}").cast("decimal(19,0)")).alias(f"s{j}") for j in range(width)])


def train(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of the whole table; None where no vector takes part."""
    small_batches(rows.sparkSession)
    dim = dimension(rows, vector, parts)
    if dim is None:
        return None
    books = first_entries(rows, dim, key, vector, parts, entries)
    if not len(books.entries[0]):
        return None
    for _ in range(rounds):
        moved = [book.copy() for book in books.entries]
        for part, entry, n, *sums in part_sums(rows, books, vector).collect():  # a row for each entry
            moved[part][entry] = [int(s) // n for s in sums]
        books = Codebooks(dim, tuple(moved))
    return books


def encode(rows: DataFrame, books: Codebooks, vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default), code and error of every vector that takes part. Narrow.

    A code has two hexadecimal digits for each part; the error is the sum of squared
    distances between parts and entries.
    """
    spark = rows.sparkSession
    small_batches(spark)
    keep = rows.columns if keep is None else keep
    taken = rows.select(*positional(rows, keep), F.col(quoted(vector)).alias("v")).where(fits(F.col("v"), books.dim))
    names, parts, dim = [*taken.columns[:-1], "code", "error"], len(books.entries), books.dim
    shared = spark.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            matrix = whole_numbers(batch.column(len(names) - 2), dim)
            codes, error = np.empty((len(matrix), parts), np.uint8), np.zeros(len(matrix), np.int64)
            for k, x in enumerate(np.split(matrix, parts, axis=1)):
                book = shared.value.entries[k]
                codes[:, k] = entry = nearest(x, book)
                gap = x - book[entry]
                error += np.einsum("ij,ij->i", gap, gap)
            digits = codes.tobytes().hex()
            written = [digits[at : at + 2 * parts] for at in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(written, pa.string()), pa.array(error)], names)

    schema = ", ".join(f"{n} {t}" for n, t in taken.dtypes[:-1]) + (", " if keep else "") + "code string, error long"
    return restored(taken.mapInArrow(run, schema), keep, "code", "error")


def decode(codes: DataFrame, books: Codebooks, code: str = "code") -> DataFrame:
    """All columns and ``vector``: the entries that a code names, as components again. A null code gives null. Narrow."""
    taken = codes.select(*positional(codes), F.col(quoted(code)).alias("code"))
    names, parts = [*taken.columns[:-1], "vector"], len(books.entries)
    shared = codes.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            vectors = [None if c is None else np.concatenate([shared.value.entries[k][int(c[2 * k : 2 * k + 2], 16)] for k in range(parts)]) / SCALE for c in batch.column(len(names) - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(vectors, pa.list_(pa.float64()))], names)

    schema = ", ".join(f"{n} {t}" for n, t in taken.dtypes[:-1]) + ", vector array<double>"
    return restored(taken.mapInArrow(run, schema), codes.columns, "vector")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings, the error of each label, and the digest of the codebooks."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    books = train(rows)
    if books is None:
        return rows.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = persist(encode(rows, books, keep=["vec_id", "label"]), "vector-codes")
    sums = persist(coded.groupBy(F.col("label").alias("__label")).agg(F.try_sum("error").alias("label_error")), "label-errors")
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("__label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same rounds over a table of (vector, part, position, component), one CTE a step."""
    width = "(SELECT max(len(embedding)) // 4 FROM kept)"
    near = """SELECT vec_id, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM (
      SELECT x.vec_id, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN {book} c ON c.part = x.part AND c.pos = x.pos GROUP BY ALL) GROUP BY vec_id, part"""
    steps = []
    for k in range(ROUNDS):
        steps.append(f"a{k} AS MATERIALIZED ({near.format(book=f'b{k}')})")
        steps.append(f"""m{k} AS MATERIALIZED (SELECT x.part, entry, x.pos, ((sum(v) - (((sum(v) % count(*)) + count(*)) % count(*))) // count(*))::BIGINT AS v FROM x JOIN a{k} USING (vec_id, part) GROUP BY x.part, entry, x.pos)""")
        steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (part, entry, pos))")
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, embedding FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
    x AS MATERIALIZED (SELECT vec_id, (i - 1) // {width} AS part, (i - 1) % {width} AS pos, floor(1024 * embedding[i]::DOUBLE)::BIGINT AS v FROM kept, unnest(range(1, len(embedding) + 1)) t(i)),
    b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r FROM kept) USING (vec_id) WHERE r <= 256),
    {", ".join(steps)},
    a AS MATERIALIZED ({near.format(book=f"b{ROUNDS}")}),
    coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a GROUP BY vec_id),
    digest AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{ROUNDS})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest"""


ORACLE = _oracle()
