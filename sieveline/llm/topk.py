"""Exact top-k inner products by no-random-access aggregation.

Candidates are packed where they are read into shards of bounded size; a shard
has one sorted list for each dimension, read from the top for a positive query
component and from the bottom for a negative one. A block of queries reads all
lists of a shard to the same depth, a quarter, a half and then eighths more. After
each step every candidate has a lower and an upper score bound: what has been
read, and for the rest what the values last read and least allow, or, where that
is less, what the norms of the rest allow (a list entry carries its vector's
norm). A query stops as soon as at most a quarter of the shard can still be among
its k best; only these have their scores resolved.

Queries come in blocks, dealt to groups of shards by an equi-join; what travels
are packed rows, never single pairs. A block keeps its best scores from shard to
shard: a shard whose centre and radius, or greatest norm, leave no score that good
is not read, and no candidate below it is returned. A window with a group limit
keeps the k best of all shards.

Scores are exact integers: components are scaled and floored, sums are computed
in the narrowest float type that holds them exactly. Beyond 2^52 the bounds are
computed on scaled values with room for rounding, and the scores of what is left
in Python integers (then clamped to 64 bits).

Edge cases: vectors that are null, empty or hold null or non-finite components
take no part, nor do rows without an id; vectors meet only vectors of their own
length; rows repeated under one id are each a candidate, but one query (that of
the least vector), and never candidates for their own id; a query with fewer
than k candidates gets all of them; ties go to the smaller id; an empty table
gives no rows; columns other than the id and vector are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.llm.common import quoted, small_batches, table

SHARD_VALUES = 1 << 18
"""Components in a shard, and twice those in a block of queries."""
QUERIES = 256
"""Queries that read a shard at once."""
_LONG = (-(1 << 63), (1 << 63) - 1)


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def packed(rows: DataFrame, scale: float, values: int) -> DataFrame:
    """Rows (id, vector) as packed rows (part, dim, ids, matrix) of at most ``values`` components. Narrow."""

    def run(batches):
        part = TaskContext.get().partitionId()
        held: dict[int, list] = {}
        made = 0

        def close(dim):
            nonlocal made
            ids, matrix = (np.concatenate(x) for x in zip(*held.pop(dim)))
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([part + made - 1], pa.int64()), pa.array([dim], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([matrix.astype("<f8").tobytes()], pa.binary())], ["part", "dim", "ids", "matrix"])

        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            ends = np.cumsum(sizes)
            for dim in np.unique(sizes).tolist():
                which = np.flatnonzero(sizes == dim)
                matrix = flat[(ends[which] - dim)[:, None] + np.arange(dim)]
                most = max(1, values // dim)
                for at in range(0, len(which), most):
                    held.setdefault(dim, []).append((ids[which[at : at + most]], matrix[at : at + most]))
                    if sum(len(x) for x, _ in held[dim]) >= most:
                        yield close(dim)
        for dim in list(held):
            yield close(dim)

    return rows.mapInArrow(run, "part long, dim int, ids binary, matrix binary")


def _exact_type(x: np.ndarray, q: np.ndarray):
    """The narrowest type in which every sum of products is exact."""
    with np.errstate(over="ignore"):
        bound = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
    return np.float32 if bound < 2**23 else np.float64 if bound < 2**52 else object


def _best(ids: np.ndarray, scores, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class Lists:
    """The sorted lists of a shard: rows by each dimension, and each row's place in them."""

    def __init__(self, x: np.ndarray):
        n, d = x.shape
        self.order = np.argsort(x, axis=0, kind="stable")
        self.rank = np.empty((n, d), np.int32)
        np.put_along_axis(self.rank, self.order, np.arange(n, dtype=np.int32)[:, None], axis=0)


def depths(n: int) -> list[int]:
    """How far ``n`` entries are read, step by step: a quarter, a half, then eighths more."""
    return sorted({max(1, n * eighths // 8) for eighths in (2, 4, 5, 6, 7, 8)})


def greatest_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """No row of ``x`` scores more with each query than this: by centre and radius, and by norm."""
    centre = x.mean(axis=0)
    radius, most = (np.sqrt((y * y).sum(axis=1).max()) for y in (x - centre, x))
    length = np.sqrt((q * q).sum(axis=1))
    return np.minimum(q @ centre + length * radius, length * most) * (1 + 1e-9) + 1e-6 * length * most


def nra(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, stats: dict | None = None, bars: dict | None = None, shard: list | None = None):
    """Yield (query index, ids, scores) of each query's k best rows of ``x``, by (-score, id).

    ``bars`` holds the best scores of queries so far, of other shards; it is kept up
    to date, and rows that cannot be among the best are left out. ``stats`` receives
    the depth at which each query stopped, 0 where the shard was not read. ``shard``
    keeps the sorted lists of ``x`` from one call to the next.
    """
    n, d = x.shape
    kind = _exact_type(x, q)
    exact = kind is not object
    whole = (x, q)
    if not exact:
        # Bounds on values of at most 1; what a product loses by rounding is allowed for.
        kind = np.float64
        x, q = (y / max(np.abs(y).max(initial=0), 1.0) for y in (x, q))
    x, q = x.astype(kind), q.astype(kind)
    slack = np.zeros(len(q), kind) if exact else 1e-12 * d * np.abs(q).sum(axis=1)
    shift = 1.0 if exact else float(np.abs(whole[0]).max(initial=1.0)) * float(np.abs(whole[1]).max(initial=1.0))
    least = np.full(len(q), -np.inf)
    if bars is not None and np.isfinite(shift):
        least = np.array([bars[j][-1] / shift if len(bars.get(j, ())) >= k else -np.inf for j in query_ids.tolist()])
    active = np.flatnonzero(greatest_scores(x.astype(np.float64), q.astype(np.float64)) + slack >= least - 1e-9 * np.abs(least)) if np.isfinite(least).any() else np.arange(len(q))
    if stats is not None:
        stats.update(dict.fromkeys(query_ids.tolist(), 0))
    if not len(active):
        return
    shard = [] if shard is None else shard
    if not shard:
        shard.append(Lists(whole[0]))
    rank, lists = shard[0].rank, np.take_along_axis(x, shard[0].order, axis=0)
    # Sums of squares lose this share by rounding, which may be all that is left of them.
    loss = kind(1e-5 if kind is np.float32 else 1e-12)
    weights = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1)
    sides = (weights != 0).astype(kind)
    floor = np.concatenate([lists[0], lists[-1]])
    both = np.concatenate([x, x], axis=1)
    squares = (x * x).sum(axis=1)
    lengths = (q * q).sum(axis=1)
    own = query_ids[:, None] == ids[None, :]
    for depth in depths(n):
        seen = np.concatenate([rank >= n - depth, rank < depth], axis=1)
        weighted, mask = weights[active], seen.astype(kind)
        read = weighted @ np.where(seen, both, 0).T
        if depth == n:
            upper = lower = read
        else:
            frontier = np.concatenate([lists[n - depth], lists[depth - 1]])
            highest, lowest = weighted * frontier, weighted * floor
            rest = np.maximum(lengths[active][:, None] - (weighted * weighted) @ mask.T, 0) + loss * lengths[active][:, None]
            rest *= np.maximum(squares[None, :] - sides[active] @ np.where(seen, both * both, 0).T, 0) + loss * squares[None, :]
            reach = np.sqrt(rest) * kind(1.0001) + kind(1 if exact else 1e-9)
            upper = read + np.minimum(highest.sum(axis=1)[:, None] - highest @ mask.T, reach)
            lower = read + np.maximum(lowest.sum(axis=1)[:, None] - lowest @ mask.T, -reach)
        lower = np.where(own[active], -np.inf, lower)
        bar = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(active), -np.inf)
        bar = np.maximum(bar, least[active])
        able = (upper + 2 * slack[active][:, None] >= (bar - 1e-9 * np.abs(np.where(np.isfinite(bar), bar, 0)))[:, None]) & ~own[active]
        done = (able.sum(axis=1) <= max(k, n // 4)) | (depth == n)
        for row in np.flatnonzero(done):
            j = active[row]
            left = np.flatnonzero(able[row])
            if stats is not None:
                stats[int(query_ids[j])] = depth
            if exact:
                found = _best(ids[left], np.rint(x[left].astype(np.float64) @ q[j].astype(np.float64)).astype(np.int64), k)
            else:
                wide = [int(v) for v in whole[1][j]]
                products = [sum(int(a) * b for a, b in zip(whole[0][i].tolist(), wide)) for i in left]
                order = sorted(range(len(left)), key=lambda i: (-products[i], ids[left[i]]))[:k]
                found = ids[left[order]], np.array([min(max(products[i], _LONG[0]), _LONG[1]) for i in order], np.int64)
            if bars is not None:
                name = int(query_ids[j])
                bars[name] = np.sort(np.concatenate([bars.get(name, np.empty(0)), found[1].astype(np.float64)]))[::-1][:k]
            yield j, *found
        active = active[~done]
        if not len(active):
            break


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_values: int = SHARD_VALUES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best ``vectors`` for each of ``queries``."""
    spark = vectors.sparkSession
    small_batches(spark)

    def rows(df):
        return df.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(vector_col)).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))

    # No more groups than shards: each group has a copy of every block.
    held = rows(vectors).agg(F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0))).first()[0]
    groups = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // shard_values)))
    asked = rows(queries).groupBy("id").agg(F.min("vector").alias("vector"))
    blocks = packed(asked.repartition(max(1, -(-asked.count() // 512))), scale, shard_values // 2)
    blocks = blocks.select("dim", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.col("ids").alias("query_ids"), F.col("matrix").alias("queries"))
    shards = packed(rows(vectors), scale, shard_values).withColumn("grp", F.pmod("part", F.lit(groups)).cast("int"))
    # Blocks on the left: all shards of a group follow each other for one block.
    # Merged by name: estimates do not know how many copies of a block there are, and would broadcast them all.
    met = blocks.hint("merge").join(shards, ["dim", "grp"]).select("dim", "ids", "matrix", "query_ids", "queries")

    def run(batches):
        block, bars = None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                dim, ids, matrix, query_ids, asked_for = (batch.column(c)[row].as_py() for c in range(5))
                if query_ids != block:
                    block, bars = query_ids, {}
                names, asked_rows = np.frombuffer(query_ids, "<i8"), np.frombuffer(asked_for, "<f8").reshape(-1, dim)
                rows_here, shard, out = np.frombuffer(matrix, "<f8").reshape(-1, dim), [], []
                for at in range(0, len(names), QUERIES):
                    some = slice(at, at + QUERIES)
                    found = nra(np.frombuffer(ids, "<i8"), rows_here, names[some], asked_rows[some], k, bars=bars, shard=shard)
                    out += [(names[at + j], i, s) for j, best, scores in found for i, s in zip(best, scores)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*out)], ["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best inner products for every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5, scale=256.0)


ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(256.0 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""
