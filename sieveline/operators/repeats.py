"""Longest repeats without pairs: prefix doubling over windows of lines.

A window of lines that occurs once cannot be part of a repeat, so only positions of
repeated windows are kept. They are ranked by their window, then by two windows, four, and
so on: the rank of 2^k windows follows from two ranks of 2^(k-1) windows, one of them
2^(k-1) places on. Ranks keep the order of their halves, so in the last order positions
that share a prefix of any length stand together, and the longest repeat at a position is
shared with a neighbour. Its length is read off the ranks of both, from the longest block
to the shortest.

Every step is an aggregation or an equi-join of one row for each position; neighbours are
joined by their number in the order. A window that every document has is a hot value of one
join, which adaptive execution splits, and is never a pair of documents.

Edge cases: texts with fewer lines than a window, null and empty ones have no positions; a
block ends with its text; equal rows of input are each a place of their own only if their
keys differ; an empty table gives no rows.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.storage import numbered, release, stored


def _ordered(pairs: DataFrame, by: list[str], name: str) -> DataFrame:
    """Adds whole numbers from 1 on that rise with ``by``; ranges are dealt and sorted, nothing is counted."""
    dealt = pairs.repartitionByRange(*by).sortWithinPartitions(*by)
    return dealt.withColumn(name, F.monotonically_increasing_id() + 1)


def ranked(found: DataFrame, key: str) -> list[DataFrame]:
    """For each k from 0 a table (key, pos, rank, whole) of the blocks of 2^k windows, of one row for each repeated window.

    ``rank`` orders positions by what follows; ``whole`` says that the block is complete
    and occurs elsewhere. The last table has no such block.
    """
    repeated = stored(_ordered(found.groupBy("hash").agg(F.count("*").alias("__n")).where("__n > 1").select("hash"), ["hash"], "rank"))
    level = stored(found.join(repeated, "hash").select(key, "pos", "rank", F.lit(True).alias("whole")))
    release(repeated)
    levels, step = [level], 1
    while level.where("whole").limit(1).count():
        ahead = level.select(F.col(key).alias("__key"), (F.col("pos") - step).alias("__pos"), F.col("rank").alias("b"), F.col("whole").alias("__whole"))
        both = level.withColumnRenamed("rank", "a").join(ahead, (F.col(key) == F.col("__key")) & (F.col("pos") == F.col("__pos")), "left")
        both = stored(both.select(key, "pos", "a", F.coalesce("b", F.lit(0)).cast("long").alias("b"), (F.col("whole") & F.coalesce("__whole", F.lit(False))).alias("whole")))
        # Positions whose block is not whole differ in what follows, so they are not counted as a repeat.
        classes = stored(_ordered(both.groupBy("a", "b").agg(F.count_if("whole").alias("__n")), ["a", "b"], "rank"))
        level = stored(both.join(classes, ["a", "b"]).select(key, "pos", "rank", (F.col("whole") & (F.col("__n") > 1)).alias("whole")))
        release(both, classes)
        levels.append(level)
        step *= 2
    return levels


def neighbours(found: DataFrame, key: str) -> tuple[DataFrame, list[DataFrame]]:
    """(p, p_pos, q, q_pos, m): positions next to each other in the order and how many windows they share; and the levels behind it."""
    levels = ranked(found, key)
    order = stored(numbered(levels[-1], [F.col("rank"), F.col(key), F.col("pos")], "__n"))
    left = order.select("__n", F.col(key).alias("p"), F.col("pos").alias("p_pos"))
    right = order.select((F.col("__n") - 1).alias("__n"), F.col(key).alias("q"), F.col("pos").alias("q_pos"))
    near = left.join(right, "__n").select("p", "p_pos", "q", "q_pos", F.lit(0).cast("long").alias("m"))
    for k in range(len(levels) - 1, -1, -1):
        blocks = levels[k].where("whole")
        if k == len(levels) - 1 and k:
            continue
        a = blocks.select(F.col(key).alias("__p"), F.col("pos").alias("__p_pos"), F.col("rank").alias("__a"))
        b = blocks.select(F.col(key).alias("__q"), F.col("pos").alias("__q_pos"), F.col("rank").alias("__b"))
        met = near.join(a, (F.col("p") == F.col("__p")) & (F.col("p_pos") + F.col("m") == F.col("__p_pos")), "left")
        met = met.join(b, (F.col("q") == F.col("__q")) & (F.col("q_pos") + F.col("m") == F.col("__q_pos")), "left")
        before, near = near, stored(met.select("p", "p_pos", "q", "q_pos", (F.col("m") + F.when(F.col("__a") == F.col("__b"), 1 << k).otherwise(0)).alias("m")))
        release(before)
    return near, levels


def longest(near: DataFrame, key: str) -> DataFrame:
    """(key, pos, windows): how many windows the longest repeat from each position has."""
    sides = F.explode(F.array(F.struct(F.col("p").alias("k"), F.col("p_pos").alias("pos")), F.struct(F.col("q").alias("k"), F.col("q_pos").alias("pos"))))
    best = near.select("m", sides.alias("s")).groupBy(F.col("s.k").alias(key), F.col("s.pos").alias("pos")).agg(F.max("m").alias("windows"))
    return best.where("windows > 0")


def left_maximal(best: DataFrame, key: str) -> DataFrame:
    """Of positions (key, pos, windows) those whose repeat is not the rest of the one from the position before."""
    before = best.select(F.col(key).alias("__key"), (F.col("pos") + 1).alias("__pos"), (F.col("windows") - 1).alias("__rest"))
    joined = best.join(before, (F.col(key) == F.col("__key")) & (F.col("pos") == F.col("__pos")), "left")
    return joined.where("__rest is null or __rest < windows").select(key, "pos", "windows")


def longest_repeats(found: DataFrame, key: str, size: int) -> DataFrame:
    """(key, pos, length in lines, block, n_places, first_key, first_pos): repeats that no longer one of an earlier line holds.

    ``found`` has the windows (key, pos, hash) of ``size`` lines. Places with the same
    block have the same lines; ``n_places`` counts those for which it is the longest
    repeat, and the first of them is named.
    """
    near, levels = neighbours(found, key)
    best = stored(longest(near, key))
    starts = left_maximal(best, key).select(key, "pos", "windows", (F.length(F.bin("windows")) - 1).alias("__k"))
    # A block is named by its length and the ranks of its first and its last 2^k windows, which overlap.
    ranks = None
    for k, level in enumerate(levels):
        one = level.where("whole").select(F.lit(k).alias("__level"), F.col(key).alias("__key"), F.col("pos").alias("__pos"), "rank")
        ranks = one if ranks is None else ranks.unionByName(one)
    power = F.expr("shiftleft(1L, __k)")

    def with_rank(rows, at, name):
        on = (F.col("__level") == F.col("__k")) & (F.col(key) == F.col("__key")) & (at == F.col("__pos"))
        return rows.join(ranks, on).drop("__level", "__key", "__pos").withColumnRenamed("rank", name)

    named = with_rank(with_rank(starts, F.col("pos"), "__a"), F.col("pos") + F.col("windows") - power, "__b")
    named = stored(named.select(key, "pos", (F.col("windows") + size - 1).alias("length"), F.struct("windows", "__a", "__b").alias("__block")))
    blocks = named.groupBy("__block").agg(F.count("*").alias("n_places"), F.min(F.struct(key, "pos")).alias("__first"))
    return named.join(blocks, "__block").select(key, "pos", "length", F.xxhash64("__block").alias("block"), "n_places", F.col(f"__first.{key}").alias("first_key"), F.col("__first.pos").alias("first_pos"))


def anchors(found: DataFrame, key: str, size: int) -> DataFrame:
    """(a, b, a_pos, b_pos, length in lines) with a < b: passages that neighbours of two texts share and that start no line later than they could.

    At most two for each repeated position, however many texts share a passage: its
    texts form a chain in the order of ranks.
    """
    near = stored(neighbours(found, key)[0])
    # Where the lines before are shared by the same two places as well, an earlier anchor holds this one.
    before = near.where("m > 1").select(F.col("p").alias("__p"), (F.col("p_pos") + 1).alias("__p_pos"), F.col("q").alias("__q"), (F.col("q_pos") + 1).alias("__q_pos"))
    held = [near["p"] == before["__p"], near["p_pos"] == before["__p_pos"], near["q"] == before["__q"], near["q_pos"] == before["__q_pos"]]
    kept = near.where(F.col("m") > 0).join(before, held, "left_anti").where(F.col("p") != F.col("q"))
    turned = F.when(F.col("p") < F.col("q"), F.struct(F.col("p").alias("a"), F.col("q").alias("b"), F.col("p_pos").alias("a_pos"), F.col("q_pos").alias("b_pos")))
    turned = turned.otherwise(F.struct(F.col("q").alias("a"), F.col("p").alias("b"), F.col("q_pos").alias("a_pos"), F.col("p_pos").alias("b_pos")))
    return kept.select(turned.alias("t"), (F.col("m") + size - 1).alias("length")).select("t.*", "length")


def best_chain(rows: list[tuple[int, int, int]]) -> list[int]:
    """Places in ``rows`` (a_pos, b_pos, length) of the chain with most lines that neither crosses nor overlaps, in order.

    Rows are met in the order of their starts in a; a row that has ended there by then may
    come before, and the best of those that end early enough in b is kept in a list that
    rises in both. Of equal chains the one found first stays. n log n for n rows.
    """
    by_start = sorted(range(len(rows)), key=lambda i: (rows[i][0], rows[i][1], -rows[i][2]))
    by_end = sorted(by_start, key=lambda i: rows[i][0] + rows[i][2])
    ends, tails, score, back = [], [], {}, {}  # b ends and the best chain's last row, both rising
    ended = 0
    for i in by_start:
        a, b, length = rows[i]
        while ended < len(by_end) and rows[by_end[ended]][0] + rows[by_end[ended]][2] <= a:
            j = by_end[ended]
            ended += 1
            end = rows[j][1] + rows[j][2]
            at = bisect.bisect_right(ends, end)
            if at and score[tails[at - 1]] >= score[j]:
                continue
            at = bisect.bisect_left(ends, end)
            stop = at
            while stop < len(ends) and score[tails[stop]] <= score[j]:
                stop += 1
            ends[at:stop], tails[at:stop] = [end], [j]
        at = bisect.bisect_right(ends, b)
        back[i] = tails[at - 1] if at else None
        score[i] = length + (score[back[i]] if at else 0)
    i = max(by_start, key=lambda i: score[i], default=None)
    out = []
    while i is not None:
        out.append(i)
        i = back[i]
    return out[::-1]


def aligned(pairs: DataFrame) -> DataFrame:
    """Of the anchors of each pair of texts the chain with most lines: one-to-one and not crossing.

    A pair's anchors, three numbers each, are all that its task holds; no lines travel.
    Pairs with a single anchor, by far the most, never leave the JVM.
    """
    counted = stored(pairs.withColumn("__n", F.count("*").over(Window.partitionBy("a", "b"))))
    alone, several = (counted.where(test).drop("__n") for test in ("__n = 1", "__n > 1"))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(pdf["a_pos"], pdf["b_pos"], pdf["length"]))
        return pdf.iloc[best_chain(rows)]

    return alone.unionByName(several.groupBy("a", "b").applyInPandas(chain, pairs.schema))


def with_lines(blocks: DataFrame, windows: DataFrame, key: str, size: int) -> DataFrame:
    """(a, b, a_start, a_end, b_start, b_end, length): blocks by line numbers, from the windows they begin and end with."""
    out = blocks
    for side in ("a", "b"):
        starts = windows.select(F.col(key).alias("__key"), F.col("pos").alias("__pos"), F.col("start_line").alias(f"{side}_start"))
        ends = windows.select(F.col(key).alias("__key"), F.col("pos").alias("__pos"), F.col("end_line").alias(f"{side}_end"))
        for lines, at in ((starts, F.col(f"{side}_pos")), (ends, F.col(f"{side}_pos") + F.col("length") - size)):
            out = out.join(lines, (F.col(side) == F.col("__key")) & (at == F.col("__pos"))).drop("__key", "__pos")
    return out.select("a", "b", "a_start", "a_end", "b_start", "b_end", "length")
