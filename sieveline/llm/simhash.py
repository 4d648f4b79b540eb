"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits over the hashes of a text's word shingles. Two
fingerprints link when at most ``distance`` bits differ. The 64 bits are cut into
``segments`` arranged in a ring. If two fingerprints link, then from some segment
on every chain of consecutive segments stays within its proportional budget: the
first l segments differ in at most floor(l * distance / segments) bits. Chains so
short that the budget is zero give an exact key to join on; longer chains prune
within the join condition before the full distance is checked.

Fingerprints are made distinct first, so copies cost nothing further. Members of
a key agree on its bits, so whatever they differ in lies in the bits it leaves
free. Where more than ``crowd`` fingerprints share a key, the free bits are
therefore cut into a ring of their own, of ``distance + 1`` segments, whose chains
make longer keys. Keys that many share by chance end there, however many
fingerprints there are. Members of a longer key that is still crowded lie close
together, in the extreme all within a few bits, where any ring pairs nearly all
with all. These link through words between them: two fingerprints differ in at
most 2r bits exactly when some word lies within r bits of both, and in at most
2r + 1 when some word lies within r bits of one and r + 1 of the other. Each names
its own words, and all members of a word link to the least near one. No link's
effect is lost, at any distance; the work is linear in the fingerprints, and no
crowded key is ever paired.

Edge cases: null and empty texts, and texts of white space, have fingerprint zero
and link like any other; shorter texts than a shingle hash whole; repeated rows
fall into one component; a null id never names a component unless it has only
null ids; an empty table gives no rows; columns other than the id and text are
not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import ROW_KEY, persist, positional, release, restored, small_batches, table, text_or_empty, with_row_key
from sieveline.llm.components import connected_components

BITS = 64
SEED = 42
_SET = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = (np.arange(8) * 256).astype(np.int64)


def simhash(text: str, words_per_shingle: int = 3, seed: int = SEED) -> int:
    """Fingerprint of a whole text; A-Z count as lower case, other letters as they are.

    Works through the text in slices of 65,536 shingles, so the memory beyond the
    text itself is bounded.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - words_per_shingle + 1)
    last = ends[min(words_per_shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros((8, 256), np.int64)
    for at in range(0, n, 65_536):
        spans = zip(starts[at : min(at + 65_536, n)].tolist(), last[at : at + 65_536].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")
        counts += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256)
    bits = (2 * (counts @ _SET) > n).ravel()
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, columns: list[str], text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """``columns`` of every row as ``c0``, ``c1``, ... with its fingerprint as a signed long. Narrow."""
    small_batches(docs.sparkSession)
    kept = docs.select(*positional(docs, columns), text_or_empty(text_col).alias("text"))
    width = len(columns)
    names = [*kept.columns[:-1], "fp"]
    schema = ", ".join(f"{n} {t}" for n, t in kept.dtypes[:-1]) + ", fp long"

    def run(batches):
        for batch in batches:
            found = np.fromiter((simhash(t.as_py(), words_per_shingle) for t in batch.column(width)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names)
            pa.default_memory_pool().release_unused()

    return kept.mapInArrow(run, schema)


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _mask(bits: Iterable[int]) -> int:
    return sum(1 << b for b in bits)


@dataclass(frozen=True)
class Chain:
    """A start in a ring: bits that a key fixes, bits it leaves free, and the budgets of longer chains."""

    fixed: tuple[int, ...]
    free: tuple[int, ...]
    budgets: tuple[tuple[int, int], ...]


def ring(fixed: tuple[int, ...], free: tuple[int, ...], distance: int, segments: int) -> list[Chain]:
    """The chains of ``segments`` consecutive cuts of the free bits, one for each start.

    Segments without a budget for a difference join the key; a chain of l segments
    may differ in floor(l * distance / segments) bits.
    """
    exact = math.ceil(segments / distance) - 1
    if exact < 1:
        raise ValueError("more segments than differing bits are needed")
    edges = [len(free) * k // segments for k in range(segments + 1)]
    cut = [free[a:b] for a, b in zip(edges, edges[1:])]
    chains = []
    for start in range(segments):
        turn = [cut[(start + k) % segments] for k in range(segments)]
        upto = [sum(turn[:n], ()) for n in range(segments + 1)]
        budgets = tuple((_mask(upto[n]), n * distance // segments) for n in range(exact + 1, segments))
        chains.append(Chain((*fixed, *upto[exact]), sum(turn[exact:], ()), budgets))
    return chains


def _named(rows: DataFrame, first: int, chains: list[list[Chain]]) -> DataFrame:
    """(fp, chain, key) of every row's chains. ``chains`` holds those of each value of ``parent``.

    A key is a hash of the chain's number and the fixed bits: a collision only
    proposes one pair more.
    """
    width = len(chains[0])
    keys = []
    for k in range(width):
        masks = F.array(*[F.lit(_signed(_mask(row[k].fixed))) for row in chains])
        number = (F.col("parent") * width + (first + k)).cast("int")
        keys.append(F.struct(number.alias("chain"), F.xxhash64(number, F.col("fp").bitwiseAND(F.get(masks, F.col("parent")))).alias("key")))
    return rows.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.chain", "k.key")


def near_words(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, word, far): the words within ``radius`` bits of each fingerprint, and how many bits away."""
    out = fps.select("fp", F.col("fp").alias("word"), F.lit(-1).alias("top"), F.lit(0).alias("far"))
    flips = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(_signed(1 << k)).alias("flip")) for k in range(BITS)])
    for _ in range(radius):
        more = F.transform(F.filter(flips, lambda s: s["k"] > F.col("top")), lambda s: F.struct(F.col("word").bitwiseXOR(s["flip"]).alias("word"), s["k"].alias("top"), (F.col("far") + 1).alias("far")))
        grown = F.concat(F.array(F.struct("word", F.lit(BITS).alias("top"), "far")), more)
        out = out.select("fp", F.explode(grown).alias("w")).select("fp", "w.*")
    return out.select("fp", "word", "far")


def word_links(fps: DataFrame, distance: int) -> DataFrame:
    """Edges (u, v) with the components of all links between ``fps``, by the words between them."""
    words = persist(near_words(fps, (distance + 1) // 2), "near-words")
    least = words.groupBy("word").agg(F.min(F.when(F.col("far") <= distance // 2, F.col("fp"))).alias("v"), F.count("*").alias("n"))
    least = persist(least.where((F.col("n") > 1) & F.col("v").isNotNull()).select("word", "v"), "least-of-words")
    return words.join(least, "word").where(F.col("fp") != F.col("v")).select(F.col("fp").alias("u"), "v")


def links(fps: DataFrame, distance: int = 2, segments: int = 5, crowd: int = 32) -> DataFrame:
    """Edges (u, v), all between distinct fingerprints that differ in at most ``distance`` bits, with the components of all such links."""
    if not distance:
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    outer = ring((), tuple(range(BITS)), distance, segments)
    inner = [ring(c.fixed, c.free, distance, distance + 1) for c in outer]
    known = [*outer, *sum(inner, [])]
    settled = []
    rows = fps.select("fp", F.lit(0).alias("parent"))
    for first, level in ((0, [outer]), (len(outer), inner)):
        keyed = _named(rows, first, level)
        counts = persist(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "ring-counts")
        met = persist(keyed.join(counts, "key"), "ring-members")
        release(counts)
        settled.append(met.where(F.col("n") <= crowd).select("key", "chain", "fp"))
        crowded = met.where(F.col("n") > crowd)
        rows = crowded.select("fp", F.col("chain").alias("parent"))
        if rows.isEmpty():
            break
    members = functools.reduce(DataFrame.union, settled)
    a = members.select("key", "chain", F.col("fp").alias("u"))
    b = members.select(F.col("key").alias("__key"), F.col("fp").alias("v"))
    differ = F.col("u").bitwiseXOR(F.col("v"))
    near = F.bit_count(differ) <= distance
    for n in reversed(range(max(len(c.budgets) for c in known))):
        masks, most = zip(*[c.budgets[n] if n < len(c.budgets) else (0, 0) for c in known])
        within = F.bit_count(differ.bitwiseAND(F.get(F.array(*[F.lit(_signed(m)) for m in masks]), F.col("chain")))) <= F.get(F.array(*map(F.lit, most)), F.col("chain"))
        near = within & near
    pairs = a.join(b, (F.col("key") == F.col("__key")) & (F.col("u") > F.col("v")) & near).select("u", "v")
    if rows.isEmpty():
        return pairs
    return pairs.union(word_links(rows.select("fp").distinct(), distance))


def near_duplicates(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, distance: int = 2, segments: int = 5, crowd: int = 32) -> DataFrame:
    """The ``keep`` columns of every row, its fingerprint ``fp``, and its component's least id ``component_id``."""
    found = _components(docs, keep, id_col, text_col, words_per_shingle, distance, segments, crowd)
    return restored(found, keep, "fp", "component_id")


def _components(docs: DataFrame, columns: list[str], id_col: str, text_col: str, words_per_shingle: int, distance: int, segments: int, crowd: int) -> DataFrame:
    """Positional ``columns``, fp and component_id."""
    own = f"c{columns.index(id_col)}"
    kept = persist(fingerprints(docs, columns, text_col, words_per_shingle), "fingerprints")
    fps = persist(kept.groupBy("fp").agg(F.min(own).alias("least")), "distinct-fingerprints")
    roots = connected_components(links(fps.select("fp"), distance, segments, crowd))
    linked = fps.join(roots, fps["fp"] == roots["node"])
    # Sides that are written first are plain scans, which adaptive execution splits where a key is hot.
    least = persist(linked.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    named = roots.join(least, "root").select("node", "component_id")
    named = persist(fps.join(named, fps["fp"] == named["node"], "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "named-fingerprints")
    return kept.join(named, "fp")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, distance: int = 2, segments: int = 5, crowd: int = 32) -> DataFrame:
    """Rows of ``docs`` with one row of each component: that of the least id, then of the first row."""
    columns = docs.columns
    keyed = with_row_key(docs)
    own, text = f"c{columns.index(id_col)}", f"c{columns.index(text_col)}"
    found = _components(keyed, [own, *ROW_KEY], own, text, words_per_shingle, distance, segments, crowd)
    first = F.min(F.struct(F.col("c0").isNull().alias("none"), "c0", "c1", "c2")).alias("first")
    nameless = F.when(F.col("component_id").isNull(), F.col("fp")).alias("nameless")
    kept = found.groupBy("component_id", nameless).agg(first).select(F.col("first.c1").alias(ROW_KEY[0]), F.col("first.c2").alias(ROW_KEY[1]))
    return restored(keyed.join(kept, ROW_KEY, "left_semi"), columns)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
