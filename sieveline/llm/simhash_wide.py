"""SimHash near-duplicates by similarity: candidates by pigeonring over long fingerprints, decided exactly.

Documents link when the Jaccard similarity of their sets of distinct
``words_per_shingle``-word shingles is at least ``similarity``, whatever the edit:
words replaced, passages appended, inserted or removed. Candidates come from
SimHash: a bit is the sign of the set's projection on one direction of a
pseudo-random rotation, so two sets differ in a share of the bits that only their
angle fixes, whatever their sizes. The bits form a ring of segments (`Ring`). A
pair is a candidate where a segment agrees, the chain of bits that follows it in
the ring differs in no more than its budget, and then the whole ring in no more
than its own, seven deviations beyond what the similarity lets expect. There are
so many segments that a pair at the similarity is missed with probability
``missed``, and less above it. The exact sets then decide, so no pair below the
similarity links.

Equal sets are one node, by a digest of 128 bits. A few segments are searched
first, each row with the nearest of its neighbours there only: at most one pair
for a row and segment. These make clusters, in which all pairs are compared, whether
they met or not. Then all segments are searched for all
pairs of different clusters. Each segment's rows are packed, sorted and compared in
parts of bounded rows, for a segment is as long as the number of documents is (in
bits) and so is shared by few of them by chance. A row that meets more than ``FEW``
members of a cluster asks that cluster, once for all segments: it is
compared with all of its members. Other pairs are compared one by
one; where one of a pair has more than ``crowd`` in the segment, they are members of
it instead, and compared as in a cluster: the members are cut into blocks of bounded
rows and shingles, and in each those outside its largest component are compared with
those of other components, which join as soon as a link is found. Where there are
several blocks, members that all edges have not joined to the largest component by
then, and only these, are compared with the members of every block. So the rows made for any number of near copies of one text
are linear in them, and no link's effect is lost. Sets are made again from the
texts, for candidates only.

Edge cases: null, empty and blank texts count as one text; texts shorter than a
shingle link only to the same words; repeated rows are one node; a null id is
never preferred to another; an empty table gives no rows; other columns pass
through unread, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import ROW_KEY, persist, release, restored, small_batches, text_or_empty, with_row_key
from sieveline.llm.components import connected_components
from sieveline.llm.simhash import SEED

LANES = 4
BITS = 64 * LANES
WORD = 64
FIRST = 8
NEIGHBOURS = 8
FEW = 2
MEETINGS = 1 << 28
PART_ROWS = 1 << 19
MET_ROWS = 1 << 16
COMPARED = 1 << 18
SHINGLE_FP = [f"s{k}" for k in range(LANES)]
_SET = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACES = np.arange(8 * LANES, dtype=np.int64) * 256
_STEPS = [np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF) for k in range(LANES)]


@dataclass(frozen=True)
class Settings:
    """``similarity`` is Jaccard's, of sets of shingles; ``missed`` is the chance that a pair at it is no candidate."""

    similarity: float = 0.8
    words_per_shingle: int = 5
    block_rows: int = 2048
    block_shingles: int = 4 << 20
    missed: float = 1e-6
    crowd: int = 32

    @property
    def pruning_bits(self) -> int:
        """Bits expected to differ at the similarity, and seven standard deviations."""
        p = math.acos(2 * self.similarity / (1 + self.similarity)) / math.pi
        return math.floor(BITS * p + 7 * math.sqrt(BITS * p * (1 - p)))


@dataclass(frozen=True)
class Ring:
    """``segments`` of ``width`` bits, and the most bits that differ in a chain behind a segment and in all of them.

    A chain is what follows a segment up to ``WORD`` bits in all. The bits are the
    first of a rotation in ``size`` dimensions.
    """

    width: int
    segments: int
    chain: int
    whole: int
    size: int

    @property
    def bits(self) -> int:
        return self.width * self.segments


def ring_of(documents: int, settings: Settings) -> Ring:
    """The ring for a number of documents: segments as long as the number, and enough of them."""
    width = min(32, max(14, documents.bit_length()))
    rest = WORD - width
    angle, size = math.acos(2 * settings.similarity / (1 + settings.similarity)), 4096
    while True:
        # Shingles that fall on one dimension turn the angle; four deviations of that.
        p = (angle + 4 * math.sin(angle) / math.sqrt(size)) / math.pi
        within = np.cumsum([math.comb(rest, k) * p**k * (1 - p) ** (rest - k) for k in range(rest + 1)])
        chain = int(np.argmax(within >= 0.98))
        met = min((1 - p) ** width * float(within[chain]), 0.999)
        segments = 8 * math.ceil(math.log(settings.missed) / math.log1p(-met) / 8)
        if segments * width <= size:
            bits = segments * width
            return Ring(width, segments, chain, math.floor(bits * p + 7 * math.sqrt(bits * p * (1 - p))), size)
        size *= 2


def _hadamard(n: int) -> np.ndarray:
    out = np.ones((1, 1), np.float32)
    while len(out) < n:
        out = np.block([[out, out], [out, -out]])
    return out


def ring_bits(sets: list[np.ndarray], ring: Ring) -> np.ndarray:
    """The ring's bits of each set, packed: signs of its shingles' sum after a rotation.

    A shingle is a signed unit vector of a dimension that its hash names; the
    rotation is a Walsh-Hadamard transform, random signs and another transform.
    """
    low = 1 << (ring.size.bit_length() - 1) // 2
    left, right = _hadamard(ring.size // low), _hadamard(low)
    signs = np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), ring.size)
    out = np.empty((len(sets), ring.bits // 8), np.uint8)
    for at in range(0, len(sets), 64):
        part = sets[at : at + 64]
        hashes = np.concatenate(part)
        places = np.repeat(np.arange(len(part)) * ring.size, [len(x) for x in part]) + ((hashes >> np.uint64(1)) & np.uint64(ring.size - 1)).astype(np.int64)
        sums = np.bincount(places, 1.0 - 2.0 * (hashes & np.uint64(1)), len(part) * ring.size).astype(np.float32)
        for turn in (signs, np.float32(1)):
            sums = left @ sums.reshape(-1, len(left), low) @ right
            sums = sums.reshape(-1, ring.size) * turn
        out[at : at + 64] = np.packbits(sums[:, : ring.bits] > 0, axis=1, bitorder="little")
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    """More hashes from each: rows of ``LANES`` independent 64-bit values."""
    out = np.empty((len(h), LANES), np.uint64)
    out[:, 0] = h
    for k in range(1, LANES):
        x = h + _STEPS[k]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def _majority(hashes: list[int]) -> np.ndarray:
    """The ``LANES`` words of bits that are set in over half of the hashes."""
    counts = np.zeros((8 * LANES, 256), np.int64)
    for at in range(0, len(hashes), 16_384):
        lanes = _mixed(np.array(hashes[at : at + 16_384], np.uint64)).view(np.uint8)
        counts += np.bincount((lanes + _PLACES).ravel(), minlength=256 * 8 * LANES).reshape(-1, 256)
    return np.packbits((2 * (counts @ _SET) > len(hashes)).ravel(), bitorder="little").view("<u8")


def shingle_hashes(text: str, words_per_shingle: int) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; a text without words has one, of nothing."""
    words = text.encode().lower().split()
    joined = b" ".join(words)
    if not words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - words_per_shingle + 1)
    spans = zip(starts[:n].tolist(), ends[min(words_per_shingle, len(words)) - 1 :].tolist())
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, n))


def sketches(rows: DataFrame, ring: Ring, settings: Settings) -> DataFrame:
    """All columns but the last, which is the text, with the set's digest (d0, d1), its size, and its ring's bits. Narrow."""
    small_batches(rows.sparkSession)
    width = len(rows.columns) - 1
    names = [*rows.columns[:width], "d0", "d1", "size", "bits"]
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes[:width]) + ", d0 long, d1 long, size long, bits binary"

    def run(batches):
        for batch in batches:
            longs, bits = [], []
            for at in range(0, batch.num_rows, 64):
                sets = [shingle_hashes(t.as_py(), settings.words_per_shingle) for t in batch.column(width).slice(at, 64)]
                longs.extend((*np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64), len(x)) for x in sets)
                bits.extend(x.tobytes() for x in ring_bits(sets, ring))
            columns = np.array(longs, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *[pa.array(columns[:, k]) for k in range(3)], pa.array(bits, pa.binary())], names)

    return rows.mapInArrow(run, schema)


def shingle_sets(rows: DataFrame, settings: Settings) -> DataFrame:
    """(node, shingle fingerprint, shingles) of rows (node, text). Narrow."""
    small_batches(rows.sparkSession)
    schema = "node long, " + ", ".join(f"{n} long" for n in SHINGLE_FP) + ", shingles array<long>"

    def run(batches):
        for batch in batches:
            sets = [shingle_hashes(t.as_py(), settings.words_per_shingle) for t in batch.column(1)]
            fps = np.array([_majority(x) for x in sets], "<u8").reshape(-1, LANES).view(np.int64)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(fps[:, k]) for k in range(LANES)], listed], ["node", *SHINGLE_FP, "shingles"])

    return rows.select("node", "text").mapInArrow(run, schema)


class Sets:
    """Rows (node, shingle fingerprint, shingles) by ascending node, for comparing one with many."""

    def __init__(self, rows: pd.DataFrame, settings: Settings):
        self.settings = settings
        self.nodes, sets = rows["node"].to_numpy(), rows["shingles"].tolist()
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        self.fps = rows[SHINGLE_FP].to_numpy(np.int64).view(np.uint64)
        self.marked = np.zeros(len(self.ids), bool)

    def similar(self, k: int, rest: np.ndarray) -> np.ndarray:
        """Those of ``rest`` whose similarity to the k-th set is at least the one asked for."""
        sizes, starts, least = self.sizes, self.starts, self.settings.similarity
        rest = rest[np.minimum(sizes[rest], sizes[k]) / np.maximum(sizes[rest], sizes[k]) >= least]
        rest = rest[np.bitwise_count(self.fps[rest] ^ self.fps[k]).sum(axis=1, dtype=np.int64) <= self.settings.pruning_bits]
        if not len(rest):
            return rest
        own = self.ids[starts[k] : starts[k] + sizes[k]]
        self.marked[own] = True
        common, ends = np.empty(len(rest), np.int64), np.cumsum(sizes[rest])
        for at in np.split(np.arange(len(rest)), np.flatnonzero(np.diff(ends // COMPARED)) + 1):
            some = rest[at]
            first = np.cumsum(sizes[some]) - sizes[some]
            common[at] = np.add.reduceat(self.marked[self.ids[np.repeat(starts[some] - first, sizes[some]) + np.arange(sizes[some].sum())]], first, dtype=np.int64)
        self.marked[own] = False
        return rest[common / (sizes[rest] + sizes[k] - common) >= least]


def verified_links(rows: pd.DataFrame, settings: Settings) -> np.ndarray:
    """(node, node) that join the components among rows beyond their roots, by exact similarity of their sets."""
    rows = rows.drop_duplicates("node").sort_values("node")
    sets = Sets(rows, settings)
    _, label = np.unique(rows["root"].to_numpy(), return_inverse=True)
    out = []
    for k in np.flatnonzero(label != np.argmax(np.bincount(label))):
        found = sets.similar(k, np.flatnonzero(label != label[k]))
        joined, first = np.unique(label[found], return_index=True)
        out.extend((sets.nodes[k], sets.nodes[f]) for f in found[first])
        label[np.isin(label, joined)] = label[k]
    return np.array(out, np.int64).reshape(-1, 2)


def probed_links(rows: pd.DataFrame, settings: Settings) -> np.ndarray:
    """(probe, node) that join the components among rows of which one is a probe, by exact similarity of their sets; fewer than components."""
    rows = rows.sort_values(["node", "probe"], ascending=[True, False]).drop_duplicates("node")
    sets = Sets(rows, settings)
    _, label = np.unique(rows["root"].to_numpy(), return_inverse=True)
    out = []
    for k in np.flatnonzero(rows["probe"].to_numpy()):
        found = sets.similar(k, np.flatnonzero(label != label[k]))
        joined, first = np.unique(label[found], return_index=True)
        out.extend((sets.nodes[k], sets.nodes[f]) for f in found[first])
        label[np.isin(label, joined)] = label[k]
    return np.array(out, np.int64).reshape(-1, 2)


def _blocks_of(rows: str, shingles: str, settings: Settings):
    return F.ceil(F.greatest(F.col(rows) / settings.block_rows, F.col(shingles) / settings.block_shingles)).cast("int")


def _dealt(blocks: str):
    return F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")


def _counted(rows: DataFrame):
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total"))


def probed_in_blocks(probes: DataFrame, against: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Edges (u, v) of similar pairs of each key's probes and all rows it has ``against`` them, both (node, size, root, key)."""

    def probe(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(probed_links(rows, settings), columns=["u", "v"])

    turns = _counted(probes).select("key", _blocks_of("n", "total", settings).alias("turns"))
    cut = persist(_counted(against).select("key", _blocks_of("n", "total", settings).alias("blocks")).join(turns, "key"), "probe-blocks")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = probes.join(cut, "key").select("node", "key", "root", _dealt("turns").alias("turn"), each("blocks").alias("block"), F.lit(True).alias("probe"))
    met = against.join(cut, "key").select("node", "key", "root", each("turns").alias("turn"), _dealt("blocks").alias("block"), F.lit(False).alias("probe"))
    return asked.unionByName(met).join(sets, "node").groupBy("key", "block", "turn").applyInPandas(probe, "u long, v long")


def crowded_links(keyed: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Edges (u, v) with the components of all similar pairs among the members of a key.

    ``keyed`` has node, size, key and root, which similar nodes may have in common.
    """
    members = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"m{k}") for k in range(2)]
    met = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total"), *members).where("n > 1")
    once = met.groupBy("n", "total", "m0", "m1").agg(F.min("key").alias("key"))
    groups = persist(once.select("key", _blocks_of("n", "total", settings).alias("blocks")), "shared-keys")
    shared = persist(keyed.join(groups, "key").select("node", "size", "root", "key", "blocks", _dealt("blocks").alias("block")), "shared-members")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(verified_links(rows, settings), columns=["u", "v"])

    within = shared.select("node", "root", "key", "block").join(sets, "node").groupBy("key", "block").applyInPandas(compare, "u long, v long")
    within = persist(within, "block-links")
    if groups.where("blocks > 1").isEmpty():
        return within
    roots = connected_components(within.union(shared.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    hot = shared.where("blocks > 1").drop("root").join(roots, "node", "left").select("node", "size", "key", F.coalesce("root", "node").alias("root"))
    hot = persist(hot, "crowded-members")
    parts = hot.groupBy("key", "root").agg(F.count("*").alias("n"))
    bulk = persist(parts.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("bulk")), "largest-components")
    outside = persist(hot.join(bulk, "key").where(F.col("root") != F.col("bulk")).drop("bulk"), "outsiders")
    return within.union(probed_in_blocks(outside, hot, sets, settings))


def _bit_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def packed_segments(nodes: DataFrame, first: int, last: int, parts: int, ring: Ring) -> DataFrame:
    """(slot, nodes, roots, members, words): for each segment of a batch of rows (node, cluster, members, bits) its part's rows, packed. Narrow.

    A word is a segment and the chain behind it; nodes are differences to the one
    before and roots, their clusters, to the node, which compress; members are a cluster's size.
    """
    small_batches(nodes.sparkSession)
    names = ["slot", "nodes", "roots", "members", "words"]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own, roots, members = (batch.column(k).to_numpy() for k in range(3))
            bits = _bit_rows(batch.column(3))
            around = np.concatenate([bits, bits[:, : WORD // 8 + 1]], axis=1)
            for at in range(first, last, 16):
                out = []
                for segment in range(at, min(at + 16, last)):
                    byte, shift = divmod(segment * ring.width, 8)
                    words = np.ascontiguousarray(around[:, byte : byte + 8]).view("<u8")[:, 0]
                    if shift:
                        words = (words >> np.uint64(shift)) | (around[:, byte + 8].astype(np.uint64) << np.uint64(WORD - shift))
                    part = words & np.uint64(parts - 1)
                    for k in range(parts):
                        at_part = np.flatnonzero(part == k)
                        n = own[at_part]
                        out.append((segment * parts + k, np.diff(n, prepend=0).tobytes(), (roots[at_part] - n).tobytes(), members[at_part].tobytes(), words[at_part].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), *[pa.binary()] * 4))], names)

    return nodes.select("node", "cluster", "members", "bits").mapInArrow(run, "slot long, nodes binary, roots binary, members binary, words binary")


@dataclass
class Slot:
    """A slot's rows by ascending segment; ``rest`` is the chain behind it. Without members every row is alone."""

    nodes: np.ndarray
    roots: np.ndarray
    members: np.ndarray
    segment: np.ndarray
    rest: np.ndarray

    def between(self, start: int, end: int) -> Slot:
        return Slot(*(x[start:end] for x in (self.nodes, self.roots, self.members, self.segment, self.rest)))

    def near(self, a, b, ring: Ring):
        return (np.bitwise_count(self.rest[a] ^ self.rest[b]) <= ring.chain) & (self.roots[a] != self.roots[b])


def _slot(rows: pd.DataFrame, ring: Ring) -> Slot:
    nodes = np.concatenate([np.cumsum(np.frombuffer(x, np.int64)) for x in rows["nodes"]])
    roots = nodes + np.concatenate([np.frombuffer(x, np.int64) for x in rows["roots"]])
    members = np.concatenate([np.frombuffer(x, np.int64) for x in rows["members"]]) if "members" in rows else np.ones(len(nodes), np.int64)
    words = np.concatenate([np.frombuffer(x, "<u8") for x in rows["words"]])
    segment = words & np.uint64((1 << ring.width) - 1)
    order = np.argsort(segment)
    return Slot(nodes[order], roots[order], members[order], segment[order], words[order] >> np.uint64(ring.width))


def neighbours(rows: pd.DataFrame, ring: Ring) -> pd.DataFrame:
    """(u, v) of a slot: each row and the nearest by its chain, within budget, of the ``NEIGHBOURS`` rows that follow it in its segment."""
    slot = _slot(rows, ring)
    n = len(slot.nodes)
    best, least = np.full(n, -1), np.full(n, ring.chain + 1)
    for step in range(1, NEIGHBOURS + 1):
        at = np.flatnonzero(slot.segment[step:] == slot.segment[:-step])
        differ = np.bitwise_count(slot.rest[at] ^ slot.rest[at + step])
        nearer = (differ < least[at]) & (slot.roots[at] != slot.roots[at + step])
        at, differ = at[nearer], differ[nearer]
        best[at], least[at] = at + step, differ
    at = np.flatnonzero(best >= 0)
    return pd.DataFrame(np.sort(np.stack([slot.nodes[at], slot.nodes[best[at]]], axis=1), axis=1), columns=["u", "v"])


def meetings(rows: pd.DataFrame, ring: Ring, settings: Settings, most: int | None = None) -> pd.DataFrame:
    """(key, u, v) of a slot: pairs that share the segment and whose chains differ within budget; members u of a crowded segment, with -1 as v.

    Only nodes of different roots (clusters) meet. Of two clusters the larger is asked: a node
    u that meets more than ``FEW`` of its members asks all of them, with its root as
    key and -2 as v; pairs with fewer have the root as key, those of nodes alone -2.
    Where one of these is in more than ``most`` pairs (``crowd`` by default), both are
    members of their segment instead.
    """
    most = settings.crowd if most is None else most
    number = int(rows["slot"].iloc[0])
    slot = _slot(rows, ring)
    # Segments don't meet: a few at a time, so that what they meet is thinned before the next are compared.
    ends = np.r_[np.flatnonzero(slot.segment[1:] != slot.segment[:-1]) + 1, len(slot.segment)]
    cuts = np.r_[0, ends[np.flatnonzero(np.diff(ends // MET_ROWS)) + 1], ends[-1]]
    found = [np.empty((0, 3), np.int64), *(_met(slot.between(a, b), number, ring, settings, most) for a, b in zip(cuts[:-1], cuts[1:]) if a < b)]
    return pd.DataFrame(np.concatenate(found), columns=["key", "u", "v"])


def _met(slot: Slot, number: int, ring: Ring, settings: Settings, most: int) -> np.ndarray:
    """Rows (key, u, v) of `meetings` of whole segments."""
    nodes, roots, members, segment = slot.nodes, slot.roots, slot.members, slot.segment
    starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]][: len(segment)])
    counts = np.diff(np.r_[starts, len(segment)])
    pairs, met, shared = [np.empty((0, 2), np.int64)], [np.empty((0, 3), np.int64)], np.zeros(len(nodes), bool)

    def meet(a, b):
        near = slot.near(a, b, ring)
        a, b = a[near], b[near]
        alone = (members[a] == 1) & (members[b] == 1)
        pairs.append(np.stack([a[alone], b[alone]], axis=1))
        a, b = a[~alone], b[~alone]
        asks = (members[a] < members[b]) | (members[a] == members[b]) & (roots[a] > roots[b])
        a, b = np.where(asks, a, b), np.where(asks, b, a)
        met.append(np.stack([roots[b], nodes[a], nodes[b]], axis=1))

    run = np.repeat(np.where(counts <= settings.crowd, np.arange(len(counts)), -1), counts)
    at = np.flatnonzero(run >= 0)
    for step in range(1, settings.crowd):
        at = at[at + step < len(run)]
        at = at[run[at] == run[at + step]]
        if not len(at):
            break
        meet(at, at + step)
    for start, count in zip(starts[counts > settings.crowd], counts[counts > settings.crowd]):
        among, place, sizes = np.unique(roots[start : start + count], return_inverse=True, return_counts=True)
        apart = place != np.argmax(sizes)
        outside = start + np.flatnonzero(apart)
        if len(outside) * count > MEETINGS:
            shared[start : start + count] = True
            continue
        # Two outsiders meet once. What one of them meets is thinned at once, so that rows held stay linear.
        first = len(pairs)
        for k in outside:
            others = np.arange(start, start + count)
            others = others[(others > k) | ~apart]
            meet(np.full(len(others), k), others)
            if len(pairs[-1]) > most:
                shared[pairs.pop()] = True
            met[-1] = _asked(met[-1])
        both = np.unique(np.concatenate([pairs[0], *pairs[first:]]))
        if len(both) > most:
            shared[both] = True
            del pairs[first:]
    pairs = np.concatenate(pairs)
    often = shared | (np.bincount(pairs.ravel(), minlength=len(nodes)) > most)
    many = often[pairs].any(axis=1)
    shared[pairs[many].ravel()] = True
    crowded = np.flatnonzero(shared)
    alone = np.sort(nodes[pairs[~many]], axis=1)
    keys = number << 32 | segment[crowded].astype(np.int64)
    return np.concatenate([np.insert(alone, 0, -2, axis=1), _asked(np.concatenate(met)), np.stack([keys, nodes[crowded], np.full(len(crowded), -1)], axis=1)])


def _asked(met: np.ndarray) -> np.ndarray:
    """Rows (root, asking node, member); those of a root and node with more than ``FEW`` are one, with -2 as member."""
    met = np.unique(met, axis=0)
    _, first, which, counts = np.unique(met[:, :2], axis=0, return_index=True, return_inverse=True, return_counts=True)
    which = which.ravel()
    asks = np.zeros(len(first), bool)
    asks[which[met[:, 2] == -2]] = True
    asks |= counts > FEW
    return np.concatenate([met[~asks[which]], np.column_stack([met[first[asks], :2], np.full(asks.sum(), -2)])])


def near_pairs(pairs: DataFrame, nodes: DataFrame, ring: Ring) -> DataFrame:
    """Those of the pairs (u, v) whose whole rings differ within budget."""

    def run(batches):
        for batch in batches:
            differ = np.bitwise_count(_bit_rows(batch.column(2)) ^ _bit_rows(batch.column(3))).sum(axis=1, dtype=np.int64) if batch.num_rows else np.empty(0)
            yield batch.select([0, 1]).filter(pa.array(differ <= ring.whole))

    a, b = (nodes.select(F.col("node").alias(n), F.col("bits").alias(f"{n}_bits")) for n in "uv")
    return pairs.join(a, "u").join(b, "v").select("u", "v", "u_bits", "v_bits").mapInArrow(run, "u long, v long")


def similar_pairs(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Those of the pairs (u, v) whose sets have the similarity."""

    def run(batches):
        for batch in batches:
            similar = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = a.values.to_numpy(), b.values.to_numpy()
                common = len(np.intersect1d(a, b, assume_unique=True))
                similar.append(common / (len(a) + len(b) - common) >= settings.similarity)
            yield batch.select([0, 1]).filter(pa.array(similar, pa.bool_()))

    a, b = (sets.select(F.col("node").alias(n), F.col("shingles").alias(f"{n}_set")) for n in "uv")
    return pairs.join(a, "u").join(b, "v").select("u", "v", "u_set", "v_set").mapInArrow(run, "u long, v long")


def asked_links(asks: DataFrame, known: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Edges (u, v) of the nodes u that ask a cluster, its number as key, and similar members of it."""
    rows = known.select("node", "size", F.coalesce("root", "node").alias("root"), "cluster")
    asked = rows.withColumnRenamed("cluster", "key").join(asks.select("key").distinct(), "key")
    probes = asks.withColumnRenamed("u", "node").join(rows.drop("cluster"), "node")
    return probed_in_blocks(persist(probes, "asking"), persist(asked, "asked"), sets, settings)


def similar_roots(nodes: DataFrame, docs: DataFrame, ring: Ring, settings: Settings) -> DataFrame:
    """(node, root) of the components of all pairs at or above the similarity, for nodes that have a link.

    ``nodes`` has node, size, bits and the ``ROW_KEY`` of one of its rows in ``docs``,
    which has the text.
    """
    parts = 1 << max(0, (nodes.count() - 1) // PART_ROWS).bit_length()

    def sets_of(wanted: DataFrame) -> DataFrame:
        # Written first: what is read again has a size that Spark knows when it plans the join with the texts.
        wanted = persist(nodes.select("node", *ROW_KEY).join(wanted.distinct(), "node", "left_semi"), "wanted")
        sets = persist(shingle_sets(docs.join(wanted, ROW_KEY), settings), "shingle-sets")
        release(wanted)
        return sets

    alone = nodes.select("node", F.col("node").alias("cluster"), F.lit(1).cast("long").alias("members"), "bits")
    slots = packed_segments(alone, 0, min(FIRST, ring.segments), parts, ring).groupBy("slot")
    met = persist(slots.applyInPandas(lambda rows: neighbours(rows, ring), "u long, v long").distinct(), "neighbours")
    clusters = persist(connected_components(met).withColumnRenamed("root", "cluster"), "clusters")
    sets = sets_of(clusters.select("node"))
    keyed = clusters.join(nodes.select("node", "size"), "node").select("node", "size", F.col("node").alias("root"), F.col("cluster").alias("key"))
    roots = persist(connected_components(crowded_links(keyed, sets, settings)), "roots")
    release(met, sets)

    named = clusters.join(clusters.groupBy("cluster").agg(F.count("*").alias("members")), "cluster").join(roots, "node", "left")
    named = persist(named, "named-clusters")
    known = nodes.select("node", "size", "bits").join(named, "node", "left")
    known = known.select("node", "size", "bits", "root", F.coalesce("cluster", "node").alias("cluster"), F.coalesce("members", F.lit(1)).alias("members"))
    slots = packed_segments(known, 0, ring.segments, parts, ring).groupBy("slot")
    met = persist(slots.applyInPandas(lambda rows: meetings(rows, ring, settings), "key long, u long, v long"), "ring-meetings")
    # Few in every segment can be many in all.
    often = F.max(F.col("v") == -2) | (F.count_distinct("v") > FEW)
    asks = persist(met.where("key >= 0 and v <> -1").groupBy("u", "key").agg(often.alias("often")).where("often").select("u", "key"), "asks")
    others = met.where("v >= 0").join(asks, ["u", "key"], "left_anti")
    others = persist(others.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
    pairs = persist(near_pairs(others, nodes, ring), "near-pairs")
    keyed = met.where("v = -1").select(F.col("u").alias("node"), "key")
    asked = clusters.join(asks.select(F.col("key").alias("cluster")).distinct(), "cluster").select("node")
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node"))
    sets = sets_of(wanted.union(asks.select(F.col("u").alias("node"))).union(asked).union(keyed.select("node")))
    links = similar_pairs(pairs, sets, settings).union(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = links.union(asked_links(asks, known, sets, settings))
    if not keyed.isEmpty():
        keyed = keyed.join(known.select("node", "size", F.coalesce("root", "node").alias("root")), "node")
        links = links.union(crowded_links(keyed, sets, settings))
    linked = connected_components(links)
    release(met, asks, others, pairs, sets, clusters, roots, named)
    return linked


def _similar(rows: DataFrame, settings: Settings | None) -> DataFrame:
    """Columns of ``rows`` but the last, which is the text, and ``group``. ``rows`` has the row key."""
    settings = settings or Settings()
    ring = ring_of(rows.count(), settings)
    kept = persist(sketches(rows.select(*rows.columns[:-1], text_or_empty("text").alias("text")), ring, settings), "sketches")
    own = F.min(F.struct(*ROW_KEY)).alias("own")
    same = kept.groupBy("d0", "d1").agg(own, F.first("size").alias("size"), F.first("bits").alias("bits"))
    nodes = persist(same.select(F.monotonically_increasing_id().alias("node"), "d0", "d1", "size", "bits", "own.*"), "distinct-sets")
    roots = similar_roots(nodes, rows.select(*ROW_KEY, text_or_empty("text").alias("text")), ring, settings)
    # Written first: a join of two plain scans is one that adaptive execution splits where a text is hot.
    grouped = persist(nodes.join(roots, "node", "left").select("d0", "d1", F.coalesce("root", "node").alias("group")), "groups")
    release(nodes)
    return kept.join(grouped, ["d0", "d1"]).select(*rows.columns[:-1], "group")


def similar_documents(docs: DataFrame, keep: list[str], text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """The ``keep`` columns of every row and ``group``, equal for rows of one component."""
    rows = with_row_key(docs, [*keep, text_col])
    names = [f"c{k}" for k in range(len(keep))]
    return restored(_similar(rows.select(*names, *ROW_KEY, F.col(f"c{len(keep)}").alias("text")), settings), keep, "group")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """Rows of ``docs`` with one row of each component: that of the least id, then of the first row."""
    columns = docs.columns
    keyed = with_row_key(docs)
    rows = keyed.select(F.col(f"c{columns.index(id_col)}").alias("id"), *ROW_KEY, F.col(f"c{columns.index(text_col)}").alias("text"))
    first = _similar(rows, settings).groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", *ROW_KEY)).alias("first"))
    kept = first.select(*[F.col(f"first.{c}").alias(c) for c in ROW_KEY])
    return restored(keyed.join(kept, ROW_KEY, "left_semi"), columns)
