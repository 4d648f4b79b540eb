import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from sieveline.llm import components, exact_dedup, simhash

PICK = random.Random(5)
WORDS = ["".join(PICK.choice("abcdefgh") for _ in range(PICK.randint(2, 7))) for _ in range(300)]


def prose(n):
    return " ".join(PICK.choice(WORDS) for _ in range(n))


LONG = prose(400)
TEXTS = [LONG, LONG, LONG + " tail", LONG.upper(), None, "", " \t\n", "one", "one two", "Ünï one two three", prose(50), "x" * 200_000, prose(50_000)]
DOCS = [(k, t, "s", "clash") for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "s", "clash"), (None, LONG, "s", "clash"), (None, "only null", "s", "clash")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, source string, fp string")


def plain_fingerprint(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + n]).encode(), 42) for k in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    for text in TEXTS[:11]:
        for n in (3, 5):
            assert simhash.simhash(text or "", n) == plain_fingerprint(text, n)
    # The JVM's hash of a shingle is the same function.
    assert spark.range(1).select(F.xxhash64(F.lit("the one two"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(b"the one two", 42)


def classes(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("distance, segments, crowd", [(2, 5, 32), (2, 5, 1), (2, 3, 4), (1, 4, 1), (3, 7, 2), (0, 4, 32), (4, 9, 3)])
def test_links_against_all_pairs(spark, distance, segments, crowd):
    pick = random.Random(distance * 100 + segments)
    values = {pick.getrandbits(64) for _ in range(60)}
    for v in list(values)[:25]:
        for _ in range(6):
            values.add(v ^ sum(1 << b for b in pick.sample(range(64), pick.randint(1, distance + 2))))
    signed = sorted(v - 2**64 if v >> 63 else v for v in values)
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = classes([(a, b) for k, a in enumerate(signed) for b in signed[:k] if bin((a ^ b) & (2**64 - 1)).count("1") <= distance], signed)
    edges = simhash.links(fps, distance, segments, crowd)
    got = {n: n for n in signed} | {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    assert got == want


def test_a_crowded_key_loses_no_link(spark):
    # Ten thousand near copies of one fingerprint: most keys of the first rings are crowded.
    pick = random.Random(12)
    base = pick.getrandbits(64)
    values = set()
    while len(values) < 10_000:
        values.add(base ^ sum(1 << b for b in pick.sample(range(64), pick.randint(0, 5))))
    signed = np.array(sorted(values), np.uint64)
    want = []
    for k, v in enumerate(signed):
        want += [(int(other), int(v)) for other in signed[np.flatnonzero(np.bitwise_count(signed[:k] ^ v) <= 2)]]
    fps = spark.createDataFrame(pd.DataFrame({"fp": signed.view(np.int64)}))
    for crowd in (32, 500):
        edges = [(r["u"] & (2**64 - 1), r["v"] & (2**64 - 1)) for r in simhash.links(fps, 2, 5, crowd).collect()]
        assert all((u ^ v).bit_count() <= 2 for u, v in edges)
        assert classes(edges, signed.tolist()) == classes(want, signed.tolist())
    assert len(set(classes(want, signed.tolist()).values())) > 500


def test_ring_budgets():
    chains = simhash.ring((), tuple(range(64)), 2, 5)
    assert [len(c.fixed) for c in chains] == [25, 26, 26, 26, 25] and all(set(c.fixed) | set(c.free) == set(range(64)) for c in chains)
    assert [[(bin(mask).count("1"), most) for mask, most in c.budgets] for c in chains[:1]] == [[(38, 1), (51, 1)]]
    inner = simhash.ring(chains[0].fixed, chains[0].free, 2, 3)
    assert [len(c.fixed) for c in inner] == [38, 38, 38] and all(len(c.free) == 26 for c in inner)
    assert [len(c.budgets) for c in inner] == [1, 1, 1]
    with pytest.raises(ValueError):
        simhash.ring((), tuple(range(64)), 2, 2)


def test_near_duplicates_frame(spark, docs):
    rows = simhash.near_duplicates(docs, ["doc_id"]).collect()
    assert len(rows) == len(DOCS)
    fps = [(d, plain_fingerprint(t)) for d, t, *_ in DOCS]
    nodes = sorted({f for _, f in fps})
    root = classes([(a, b) for k, a in enumerate(nodes) for b in nodes[:k] if bin(a ^ b).count("1") <= 2], nodes)
    least = {}
    for d, f in fps:
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    assert sorted(map(str, rows)) == sorted(str(r) for r in rows)
    assert sorted((str(r["doc_id"]), r["fp"] & (2**64 - 1), str(r["component_id"])) for r in rows) == sorted((str(d), f, str(least.get(root[f]))) for d, f in fps)
    assert simhash.near_duplicates(docs.limit(0), ["doc_id"]).count() == 0


def test_one_of_each_component_stays(spark, docs):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 0 in ids and 1 not in ids and 3 not in ids and ids.count(3) == 0 and len(ids) == len(set(ids))


def test_components_of_chains_and_loops(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 100), (7, 7), (200, 150), (150, 175), (5, 4)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {200: 150, 150: 150, 175: 150}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_fingerprints_compose():
    hasher = exact_dedup.ChunkHasher(1000)
    pick = random.Random(2)
    data = pick.randbytes(900)
    whole = hasher(data)
    for _ in range(20):
        a, b = sorted(pick.sample(range(901), 2))
        parts = [hasher(data[:a]), hasher(data[a:b]), hasher(data[b:])]
        assert (parts[0] + parts[1]) + parts[2] == parts[0] + (parts[1] + parts[2]) == whole
    slow = 0
    for byte in data:
        slow = (slow * exact_dedup.BASES[0] + byte) % exact_dedup.PRIMES[0]
    assert slow == whole.h1
    assert hasher(b"\0\0") != hasher(b"\0")


def want_exact():
    groups = {}
    for d, t, *_ in DOCS:
        groups.setdefault(t or "", []).append(d)
    return sorted((str(d), str(max((x for x in groups[t or ""] if x is not None), default=None)), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in DOCS)


@pytest.mark.parametrize("size, primes", [(exact_dedup.CHUNK, exact_dedup.PRIMES), (7, exact_dedup.PRIMES), (64, (3, 2))])
def test_exact_duplicates_even_when_fingerprints_collide(spark, docs, size, primes):
    short = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 5000) if size == 7 else docs
    rows = exact_dedup.exact_duplicates(short, ["doc_id"], size=size, primes=primes).collect()
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in rows)
    assert got == [w for w in want_exact() if size != 7 or w[3] in {r["text_sha256"] for r in rows}]
    assert sum(r["kept"] for r in rows) == len({r["text_sha256"] for r in rows})


def test_colliding_texts_of_one_length(spark):
    # With primes this small many texts of one length share a fingerprint.
    rows = [(k, f"{k % 50:04d}") for k in range(150)]
    found = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], primes=(3, 2)).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in found} == {(k, k % 50 + 100, 3) for k in range(150)}


def test_huge_texts_hash_in_parts(spark):
    # Chunks of 64 bytes: texts of up to 2000 chunks, held by 3, dealt over tasks beyond 10,000 bytes.
    pick = random.Random(4)
    texts = [pick.randbytes(n).hex() for n in (0, 31, 32, 33, 96, 97, 5000, 64_000)]
    texts += [texts[-1], texts[-1][:-1] + "x", texts[-2], None]
    rows = [(k, t) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for primes in (exact_dedup.PRIMES, (3, 2)):
        found = exact_dedup.exact_duplicates(frame, ["doc_id"], size=64, primes=primes, held=3, apart=10_000).collect()
        assert {(r["doc_id"], r["keep_id"]) for r in found} == {(k, max(j for j, u in rows if (u or "") == (t or ""))) for k, t in rows}
    kept = exact_dedup.with_row_key(frame).select(F.col("c0"), *exact_dedup.ROW_KEY, F.col("c1").alias("text"))
    names = ["c0", *exact_dedup.ROW_KEY]
    one, many = ({(r["c0"], r["h1"], r["h2"], r["n_bytes"]) for r in exact_dedup.fingerprinted(kept, names, 64, apart=apart).collect()} for apart in (1 << 30, 100))
    whole = exact_dedup.ChunkHasher(1 << 18)
    assert one == many == {(k, f.h1, f.h2, f.length) for k, t in rows for f in [whole((t or "").encode())]}


def test_clashing_names(spark):
    names = ["doc_id", "text", "__file", "__row", "id", "c0", "c1", "fp", "h1", "n_bytes", "text_sha256", "kept", "chunk", "_metadata", "a`b.c"]
    rows = [(k, "same text here" if k < 3 else f"other {k}", *[k] * 13) for k in range(6)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n.replace('`', '``')}` {'string' if n == 'text' else 'long'}" for n in names))
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_duplicates(docs).collect()) == [2, 3, 4, 5]
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == names and sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4, 5]
    found = simhash.near_duplicates(docs, ["doc_id", "h1", "c1"]).collect()
    assert all(r["doc_id"] == r["h1"] == r["c1"] for r in found)


def test_drop_exact(spark, docs):
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t, *_ in DOCS})
    assert exact_dedup.drop_exact_duplicates(docs.limit(0)).count() == 0


def test_components_of_parts(spark, monkeypatch):
    # Edges of one part need no star step; of many parts, forests and star steps give the same.
    pick = random.Random(13)
    edges = [(pick.randint(0, 900), pick.randint(0, 900)) for _ in range(380)] + [(k, k + 1) for k in range(1000, 1200)] + [(2000, k) for k in range(1500, 1600)]
    pick.shuffle(edges)
    want = classes(edges, {n for e in edges for n in e})
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    for most in (50, 7):
        got = [tuple(r) for r in components.connected_components(df, part_edges=most).collect()]
        assert dict(got) == want and len(got) == len(want)
    monkeypatch.setattr(components, "large_star", None)
    assert {r["node"]: r["root"] for r in components.connected_components(df).collect()} == want
