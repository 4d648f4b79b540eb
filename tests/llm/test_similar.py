import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sieveline.llm import simhash_wide as wide



def classes(values, linked):
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def edited(pick, words, share):
    return " ".join(f"new{pick.random():.9f}" if pick.random() < share else w for w in words)


def jaccard(a, b):
    a, b = ({" ".join(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_go_and_others_stay(spark):
    pick = random.Random(8)
    vocabulary = [f"w{k}" for k in range(4000)]
    docs, pairs = [], []
    for k in range(120):
        words = [pick.choice(vocabulary) if pick.random() < 0.7 else pick.choice(vocabulary[:40]) for _ in range(pick.randint(150, 500))]
        docs.append((2 * k, " ".join(words)))
        docs.append((2 * k + 1, edited(pick, words, 0.008 if k < 80 else 0.5)))
        pairs.append(jaccard(docs[-2][1], docs[-1][1]))
    rows = [(i, t, "s") for i, t in docs] + [(None, docs[0][1], "s"), (500, None, "s"), (501, "", "s"), (0, docs[0][1], "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = wide.drop_similar(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and None not in ids and 500 in ids and 501 not in ids
    assert all(2 * k in ids for k in range(120))
    close = [k for k in range(120) if pairs[k] >= 0.85]
    assert len(close) > 60 and sum(2 * k + 1 not in ids for k in close) >= 0.97 * len(close)
    assert all(2 * k + 1 in ids for k in range(120) if pairs[k] < 0.5)
    assert wide.drop_similar(df.limit(0)).count() == 0
    assert wide.similar_documents(df, ["doc_id"]).where(F.col("doc_id").isin(500, 501)).select("group").distinct().count() == 1


def shingles(text):
    words = text.split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def passages(pick, vocabulary, weights, n):
    """A text, and copies with one passage appended, inserted or removed, or words replaced, near a similarity."""
    words = pick.choices(vocabulary, weights, k=n)
    for target in (0.70, 0.77, 0.79, 0.81, 0.84, 0.87, 0.90, 0.95):
        more = pick.choices(vocabulary, weights, k=round(n * (1 / target - 1)))
        at, cut = pick.randint(0, n // 2), round(n * (1 - target))
        changed = (1 - target) / (1 + target) / 5
        for copy in (words + more, words[:at] + more + words[at:], words[:at] + words[at + cut :], edited(pick, words, changed).split()):
            yield " ".join(words), " ".join(copy)


@pytest.mark.parametrize("rows", [2048, 7])
def test_passages_link_by_exact_similarity(spark, rows):
    pick = random.Random(5)
    vocabulary = [f"w{k}" for k in range(20_000)]
    weights = [1 / (k + 1) for k in range(20_000)]
    pairs = [p for n in (60, 100, 300, 1000, 3000) for _ in range(4) for p in passages(pick, vocabulary, weights, n)]
    # Every pair stands alone: a mark in each word keeps it apart from the others.
    pairs = [tuple(" ".join(f"{w}x{k}" for w in t.split()) for t in p) for k, p in enumerate(pairs)]
    exact = [len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for a, b in pairs]
    docs = spark.createDataFrame([(2 * k + j, t) for k, p in enumerate(pairs) for j, t in enumerate(p)], "doc_id long, text string")
    group = {r["doc_id"]: r["group"] for r in wide.similar_documents(docs, ["doc_id"], settings=wide.Settings(block_rows=rows)).collect()}
    wrong = [(k, exact[k]) for k in range(len(pairs)) if (group[2 * k] == group[2 * k + 1]) != (exact[k] >= 0.8)]
    assert sum(0.65 < x < 0.8 for x in exact) > 150 and sum(0.8 <= x < 0.9 for x in exact) > 150
    assert wrong == []


def test_crowded_group_links_by_exact_similarity(spark):
    pick = random.Random(6)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [pick.choice(vocabulary) for _ in range(200)]
    texts = [" ".join(base[: pick.randint(110, 200)] + [pick.choice(vocabulary) for _ in range(pick.randint(0, 60))]) for _ in range(150)]
    sets = [shingles(t) for t in texts]
    want = classes(sets, lambda a, b: len(a & b) / len(a | b) >= 0.8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for settings in (wide.Settings(), wide.Settings(block_rows=9), wide.Settings(block_shingles=2000)):
        group = {r["doc_id"]: r["group"] for r in wide.similar_documents(docs, ["doc_id"], settings=settings).collect()}
        assert classes([group[k] for k in range(150)], lambda a, b: a == b) == want


def test_crowded_keys_compare_outsiders_only(spark):
    # One bulk of near copies over many blocks, a few texts of their own that share its keys, and links between these.
    pick = random.Random(7)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [pick.choice(vocabulary) for _ in range(300)]
    texts = [edited(pick, base, 0.004) for _ in range(60)]
    texts += [" ".join(base[: 300 - cut] + [pick.choice(vocabulary) for _ in range(cut)]) for cut in range(20, 150, 4)]
    sets = [shingles(t) for t in texts]
    want = classes(sets, lambda a, b: len(a & b) / len(a | b) >= 0.8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = {r["doc_id"]: r["group"] for r in wide.similar_documents(docs, ["doc_id"], settings=wide.Settings(block_rows=8)).collect()}
    assert classes([group[k] for k in range(len(texts))], lambda a, b: a == b) == want and len(set(want)) > 3


def test_fingerprints_prune_no_link():
    # Seven deviations: no pair at the similarity is lost to the SimHash.
    pick = random.Random(9)
    settings = wide.Settings()
    for _ in range(60):
        words = [f"w{pick.randint(0, 9999)}" for _ in range(pick.randint(60, 600))]
        a, b = (wide.shingle_hashes(t, 5) for t in (" ".join(words), " ".join(words[: round(len(words) * 0.83)])))
        differ = int(np.bitwise_count(wide._majority(a) ^ wide._majority(b)).sum())
        assert differ <= settings.pruning_bits


def test_candidates_are_ring_neighbours():
    # A slot's pairs are those that share its segment and whose chains differ within budget, by brute force over the bits.
    settings = wide.Settings(crowd=1000)
    ring = wide.Ring(5, 16, 20, 40, 4096)
    bits = np.random.default_rng(3).integers(0, 2, (300, ring.bits), np.uint8)
    bits[150:] = bits[:150] ^ (np.random.default_rng(4).random((150, ring.bits)) < 0.15)
    around = np.concatenate([bits, bits], axis=1)
    for segment in (0, 1, 7, 15):
        own = around[:, 5 * segment : 5 * segment + 64]
        words = np.packbits(own, axis=1, bitorder="little").view("<u8")[:, 0]
        want = {(i, j) for i in range(300) for j in range(i + 1, 300) if (own[i, :5] == own[j, :5]).all() and (own[i] != own[j]).sum() <= 20}
        rows = pd.DataFrame({"slot": [segment] * 2, "nodes": [np.diff(range(k, k + 150), prepend=0).tobytes() for k in (0, 150)], "roots": [bytes(1200)] * 2, "words": [words[:150].tobytes(), words[150:].tobytes()]})
        got = wide.meetings(rows, ring, settings)
        assert {(u, v) for _, u, v in got.itertuples(index=False)} == want and len(want) > 3
        # Crowded: members instead of pairs, and no pair that was within a pair's budget is without a place to meet.
        few = wide.meetings(rows, ring, wide.Settings(crowd=4))
        together = few[few["v"] < 0].groupby("key")["u"].agg(set).tolist()
        kept = {(u, v) for _, u, v in few[few["v"] >= 0].itertuples(index=False)}
        assert together and all(p in kept or any(set(p) <= m for m in together) for p in want)


def test_rings_miss_no_similar_pair():
    # SimHash itself finds the pairs: a share of segments that agree, and budgets, as the ring expects at a similarity of 0.8.
    pick = random.Random(10)
    settings = wide.Settings()
    for documents in (1000, 300_000, 20_000_000):
        ring = wide.ring_of(documents, settings)
        shares = []
        for n in (4, 8, 20, 60, 300, 3000):
            for _ in range(6):
                a = np.array([pick.getrandbits(64) for _ in range(n)], np.uint64)
                b = np.concatenate([a, np.array([pick.getrandbits(64) for _ in range(n // 4)], np.uint64)])
                x, y = np.unpackbits(wide.ring_bits([a, b], ring), axis=1, bitorder="little")
                differ = np.concatenate([x != y] * 2)
                assert differ[: ring.bits].sum() <= ring.whole
                at = np.arange(ring.segments) * ring.width
                met = [not differ[k : k + ring.width].any() and differ[k : k + 64].sum() <= ring.chain for k in at]
                shares.append(np.mean(met))
        assert min(shares) > 0 and np.mean(shares) * ring.segments >= -np.log(settings.missed)


def test_near_copies_below_the_similarity_make_few_rows(spark, monkeypatch):
    # Many texts that resemble one another, but less than asked for: rows between steps follow the texts, not their pairs.
    pick = random.Random(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [pick.choice(vocabulary) for _ in range(120)]
    texts = [edited(pick, base, pick.choice([0.01, 0.03, 0.045])) for _ in range(500)]
    sets = [shingles(t) for t in texts]
    want = classes(sets, lambda a, b: len(a & b) / len(a | b) >= 0.8)
    written = {}

    def persist(df, what):
        out = kept(df, what)
        written[what] = max(written.get(what, 0), out.count())
        return out

    kept = wide.persist
    monkeypatch.setattr(wide, "persist", persist)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = {r["doc_id"]: r["group"] for r in wide.similar_documents(docs, ["doc_id"]).collect()}
    assert classes([group[k] for k in range(500)], lambda a, b: a == b) == want and 50 < len(set(want)) < 450
    assert max(written.values()) <= 20 * len(texts), written


def test_clusters_are_asked_once():
    # A node that meets more than a few members of a cluster asks it; fewer are pairs, under the cluster's number.
    ring = wide.Ring(5, 16, 59, 80, 4096)
    n, settings = 12, wide.Settings()
    roots = np.array([0] * 8 + [8, 8, 10, 11])
    members = np.array([8] * 8 + [2, 2, 1, 1])
    rows = pd.DataFrame({"slot": [3], "nodes": [np.diff(range(n), prepend=0).tobytes()], "roots": [(roots - np.arange(n)).tobytes()], "members": [members.tobytes()], "words": [np.full(n, 7, "<u8").tobytes()]})
    got = set(wide.meetings(rows, ring, settings).itertuples(index=False, name=None))
    assert got == {(0, k, -2) for k in (8, 9, 10, 11)} | {(8, k, v) for k in (10, 11) for v in (8, 9)} | {(-2, 10, 11)}
    # The same with more rows in the segment than a crowd has.
    crowd = set(wide.meetings(rows, ring, wide.Settings(crowd=5)).itertuples(index=False, name=None))
    assert crowd == got


def test_rows_held_for_a_crowded_segment_are_linear():
    # Rows near one another that no cluster has: what each of them meets is not held for all of them at once.
    import tracemalloc

    ring, n = wide.Ring(5, 16, 59, 80, 4096), 4000
    rows = pd.DataFrame({"slot": [3], "nodes": [np.diff(range(n), prepend=0).tobytes()], "roots": [bytes(8 * n)], "words": [np.full(n, 7, "<u8").tobytes()]})
    tracemalloc.start()
    got = wide.meetings(rows, ring, wide.Settings())
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(got["u"]) == set(range(n)) and set(got["v"]) == {-1} and len(got) == n
    assert held < 2000 * n, held


def test_probes_join_components_once():
    # All rows are similar to all: edges are fewer than rows, whatever the number of probes.
    n = 60
    rows = pd.DataFrame({"node": range(n), "root": range(n), "probe": True, "shingles": [np.arange(40)] * n} | {name: 0 for name in wide.SHINGLE_FP})
    links = wide.probed_links(rows, wide.Settings())
    assert len(links) == n - 1 and set(links.ravel()) == set(range(n))


def test_sets_are_compared_in_pieces(monkeypatch):
    pick = np.random.default_rng(2)
    base = np.arange(200)
    sets = [np.unique(np.r_[base[: pick.integers(120, 200)], pick.integers(1000, 9000, pick.integers(1, 40))]) for _ in range(50)] + [np.arange(5000, 5003)]
    rows = pd.DataFrame({"node": range(51), "shingles": sets} | {name: 0 for name in wide.SHINGLE_FP})
    monkeypatch.setattr(wide, "COMPARED", 300)
    held = wide.Sets(rows, wide.Settings())
    for k in range(51):
        want = [j for j in range(51) if j != k and len(set(sets[k]) & set(sets[j])) / len(set(sets[k]) | set(sets[j])) >= 0.8]
        assert held.similar(k, np.array([j for j in range(51) if j != k])).tolist() == want
