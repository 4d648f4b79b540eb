"""Vector codes, importance resampling and quality rules against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF

from sieveline.llm import importance, line_quality, vector_codes

CLASHING = ["__part", "c0", "code", "text0", "row", "feature", "v", "a`b.c"]
EXTRA = ", ".join(f"`{n.replace('`', '``')}` long" for n in CLASHING)


def plain_codes(vectors, parts=4, entries=256, rounds=4):
    """vectors: (id, list of floats), by id. Every distance in Python integers."""
    whole = [[math.floor(1024 * float(x)) for x in v] for _, v in vectors]
    width = len(whole[0]) // parts
    cut = [[v[k * width : (k + 1) * width] for v in whole] for k in range(parts)]
    books = [[list(p) for p in c[:entries]] for c in cut]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assigned():
        return [[min((distance(p, e), j) for j, e in enumerate(books[k])) for p in cut[k]] for k in range(parts)]

    for _ in range(rounds):
        now = assigned()
        for k in range(parts):
            for j in range(len(books[k])):
                mine = [p for p, (_, entry) in zip(cut[k], now[k]) if entry == j]
                if mine:
                    books[k][j] = [sum(x) // len(mine) for x in zip(*mine)]
    now = assigned()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: ("".join(f"{now[k][n][1]:02x}" for k in range(parts)), sum(now[k][n][0] for k in range(parts))) for n, (i, _) in enumerate(vectors)}, digest


@pytest.mark.parametrize("spread", [1.0, 1e-3, 3e4])
def test_nearest_is_exact(spread):
    rng = np.random.default_rng(7)
    for width in (1, 3, 16):
        book = np.floor(rng.normal(size=(64, width)) * spread * 1024).astype(np.int64)
        book[40:50] = book[3]  # equal entries: the lowest index
        book[50:60] = book[5:15] + rng.integers(-1, 2, (10, width))  # nearly equal entries
        x = np.concatenate([np.floor(rng.normal(size=(300, width)) * spread * 1024).astype(np.int64), book, (book[:32] + book[32:]) // 2])
        want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, e)), j) for j, e in enumerate(book))[1] for v in x]
        assert vector_codes.nearest(x, book).tolist() == want


def test_screening_drops_few_and_never_the_best():
    rng = np.random.default_rng(1)
    book, x = (np.floor(rng.normal(size=(n, 16)) * 200).astype(np.int64) for n in (256, 2000))
    mask = vector_codes.screened(x, book)
    exact = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert mask[np.arange(len(x)), exact.argmin(axis=1)].all()
    assert mask.sum() < 1.1 * len(x)


def test_codes_against_plain_loops(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    vectors = [(i, [float(np.float32(x)) for x in base[i % 40] + (0 if i % 3 else 0.01) * rng.normal(size=8)]) for i in range(300)]
    want, digest = plain_codes(vectors)
    odd = [(900, None), (901, []), (902, [float("nan")] + [0.0] * 7), (903, [float("inf")] + [0.0] * 7), (904, [None] + [0.0] * 7), (905, [1.0] * 7), (906, [1e30] + [0.0] * 7), (907, [1.0] * 4)]
    rows = spark.createDataFrame([(i, v, i % 3, *[7] * len(CLASHING)) for i, v in vectors + odd], f"vec_id long, embedding array<float>, label int, {EXTRA}").repartition(5)
    books = vector_codes.train(rows)
    assert books.digest() == digest
    coded = vector_codes.encode(rows, books)
    assert coded.columns == [*rows.columns, "code", "error"]
    got = {r["vec_id"]: (r[-2], r["error"]) for r in coded.collect()}
    assert got == want
    back = vector_codes.decode(vector_codes.encode(rows, books, keep=["vec_id", "embedding"]), books).collect()
    for r in back:
        assert sum((math.floor(1024 * a) - round(1024 * b)) ** 2 for a, b in zip(r["embedding"], r["vector"])) == r["error"]


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    few = spark.createDataFrame([(2, [1.0, 2.0, 3.0, 4.0], None), (None, [0.0, 0.0, 0.0, 0.0], None), (2, [1.0, 2.0, 3.0, 4.0], 1)], schema)
    books = vector_codes.train(few)
    assert [b.tolist() for b in books.entries] == [[[1024 * k], [1024 * k], [0]] for k in (1, 2, 3, 4)]
    assert sorted((str(r["vec_id"]), r["code"], r["error"]) for r in vector_codes.encode(few, books).collect()) == [("2", "00000000", 0), ("2", "00000000", 0), ("None", "02020202", 0)]
    assert vector_codes.train(few.limit(0)) is None
    assert vector_codes.train(few.where("vec_id > 9")) is None


def plain_draw(docs, target):
    """docs: (id, text). Bucket counts by hashing every occurrence."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000

    def of(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    s, t = (Counter(bucket(f) for x in texts for f in of(x)[1]) for texts in ([x for _, x in docs], target))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000))))
    out = []
    for i, text in docs:
        n, found = of(text)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    enough = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0]))
    rank = {id(x): k + 1 for k, x in enumerate(enough[: 5 * len(enough) // 100])}
    return [(i, n, w, score, rank.get(id(x))) for x in out for i, _, n, w, score in [x]]


def test_weights_and_draw_against_plain_loops(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = [tuple(r) for r in importance.op12_importance_resampling(spark, SF).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    want = plain_draw(docs, target)
    assert sorted(got) == sorted(want, key=str) or sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[4] is not None for r in got) == 5 * sum(x >= 57 for _, x, *_ in got) // 100


def test_odd_documents_are_weighted(spark, tmp_path):
    rows = [(1, "The cat's 3 DOGS\tÜber ß—x"), (1, "The cat's 3 DOGS\tÜber ß—x"), (2, None), (3, ""), (None, "one"), (4, "two words"), (5, "a b " * 40000), (None, "q w e r t y u i o p a s d f g h j k l z x"), (6, " ... ")]
    rows += [(k, f"same words come in many texts so that enough of them are drawn by rank in this small table of texts {k % 7}") for k in range(10, 70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(1, "the cat and two dogs"), (2, None), (3, "b a b")], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    target.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(r) for r in importance.op12_importance_resampling(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(plain_draw(rows, ["the cat and two dogs", None, "b a b"]), key=str)
    for name, kind in (("documents", "doc_id long"), ("benchmark", "item_id long")):
        spark.createDataFrame([], f"{kind}, text string").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert importance.op12_importance_resampling(spark, f"{tmp_path}/none").collect() == []


def test_both_dictionaries_give_the_same_weights(spark):
    docs, target = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "benchmark"))
    chunks, whole = (sorted(map(tuple, f(docs.limit(60), target).collect())) for f in (importance.weights, importance.weights_by_dictionary))
    assert chunks == whole


def test_a_chunk_has_each_string_once():
    texts = ["a b a b", None, "", "B a", "ß ä1 ß ä1 ß"]
    chunk = importance.Chunk(texts)
    found = Counter(f for t in texts for f in importance.features(importance.words(t)))
    got = Counter()
    for hashes, counts in zip(chunk.hashes, chunk.counts):
        for h, n in zip(hashes.tolist(), counts.tolist()):
            assert h not in got
            got[h] = n
    assert got == Counter({zlib.crc32(f.encode()): n for f, n in found.items()})
    assert importance.Chunk([]).sums(np.zeros(10000, np.int64))[0].tolist() == []


def plain_repeats(words):
    where = {}
    for i in range(len(words) - 7):
        where.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({i + k for at in where.values() if len(at) > 1 for i in at for k in range(8)})


def test_repeated_runs():
    rng = np.random.default_rng(5)
    for n in (0, 1, 8, 9, 16, 40, 400):
        for kinds in (1, 2, 3, 50):
            words = rng.integers(0, kinds, n)
            assert line_quality.in_repeated_runs(words.astype(np.int32)) == plain_repeats(words.tolist())
    long = list(range(100)) + [500] + list(range(30, 60))
    assert line_quality.in_repeated_runs(np.array(long, np.int32)) == plain_repeats(long) == 60


def test_line_rules():
    rule = lambda line: line_quality.failing_rule(line, line.split())
    assert rule("This is a sentence with an end.") is None
    assert rule("A heading here") is None
    assert rule("this line has no mark at all") == "punctuation"
    assert rule("IT!! IS!! LOUD!! HERE!!") == "punctuation"
    assert rule("a### b$$$ c%%% d&&& e.") == "punctuation"
    assert rule("Home | News | About | Contact") == "navigation"
    assert rule("Copyright 2020. ALL RIGHTS RESERVED.") == "boilerplate"
    assert rule("An e-mail me.1@x.example.com and #1.") is None
    text = "One good sentence stands here, with enough words to count as text for the rules.\nHome | News | About\n\nOne good sentence stands here, with enough words to count as text for the rules.\nAnother one follows that is unlike it, which makes twenty words."
    found = line_quality.judge(text)
    assert found["clean_text"].split("\n") == [text.split("\n")[0], "", text.split("\n")[4]]
    assert (found["n_dup_lines"], found["n_navigation"], found["n_repeated"]) == (1, 1, 1)


def test_quality_of_odd_documents(spark):
    long = " ".join(f"w{k}" for k in range(200_000)) + "."
    rows = [(1, None), (1, ""), (2, "\n \t\n"), (3, "a " * 30 + "."), (4, long), (None, "x " * 3), (5, "Ein Satz über Größe … " * 3)]
    docs = spark.createDataFrame([(i, t, *[7] * len(CLASHING)) for i, t in rows], f"doc_id long, text string, {EXTRA}")
    out = line_quality.assess(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    got = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert len(got) == len(rows)
    for (_, text), r in got.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), plain_repeats(words))
    assert got[(4, long)]["kept"] and not got[(3, "a " * 30 + ".")]["kept"]
    kept = line_quality.clean(docs)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [4]
    assert line_quality.clean(docs.limit(0)).collect() == []


def test_good_documents_stay_and_junk_goes(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = line_quality.op13_quality_rules(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("not base_failed").collect()
    good, bad = ([r["kept"] for r in found if r["quality"] == q] for q in (1, 0))
    assert sum(good) >= 0.99 * len(good)
    assert sum(bad) <= 0.5 * len(bad)
