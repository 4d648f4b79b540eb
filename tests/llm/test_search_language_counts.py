import math
import random
import re
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from sieveline.llm import bpe, langid, lm_score, registry, token_counts, topk, url_filter


def best_by_hand(rows, query_ids, k, scale):
    usable = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in usable:
        if i in query_ids:
            queries[i] = min(queries.get(i, v), v)
    out = set()
    for i, q in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i and len(v) == len(q))[:k]
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)}
    return out


def test_topk_against_all_pairs(spark):
    pick = random.Random(4)
    base = [pick.gauss(0, 1) for _ in range(6)]
    rows = [(k, [pick.gauss(0, 1) for _ in range(6)]) for k in range(300)]
    rows += [(300 + k, base) for k in range(120)]  # ties
    rows += [(500, None), (510, []), (520, [1.0, None] + [0.0] * 4), (530, [float("nan")] * 6), (540, [float("inf")] * 6), (550, [1.0, 2.0]), (560, [2.0, 1.0]), (None, base), (60, base), (60, base)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    queries = df.where(F.col("vec_id") % 20 == 0)
    want = best_by_hand(rows, {i for i, _ in rows if i is not None and i % 20 == 0}, 5, 256.0)
    for values in (60, 1 << 18):
        got = topk.top_k(df, queries, 5, scale=256.0, shard_values=values).collect()
        unique = {tuple(r) for r in got}
        assert unique == want and len(got) == len(unique)
    assert topk.top_k(df.limit(0), queries.limit(0), 5).count() == 0


def test_topk_blocks_are_not_broadcast(spark):
    """Copies of query blocks, one for each group, once were broadcast through the driver whole."""
    x = np.random.default_rng(5).normal(size=(600, 8))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = topk.top_k(df, df.where("vec_id % 50 = 0"), 5, scale=256.0, shard_values=800)
    assert len(found.collect()) == 60
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_lists_stop_early_and_stay_exact():
    pick = np.random.default_rng(3)
    x = np.floor(pick.normal(0, 5, (4000, 4)))
    x[:40] *= 40  # a few rows stand out, so lists need not be read to the end
    q = np.floor(pick.normal(0, 5, (12, 4)))
    stats = {}
    ids = pick.permutation(4000).astype(np.int64)
    for j, found, scores in topk.nra(ids, x, np.arange(-12, 0), q, 5, stats=stats):
        exact = x @ q[j]
        order = np.lexsort((ids, -exact))[:5]
        assert found.tolist() == ids[order].tolist() and scores.tolist() == exact[order].tolist()
    assert len(stats) == 12 and max(stats.values()) < 4000


def test_unit_vectors_stop_before_the_end(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.floor(256 * np.array(vectors["embedding"].tolist(), float))
    ids = vectors["vec_id"].to_numpy()
    stats = {}
    found = dict((j, scores.tolist()) for j, _, scores in topk.nra(ids, x, ids[::10], x[::10], 5, stats=stats))
    assert len(found) == len(stats) and np.mean(list(stats.values())) <= 0.75 * len(x)
    for j, scores in found.items():
        every = np.delete(x @ x[10 * j], 10 * j)
        assert scores == np.sort(every)[::-1][:5].tolist()


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e12, 1e200])
def test_shards_keep_a_bar_and_lose_nothing(scale):
    pick = np.random.default_rng(5)
    centres = pick.normal(0, 300, (6, 8))
    shards = [np.floor((c + pick.normal(0, 20, (200, 8))) * scale) for c in centres]
    q = np.floor((centres[[0, 3, 3]] + pick.normal(0, 20, (3, 8))) * scale)
    bars, got, skipped = {}, {j: [] for j in range(3)}, 0
    for number, x in enumerate(shards):
        stats = {}
        for j, found, scores in topk.nra(np.arange(200) + 1000 * number, x, np.arange(-3, 0), q, 4, stats=stats, bars=bars):
            got[j] += [(-int(s), int(i)) for i, s in zip(found, scores)]
        skipped += sum(depth == 0 for depth in stats.values())
    for j in range(3):
        exact = sorted((-min(max(sum(int(a) * int(b) for a, b in zip(row, q[j])), -(2**63)), 2**63 - 1), k + 1000 * number) for number, x in enumerate(shards) for k, row in enumerate(x))
        if scale < 1e9:
            assert sorted(got[j])[:4] == exact[:4]
        else:
            assert [s for s, _ in sorted(got[j])[:4]] == [s for s, _ in exact[:4]]
    assert skipped or scale > 1e9


def test_huge_components():
    x = np.array([[1e15, 1.0], [1e15, 2.0], [-1e300, 0.0]])
    j, found, scores = next(topk.nra(np.array([1, 2, 3]), x, np.array([9]), np.array([[1e6, 1.0]]), 3))
    assert found.tolist() == [2, 1, 3] and scores.tolist() == [2**63 - 1 if 10**21 + 2 > 2**63 - 1 else 0, 2**63 - 1, -(2**63)]


SEEDS = {"aa": "lorem ipsum dolor sit amet ", "bb": "zwölf große kühe über ", "cc": "ñandú corazón mañana niño "}


@pytest.fixture(scope="module")
def labelled(spark):
    pick = random.Random(1)
    rows = []
    for k in range(120):
        lang = pick.choice(list(SEEDS))
        words = SEEDS[lang].split()
        rows.append((k, lang, " ".join(pick.choice(words) for _ in range(pick.randint(3, 60))), 0.0))
    rows += [(200, "aa", None, 0.0), (201, None, "zwölf kühe", 0.0), (202, "aa", "", 0.0), (203, "aa", "12 !! Ⅻ_3", 0.0), (None, "aa", "lorem ipsum", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string, score double")


def test_language_of_pure_and_mixed_texts(labelled):
    model = langid.train(labelled.where("doc_id < 100"))
    assert model.languages == sorted(SEEDS)
    rows = langid.predict(labelled, model, keep=["doc_id", "lang"]).collect()
    held = [r for r in rows if r["doc_id"] is not None and 100 <= r["doc_id"] < 120]
    assert all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in held)
    by = {r["doc_id"]: r for r in rows}
    assert [by[k]["lang_pred"] for k in (200, 202, 203)] == ["und"] * 3 and by[201]["lang_pred"] == "bb"
    shares = model.mixture(SEEDS["aa"] * 30 + SEEDS["bb"] * 10)
    assert list(shares)[:2] == ["aa", "bb"] and shares["aa"] == pytest.approx(0.76, abs=0.1) and shares.get("cc", 0) < 0.1
    assert list(model.mixture(SEEDS["aa"] * 9000)) == ["aa"]  # by bucket counts


def test_em_against_a_grid(labelled):
    model = langid.train(labelled)
    grams = langid.trigrams(" " + SEEDS["aa"] * 3 + SEEDS["cc"] * 2 + " ", model.settings.bits)
    p = model.p[[0, 2]][:, grams].astype(float)
    grid = max(np.linspace(0.001, 0.999, 999), key=lambda s: np.log(s * p[0] + (1 - s) * p[1]).sum())
    share, _ = model._mixture(model.p[[0, 2]][:, grams], None, len(grams))
    assert share[0] == pytest.approx(grid, abs=0.02)


def test_slices_have_every_trigram_once():
    for text in ("", "a", "ab", "abcdefghij", "ñandú corazón"):
        whole = [f" {text} "[k : k + 3] for k in range(len(text))]
        for size in (1, 2, 3, 4, 100):
            assert [p[k : k + 3] for p in langid.slices(text, size) for k in range(len(p) - 2)] == whole


def test_names_of_other_columns(spark):
    docs = spark.createDataFrame([(1, "a", "lorem ipsum dolor", 0), (2, "b", "zwölf große kühe", 1), (3, None, None, 2)], "doc_id long, lang string, text string, `__lang` long").withColumnsRenamed({})
    docs = docs.selectExpr("*", "doc_id AS `__text`", "text AS share", "lang AS `c0`")
    kept = langid.keep_identified(docs, langid.train(docs))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]


def test_counts_do_not_depend_on_partitions(labelled):
    one = {tuple(r) for r in langid.training_counts(labelled.repartition(1), "lang", "text", 10).collect()}
    assert one == {tuple(r) for r in langid.training_counts(labelled.repartition(7), "lang", "text", 10).collect()}


def test_nothing_to_learn_from(labelled):
    model = langid.train(labelled.limit(0))
    assert {r["lang_pred"] for r in langid.predict(labelled, model, keep=["doc_id"]).collect()} == {"und"}
    with pytest.raises(ValueError):
        langid.train(labelled, settings=langid.Settings(max_languages=2))


def test_held_out_accuracy(spark):
    rows = registry.QUERIES["op5_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97


URLS = [
    (1, "https://A.Example.ORG/en/12?x#y"), (2, "http://example.org/es/1"), (3, "http://notexample.org/es/1"), (4, "http://x.com/fr/1"), (5, "http://x.com/de/"), (6, "http://x.com/en/"),
    (7, None), (8, ""), (9, "no scheme/de/"), (10, "http://x.org"), (11, "x://y.com?/de/"), (12, "http://com/de/1"), (13, "a://b://c/d"), (14, "http://ÄX.co.uk/p\nq#r"), (1, "http://x.com/en/"),
]


def test_rules_and_hosts(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in URLS], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(6, 0)], "page_id long, bad int")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, outcomes).collect()}
    assert got == {
        (1, "a.example.org", "/en/12", "example.org/en/1", "block"), (2, "example.org", "/es/1", "example.org/es/", "block"), (3, "notexample.org", "/es/1", "org/", "allow"),
        (4, "x.com", "/fr/1", "com/fr/", "allow"), (5, "x.com", "/de/", "com/de/", "block"), (6, "x.com", "/en/", None, "allow"), (7, "", "", None, "allow"), (8, "", "", None, "allow"),
        (9, "", "", None, "allow"), (10, "x.org", "", None, "allow"), (11, "y.com", "", None, "allow"), (12, "com", "/de/1", "com/de/", "block"), (13, "b:", "//c/d", None, "allow"),
        (14, "Äx.co.uk", "/p\nq", None, "allow"), (1, "x.com", "/en/", None, "allow"),
    }
    assert url_filter.judge(pages.limit(0), outcomes.limit(0)).count() == 0
    assert spark.createDataFrame([("a.b.co.uk",), ("a.b.com",), ("com",), ("",)], "h string").select(url_filter.registered_domain(F.col("h")), url_filter.suffix_of(F.col("h"))).collect() == [("b.co.uk", "co.uk"), ("b.com", "com"), ("com", "com"), ("", "")]


def test_reputation_shrinks(spark):
    # One bad host with much evidence, one with little, among good ones.
    rows = [(f"good{h}.com", 0, 40) for h in range(20)] + [("bad.net", 1, 60), ("new.net", 1, 1), ("good.net", 0, 60)]
    pages, outcomes, n = [], [], 0
    for host, bad, count in rows:
        for _ in range(count):
            pages.append((n, f"http://{host}/en/x"))
            outcomes.append((n, bad))
            n += 1
    pages.append((n, "http://never.net/en/x"))
    found = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int"), method=url_filter.Reputation(threshold=0.5))
    verdicts = {r["host"]: r["verdict"] for r in found.select("host", "verdict").distinct().collect()}
    assert verdicts["bad.net"] == "block" and verdicts["new.net"] == verdicts["never.net"] == verdicts["good.net"] == "allow"


def test_suffix_rules(spark):
    hosts = spark.createDataFrame([(h,) for h in ("a.b.co.uk", "a.b.com.ar", "x.github.io", "a.b.c.k12.tx.us", "www.go.it", "co.uk", "com")], "h string")
    rules = url_filter.Suffixes(also=("github.io", "k12.tx.us"), never=("go.it",))
    got = [tuple(r) for r in hosts.select(url_filter.registered_domain(F.col("h"), rules), url_filter.suffix_of(F.col("h"), rules)).collect()]
    assert got == [("b.co.uk", "co.uk"), ("b.com.ar", "com.ar"), ("x.github.io", "github.io"), ("c.k12.tx.us", "k12.tx.us"), ("go.it", "it"), ("co.uk", "co.uk"), ("com", "com")]


def test_hosts_are_blocked_through_domain_and_suffix(spark):
    # Hosts without a single outcome of their own: one under a bad domain, one under a bad suffix, one under neither.
    pages, outcomes, n = [], [], 0
    for host, bad, count in [*[(f"h{k}.bad.com", 1, 30) for k in range(6)], *[(f"d{k}.zz", 1, 30) for k in range(6)], *[(f"d{k}.com", 0, 30) for k in range(20)], *[(f"d{k}.net", 0, 30) for k in range(20)]]:
        for _ in range(count):
            pages.append((n, f"http://{host}/x"))
            outcomes.append((n, bad))
            n += 1
    pages += [(n + k, f"http://{host}/x") for k, host in enumerate(("new.bad.com", "new.zz", "new.net", "new.com"))]
    found = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int"), rules=(), method=url_filter.Reputation(threshold=0.5))
    verdicts = {r["host"]: r["verdict"] for r in found.where(f"page_id >= {n}").collect()}
    assert verdicts == {"new.bad.com": "block", "new.zz": "block", "new.net": "allow", "new.com": "allow"}


def test_very_long_urls(spark):
    pages = spark.createDataFrame([(1, "http://" + "a." * 3000 + "com/" + "p" * 100_000), (2, "http://" + "x" * 50_000), (3, "://" + "/" * 9000)], "page_id long, url string")
    rows = {r["page_id"]: r for r in url_filter.judge(pages, spark.createDataFrame([], "page_id long, bad int")).collect()}
    assert len(rows[1]["host"]) == 6003 and len(rows[1]["path"]) == 100_001 and rows[3]["host"] == "" and {r["verdict"] for r in rows.values()} == {"allow"}


COUNT_ROWS = "source string, lang string, tokenizer string, n_tokens long"


def test_rollup(spark, tmp_path):
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    frame = lambda *rows: spark.createDataFrame(list(rows), COUNT_ROWS)
    a, b, n = ("s", "en", "t/1", 5), ("s", None, "t/1", None), (None, "en", "t/2", 7)
    assert rollup.totals().count() == 0
    assert rollup.commit("one", token_counts.signed(frame(a, a, b, n), 1))
    assert not rollup.commit("one", token_counts.signed(frame(a), 1))
    totals = lambda: {tuple(r) for r in rollup.totals().collect()}
    assert totals() == {("s", "en", "t/1", 2, 10), ("s", None, "t/1", 1, 0), (None, "en", "t/2", 1, 7)}
    assert rollup.commit("two", token_counts.revised(frame(a), frame(("s", "en", "t/1", 9))))
    assert rollup.commit("three", token_counts.signed(frame(n), -1))
    assert rollup.commit("none", token_counts.signed(frame(), 1))
    after = {("s", "en", "t/1", 2, 14), ("s", None, "t/1", 1, 0)}
    assert totals() == after
    rollup.compact()
    assert totals() == after and rollup.batches() == {"one", "two", "three", "none"}
    assert not rollup.commit("two", token_counts.signed(frame(a), 1)) and totals() == after
    assert rollup.commit("four", token_counts.signed(frame(a), 1))
    rollup.compact()
    assert ("s", "en", "t/1", 3, 19) in totals() and len(rollup.batches()) == 5
    with pytest.raises(ValueError):
        rollup.commit("../x", token_counts.signed(frame(a), 1))


def test_a_died_compaction_counts_once(spark, tmp_path):
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    rollup.commit("one", token_counts.signed(spark.createDataFrame([("s", "en", "t", 5)], COUNT_ROWS), 1))
    real = rollup._fs

    class NoDelete:
        def __getattr__(self, name):
            return (lambda *_: True) if name == "delete" else getattr(real, name)

    rollup._fs = NoDelete()
    rollup.compact()
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "t", 1, 5)]


def test_a_batch_committed_during_compaction_stays(spark, tmp_path, monkeypatch):
    rollup, other = (token_counts.Rollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    batch = lambda n: token_counts.signed(spark.createDataFrame([("s", "en", "t", n)], COUNT_ROWS), 1)
    rollup.commit("one", batch(5))
    publish = rollup._publish

    def meanwhile(sums, name):
        assert other.commit("two", batch(100))
        return publish(sums, name)

    monkeypatch.setattr(rollup, "_publish", meanwhile)
    rollup.compact()
    assert rollup.batches() == {"one", "two"}
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "t", 2, 105)]


def test_one_of_many_committers_is_first(spark, tmp_path, monkeypatch):
    rollups = [token_counts.Rollup(spark, f"file://{tmp_path}/r") for _ in range(4)]
    monkeypatch.setattr(token_counts.Rollup, "batches", lambda self: set())  # all pass the first look
    batch = token_counts.signed(spark.createDataFrame([("s", "en", "t", 5)], COUNT_ROWS), 1)
    with ThreadPoolExecutor(4) as pool:
        firsts = list(pool.map(lambda r: r.commit("one", batch), rollups))
    assert sorted(firsts) == [False, False, False, True]
    assert [tuple(r) for r in rollups[0].totals().collect()] == [("s", "en", "t", 1, 5)]


def test_counts_against_the_library(spark):
    texts = ["Hello World's été 12", None, "", " \n\t ", "x" * 5000, "Word word, WORD! " * 900, "日本語 é İ <|endoftext|>"]
    docs = spark.createDataFrame([(k, t, "s" if k % 2 else None, "en", 9) for k, t in enumerate(texts)], "n_tokens long, text string, source string, lang string, m0_0 long")
    rows = sorted((r["tokenizer"], r["source"] or "", r["n_tokens"]) for r in token_counts.counted(docs).collect())
    library = bpe.encoder(bpe.VOCABULARY, "library").library
    want = []
    for k, t in enumerate(texts):
        ids = len(library.encode(t or "", add_special_tokens=False).ids)
        source = "s" if k % 2 else ""
        want += [("words/1", source, len((t or "").split())), ("bytes/1", source, len((t or "").encode())), ("word_bpe_49k/1", source, ids), ("word_bpe_49k/2", source, ids + 1)]
    assert rows == sorted(want)
    assert token_counts.counted(docs.limit(0)).count() == 0


def test_maintained_totals_against_the_library(spark):
    library = bpe.encoder(bpe.VOCABULARY, "library").library
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    want = {}
    for d in docs:
        if d["doc_id"] in toxic:
            continue
        text = re.sub(r"[ \t-\r]+", " ", re.sub("[0-9]+", "", d["text"] or "")).strip(" ")
        ids = len(library.encode(text, add_special_tokens=False).ids)
        german = d["lang"] == "de"
        for name, n in (("words/1", len(re.findall(r"[^ \t-\r]+", text))), ("bytes/1", len(text.encode())), (f"word_bpe_49k/{1 + german}", ids + german)):
            have = want.setdefault((d["source"], d["lang"], name), [0, 0])
            have[0] += 1
            have[1] += n
    got = {(r["source"], r["lang"], r["tokenizer"]): [r["n_docs"], r["n_tokens"]] for r in registry.QUERIES["op4_token_counts"](spark, SF).collect()}
    assert got == want


TINY = lm_score.Shape(words=8, buckets=4, hidden=5, batch=64)


def words_of(counts, buckets=4):
    tree = lm_score.huffman(np.array([*counts, *[1] * buckets]))
    return lm_score.Words([f"w{k}" for k in range(len(counts))], buckets, tree, np.zeros(len(counts) + buckets, np.float32))


def test_the_tree_is_a_code():
    pick = np.random.default_rng(0)
    counts = pick.integers(1, 1000, 300)
    tree = lm_score.huffman(counts)
    assert np.exp2(-tree.size.astype(float)).sum() == pytest.approx(1)
    share = counts / counts.sum()
    entropy = -(share * np.log2(share)).sum()
    assert entropy <= (share * tree.size).sum() <= entropy + 1
    # An untrained network with no hidden layer gives the counts' own frequencies.
    net = lm_score.Network(300, tree)
    net.values[0][:] = 0
    stream = np.full(300 * 5, 300, np.uint16)
    stream[2::5] = np.arange(300)
    found = np.exp(net.log_probabilities(stream)[::5].astype(float))
    assert found == pytest.approx(share, rel=1e-3)


def test_gradient():
    words = words_of(range(1, 9))
    start = lm_score.Network(words.tokens, words.tree, TINY)
    pick = np.random.default_rng(0)
    net = lm_score.Network(words.tokens, words.tree, TINY, [pick.normal(0, 0.5, v.shape) for v in start.values])
    pad = words.tokens
    stream = np.array([pad, pad, 1, 5, 1, 11, 0, pad, pad, 3, 7, pad, pad], np.uint16)
    n, parts = net.sums(stream)
    assert n == 7 and [p[1].sum() for p in parts] == [len(stream), sum(words.tree.size[[1, 5, 1, 11, 0, 3, 7]]), 7]
    for number, (rows, _, grad) in enumerate(parts):
        whole = np.zeros_like(net.values[number])
        whole[rows] = grad
        for at in pick.choice(whole.size, min(40, whole.size), replace=False):
            slopes = []
            for step in (1e-2, -1e-2):
                values = [v.copy() for v in net.values]
                values[number].ravel()[at] += step
                slopes.append(lm_score.Network(words.tokens, words.tree, TINY, values).log_probabilities(stream).sum())
            assert whole.ravel()[at] == pytest.approx((slopes[0] - slopes[1]) / 2e-2, abs=1e-2)


def by_hand(scorer, text):
    """Every token from its two neighbours on either side, one at a time."""
    words, (context, node, bias) = scorer.words, scorer.net.values
    d = scorer.net.shape.hidden
    ids = words.ids_of(lm_score.pa.array((text or "").lower().split(), lm_score.pa.string())).tolist()
    total = 0.0
    for k, t in enumerate(ids):
        around = [ids[k + o] if 0 <= k + o < len(ids) else words.tokens for o in (-2, -1, 1, 2)]
        h = np.tanh(sum(context[w, p * d : (p + 1) * d] for p, w in enumerate(around)) + bias[0])
        for place in range(words.tree.start[t], words.tree.start[t] + words.tree.size[t]):
            turn = node[words.tree.nodes[place]]
            total -= math.log1p(math.exp(-words.tree.turns[place] * float(h @ turn[:d] + turn[d])))
        total -= words.shared[t]
    return len(ids), total


def test_scores_against_a_plain_loop(spark):
    pick = random.Random(9)
    texts = [" ".join(pick.choice("abcdefghijk") for _ in range(pick.randint(1, 90))) for _ in range(60)] + [None, "", "  ", "A", "a b " * 300]
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, n_tokens string, ids string")
    scorer = lm_score.train(docs, shape=TINY)
    assert scorer.words.frequent[:2] == ["a", "b"] and len(scorer.words.frequent) == 8
    rows = {r["doc_id"]: r for r in lm_score.score(docs, scorer).collect()}
    for k, t in enumerate(texts):
        n, total = by_hand(scorer, t)
        assert rows[k]["n_tokens"] == n and rows[k]["log_prob"] == pytest.approx(total, abs=1e-2)
        assert (rows[k]["mean_log_prob"] is None) == (n == 0)
    stream = np.full(12 * 5, 12, np.uint16)
    stream[0::5], stream[3::5], stream[2::5] = 1, 3, np.arange(12)
    probabilities = np.exp(scorer.net.log_probabilities(np.r_[np.uint16(12), np.uint16(12), stream, np.uint16(12), np.uint16(12)])[2::5].astype(float))
    assert sum(probabilities) == pytest.approx(1, abs=1e-3)
    assert lm_score.score(docs.limit(0), scorer).count() == 0
    assert lm_score.score(docs, lm_score.train(docs.limit(0), shape=TINY)).count() == len(texts)


def test_training_beats_word_frequencies(spark):
    pick = random.Random(2)
    texts = ["the cat sat on the mat and the dog ran off " * pick.randint(3, 9) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    shape = lm_score.Shape(words=32, buckets=4, hidden=8, batch=512)
    rows = lm_score.score(docs, lm_score.train(docs, shape=shape)).agg(F.sum("log_prob"), F.sum("n_tokens")).first()
    words = " ".join(texts).split()
    entropy = -sum(words.count(w) / len(words) * math.log(words.count(w) / len(words)) for w in set(words))
    assert -rows[0] / rows[1] < 0.7 * entropy


def test_model_hardly_depends_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    shape = lm_score.Shape(words=2000, buckets=255, batch=2048)
    means = []
    for parts in (1, 3, 8):
        rows = lm_score.score(docs, lm_score.train(docs.repartition(parts, "doc_id"), shape=shape)).agg(F.sum("log_prob"), F.sum("n_tokens")).first()
        means.append(rows[0] / rows[1])
    assert max(means) - min(means) < 0.1 * abs(means[0])


def test_vocabulary_grows_with_the_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    shape = lm_score.Shape(words=60_000, buckets=255)
    few, many = (lm_score.learn_words(some, shape=shape) for some in (docs.where("doc_id < 50"), docs))
    assert len(many.frequent) > 2 * len(few.frequent) > 200
    # Words without an id share one by shape: as many as the corpus has of them, on either side.
    counts = {r["word"]: r["n"] for r in lm_score.word_counts(docs).collect()}
    kinds, own = np.zeros(255, int), set(many.frequent)
    for word in counts:
        if word not in own:
            assert counts[word] == 1
            kinds[lm_score.bucket_of(word, 255)] += 1
    assert np.exp(many.shared[len(many.frequent) :]) == pytest.approx(np.maximum(kinds, 1))


def test_shapes_of_words(spark):
    words = ["a", "ab", "abc", "abcd", "ünï", "日本語のことば", "x" * 40, "end,", "'", "é", "🎉🎉🎉🎉"]
    one = [lm_score.bucket_of(w, 97) for w in words]
    assert lm_score.buckets_of(lm_score.pa.array(words), 97).tolist() == one
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(lm_score.bucket_column(F.col("w"), 97)).collect()
    assert [r[0] for r in rows] == one
    assert lm_score.buckets_of(lm_score.pa.array([], lm_score.pa.string()), 97).tolist() == []


def test_slices_of_a_stream_predict_every_position_once():
    stream = np.arange(30)
    pieces = list(lm_score.windows(stream, 7))
    assert np.concatenate([p[2:-2] for p in pieces]).tolist() == list(range(2, 28))
