"""Operators for keys, texts and groups of any size, against plain loops."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from sieveline.operators import automaton, chunks, clones, intervals, lines, nesting, repeats, scans, structure
from sieveline.operators.components import components
from sieveline.operators.storage import release, stored


def test_running_values_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "hot", "hot", "hot", "hot", f"k{rng.randrange(9)}"]), i, rng.choice([None, -2, 1, 3])) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "`a key` string, at long, v long").repartition(7)
    v = F.col("v")
    out = scans.running(df, ["a key"], ["at"], s=scans.total(v), s0=scans.total(v, True), m=scans.greatest(v), m0=scans.greatest(v, True), last=scans.latest(v), last0=scans.latest(v, True))
    assert out.columns == [*df.columns, "s", "s0", "m", "m0", "last", "last0"]
    got = {(r["a key"], r["at"]): tuple(r)[3:] for r in out.collect()}
    assert len(got) == 3000
    state = {}
    for key, at, v in sorted(rows, key=lambda r: r[1]):
        s0, m0, l0 = state.get(key, (0, None, None))
        s, m, last = s0 + (v or 0), max((x for x in (m0, v) if x is not None), default=None), l0 if v is None else v
        state[key] = (s, m, last)
        assert got[(key, at)] == (s, s0, m, m0, last, l0)
    assert scans.running(df.limit(0), ["a key"], ["at"], s=scans.total(F.col("v"))).collect() == []


def test_hot_key_spans_tasks(spark):
    df = spark.range(0, 8000, 1, 8).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 50).alias("user"), F.col("id").alias("at"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    try:
        rows = df.repartitionByRange("user", "at").withColumn("part", F.spark_partition_id())
        sizes = sorted(r["count"] for r in rows.groupBy("part").count().collect())
        assert len(sizes) >= 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
        assert rows.where("user = 0").select("part").distinct().count() >= 2
        hot_user_is_right(df)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def hot_user_is_right(df):
    events = df.withColumn("event_type", F.when(F.col("at") % 97 == 0, "signup").otherwise("view"))
    eras = intervals.kinds_since(events, "user", ["at"], F.col("event_type") == "signup", "event_type").where("user = 0").agg(F.sum("n_events"), F.max("era")).first()
    assert tuple(eras) == (4000, sum(i % 97 == 0 for i in range(0, 8000, 2)))


TEXTS = [(1, "<div><p>a</p></div>\n/* x\n\n y */ z\nlast"), (2, ""), (3, None), (4, "\n"), (5, "<ul><li>" * 40 + "</li></ul>" * 39 + "no\nend\n"), (6, "plain"), (7, "</p></p><p ><P>ü\n" * 9)]


@pytest.mark.parametrize("size", [1, 7, 12, 31, 4096])
def test_chunks_give_what_whole_texts_give(spark, size):
    texts = spark.createDataFrame(TEXTS, "id long, text string")
    cut = stored(chunks.chunked(texts, "id", "text", size))
    if size >= 12:
        whole = structure.running_depth(structure.tags(texts, "id", "text"), "id").groupBy("id").agg(F.max("depth"), F.count("*"))
        assert sorted(map(tuple, chunks.greatest_depths(cut, "id").collect())) == sorted(map(tuple, whole.collect()))
    got = chunks.classified(chunks.lines(cut, "id"), "id", ("//",), ("/*", "*/"))
    want = lines.classified(lines.exploded(texts, "id", "text", "\n"), "id", ("//",), ("/*", "*/"))
    assert sorted(map(tuple, got.select("id", "line_no", "raw", "kind").collect())) == sorted(map(tuple, want.select("id", "line_no", "raw", "kind").collect()))


def test_windows_by_stretches(spark):
    words = spark.createDataFrame([(k, n + 1, f"w{n % 5}") for k in (1, 2) for n in range(40 * k)], "id long, line_no long, norm string")
    got = sorted(map(tuple, chunks.windows(words, "id", 6, stretch=8).collect()))
    assert got == sorted((k, p, p + 1, p + 6, hashlib.sha256("\0".join(f"w{n % 5}" for n in range(p, p + 6)).encode()).hexdigest()) for k in (1, 2) for p in range(40 * k - 5))


def stack_pairs(html):
    """Pairs (open, close), unmatched with None, and parents, by a stack."""
    found, stack, pairs, parents = list(re.finditer(r"(?i)(</?(?:div|p|ul|li)[ >])", html)), [], [], {}
    for pos, m in enumerate(found, 1):
        if m[0].startswith("</"):
            pairs.append((stack.pop()[0] if stack else None, pos))
        else:
            parents[pos] = (stack[-1][0] if stack else None, next((p for p, t in reversed(stack) if t == "ul"), None))
            stack.append((pos, m[0].strip("<> ").lower()))
    return sorted(pairs + [(p, None) for p, _ in stack], key=str), parents


def test_tags_match_as_by_a_stack(spark):
    rng = random.Random(4)
    pages = [(i, "".join(rng.choice(["<div>", "<UL >", "<li>", "<p>", "</p>", "</div>", "</ul>", "x\n", "<b>"]) for _ in range(rng.randrange(60)))) for i in range(25)] + [(90, None), (91, "")]
    tags = stored(nesting.placed_tags(spark.createDataFrame(pages, "id long, html string"), "id", "html", ("div", "p", "ul", "li")))
    pairs = stored(nesting.matched(tags, "id"))
    parents = {(r["id"], r["pos"]): r["parent_pos"] for r in nesting.parents(tags, "id").collect()}
    listed = {(r["id"], r["pos"]): r["list_pos"] for r in nesting.enclosing(tags, pairs, "id", F.col("tag") == "ul").collect()}
    rows = pairs.collect()
    for i, html in pages:
        want, above = stack_pairs(html or "")
        # A closing tag with nothing open lowers the level for all that follows, which changes no pair.
        assert sorted(((r["open_pos"], r["close_pos"]) for r in rows if r["id"] == i), key=str) == want
        assert {p: (parents[i, p], listed[i, p]) for (k, p) in parents if k == i} == above
        for r in rows:
            if r["id"] == i and r["inner_end"] is not None:
                assert html[: r["inner_start"]].lower().endswith((r["open_tag"] + ">", r["open_tag"] + " ")) and html[r["inner_end"] :].lower().startswith("</" + r["close_tag"])


def masked_plainly(text):
    out, state, i = [], 0, 0
    while i < len(text):
        token = next((m for m in automaton.MARKUP.marks if text.startswith(m, i)), text[i])
        after = automaton.MARKUP.moves.get((state, automaton.MARKUP.marks.index(token)), state) if token in automaton.MARKUP.marks else state
        hidden = state in automaton.MARKUP.masked or after in automaton.MARKUP.masked
        out.append(re.sub(r"[^\r\n]", " ", token) if hidden else token)
        state, i = after, i + len(token)
    return "".join(out)


@pytest.mark.parametrize("size", [1, 5, 4096])
def test_masking_by_chunks(spark, size):
    rng = random.Random(8)
    parts = ["<!--", "-->", "<", ">", '"', "'", "a", "\n", "--", "-", "!", " ö ", "<a href=\"x>y\">", "<!-->"]
    texts = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(300)))) for i in range(30)] + [(80, None), (81, ""), (82, "<!--" + "x\n" * 500), (83, "b" * 700)]
    rows = automaton.masked(spark.createDataFrame(texts, "id long, text string"), "id", "text", size=size).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["chunk"]):
        got[r["id"]] = got.get(r["id"], "") + r["part"]
    assert got == {i: masked_plainly(t) for i, t in texts if t}


def sequences(spark, docs):
    """Windows of one line each, so that a sequence of letters is a text."""
    rows = [(k, p, p + 1, p + 1, hashlib.sha256(c.encode()).hexdigest()) for k, text in docs.items() for p, c in enumerate(text)]
    return spark.createDataFrame(rows, "id long, pos long, start_line long, end_line long, hash string")


def longest_plainly(docs):
    places = [(k, p) for k, t in docs.items() for p in range(len(t))]
    best = {}
    for (a, p), (b, q) in itertools.permutations(places, 2):
        m = 0
        while p + m < len(docs[a]) and q + m < len(docs[b]) and docs[a][p + m] == docs[b][q + m]:
            m += 1
        if m:
            best[a, p] = max(m, best.get((a, p), 0))
    starts = {(a, p): m for (a, p), m in best.items() if best.get((a, p - 1), 0) - 1 < m}
    groups = {}
    for (a, p), m in starts.items():
        groups.setdefault(docs[a][p : p + m], []).append((a, p))
    return sorted((a, p, m, len(g), *min(g)) for (a, p), m in starts.items() for g in [groups[docs[a][p : p + m]]])


def test_longest_repeats(spark):
    rng = random.Random(2)
    for docs in ({1: "abcxabcyab", 2: "zabcx", 3: "", 4: "qqqqqqq"}, {k: "".join(rng.choice("ab" if k < 3 else "abcdefgh") for _ in range(25)) for k in range(6)}, {1: "abc", 2: "def"}):
        found = repeats.longest_repeats(sequences(spark, docs), "id", 1)
        assert sorted((r["id"], r["pos"], r["length"], r["n_places"], r["first_key"], r["first_pos"]) for r in found.collect()) == longest_plainly(docs)


def test_a_window_in_every_text_makes_no_pairs(spark):
    docs = {k: f"{chr(200 + k)}x{chr(600 + k)}" for k in range(150)}
    found = sequences(spark, docs)
    levels = repeats.ranked(found, "id")
    assert [level.count() for level in levels] == [150, 150]
    near = repeats.neighbours(found, "id")[0]
    assert near.count() == 149
    rows = repeats.longest_repeats(found, "id", 1).collect()
    assert len(rows) == 150 and {(r["length"], r["n_places"], r["first_key"]) for r in rows} == {(1, 150, 0)}


def chain_plainly(rows):
    order = sorted(rows)
    best = {}
    for r in order:
        best[r] = r[2] + max((best[s] for s in best if s[0] + s[2] <= r[0] and s[1] + s[2] <= r[1]), default=0)
    return max(best.values(), default=0)


def test_best_chain():
    rng = random.Random(6)
    for n in [0, 1, 2, 5, 30] * 20:
        rows = list({(rng.randrange(40), rng.randrange(40), rng.randrange(1, 8)) for _ in range(n)})
        chain = [rows[i] for i in repeats.best_chain(rows)]
        for s, r in itertools.pairwise(chain):
            assert s[0] + s[2] <= r[0] and s[1] + s[2] <= r[1]
        assert sum(r[2] for r in chain) == chain_plainly(rows)


def test_alignment_of_texts(spark):
    docs = {1: "abcdefgh--ijklm", 2: "ijklm..abcdefgh", 3: "abcdXefgh", 4: "zzz", 5: "abcdefgh--ijklm"}
    found = stored(sequences(spark, docs))
    pairs = stored(repeats.anchors(found, "id", 1))
    for r in pairs.collect():
        a, b, n = docs[r["a"]][r["a_pos"] :], docs[r["b"]][r["b_pos"] :], r["length"]
        assert r["a"] < r["b"] and a[:n] == b[:n] and (a[n : n + 1] != b[n : n + 1] or not a[n:])
    blocks = repeats.with_lines(repeats.aligned(pairs), found, "id", 1).collect()
    assert {(r["a"], r["b"], r["a_start"], r["a_end"], r["b_start"], r["b_end"], r["length"]) for r in blocks} >= {(1, 5, 1, 15, 1, 15, 15)}
    groups = {}
    for r in blocks:
        groups.setdefault((r["a"], r["b"]), []).append(r)
    for held in groups.values():
        held.sort(key=lambda r: r["a_start"])
        assert all(s["a_end"] < r["a_start"] and s["b_end"] < r["b_start"] for s, r in itertools.pairwise(held))
    ids = {r["key"] for r in clones.interval_groups(spark.createDataFrame(blocks)).collect()}
    assert ids == {1, 2, 3, 5}


def test_merged_intervals(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(3), s, s + rng.randrange(-1, 9)) for s in (rng.randrange(80) for _ in range(60))] + [(7, 5, None), (None, 1, 2), (None, 3, 3)]
    df = spark.createDataFrame(rows, "id long, start_line long, end_line long").repartition(5)
    covered = {}
    for k, s, e in rows:
        if e is not None and s <= e:
            covered.setdefault(k, set()).update(range(s, e + 1))
    lengths = {r["id"]: r["length"] for r in intervals.covered_length(df, "id", "start_line", "end_line").collect()}
    assert lengths == {k: len(v) for k, v in covered.items()}
    spans = {}
    for r in intervals.merged(df, "id", "start_line", "end_line").collect():
        assert r["start_line"] - 1 not in covered[r["id"]] and r["end_line"] + 1 not in covered[r["id"]]
        spans.setdefault(r["id"], []).extend(range(r["start_line"], r["end_line"] + 1))
    assert {k: sorted(v) for k, v in spans.items()} == {k: sorted(v) for k, v in covered.items()}


def test_released_tables_are_gone(spark):
    df = stored(spark.range(3))
    path = df.inputFiles()[0].removeprefix("file://")
    release(df, None, spark.range(2))
    with pytest.raises(FileNotFoundError):
        open(path)


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(201, 260)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(25)] + [(500, 500), (7, 7), (3, 2)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = sorted((x, find(x)) for x in root)
    edges = spark.createDataFrame(links, "u long, v long")
    assert sorted(map(tuple, components(edges).collect())) == want
    pair = lambda c: F.struct((F.col(c) % 1000).alias("key"), F.lit("x").alias("name"))
    named = components(edges.select(pair("u").alias("u"), pair("v").alias("v"))).select("node.key", "component.key").collect()
    assert sorted(map(tuple, named)) == want
    assert components(edges.limit(0)).collect() == []


def test_chunks_deal_only_what_is_counted(spark, monkeypatch):
    """Texts once went through the running counts, and lines did so twice over, raw and normalised."""
    dealt = []
    monkeypatch.setattr(chunks, "running", lambda rows, *rest, **more: dealt.append(rows.columns) or scans.running(rows, *rest, **more))
    rows = chunks.lines(spark.createDataFrame([(1, 0, "a\nb"), (1, 1, "c\nd\n"), (None, 0, "e")], "id long, chunk long, part string"), "id")
    assert sorted(map(tuple, rows.collect()), key=repr) == [(1, 1, "a"), (1, 2, "bc"), (1, 3, "d"), (None, 1, "e")]
    found = chunks.windows(rows.withColumn("norm", F.upper("raw")), "id", 3)
    assert [tuple(r)[:4] for r in found.collect()] == [(1, 0, 1, 3)]
    assert dealt == [["id", "chunk", "__breaks"], ["id", "line_no", "norm"]]
