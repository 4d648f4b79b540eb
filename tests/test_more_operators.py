import hashlib
import json
import random
import re

from conftest import SF
from pyspark.sql import functions as F

from sieveline.functions import policy
from sieveline.functions import text as T
from sieveline.operators import ast_rules as A
from sieveline.operators import checks as C
from sieveline.operators import coverage, intervals, structure
from sieveline.plans import catalog
from sieveline.sources import logs, records


def test_links_and_names(spark):
    one = spark.createDataFrame([("https://h.x/r/", "a b", "src/ü.py", 3, 5)], "b string, r string, p string, s int, e int")
    assert one.select(T.permalink(*[F.col(c) for c in "brpse"])).first()[0] == "https://h.x/r/blob/a%20b/src/%C3%BC.py#L3-L5"
    assert one.select(T.permalink(F.lit("javascript:x"), *[F.col(c) for c in "rpse"])).first()[0] is None
    names = spark.createDataFrame([("1.2",), ("v3",), ("x",)], "v string")
    assert [r[0] for r in names.select(T.release_name(F.col("v"))).collect()] == ["v1.2", "v3", "vx"]
    assert spark.range(1).select(T.simple_code_lines(F.lit("# a\n\n/* b\nc\n// d\ne")), T.within(F.lit("/r/a/../b"), "/r"), T.within(F.lit("/r/a"), "/r")).first()[:] == (2, False, True)


def test_policies(spark):
    rows = spark.createDataFrame([(False, False, 0, True, 0), (False, False, 1, True, 2), (True, False, 0, True, 0), (False, False, 1, False, 0), (False, False, 2, True, 0)], "t boolean, c boolean, r int, w boolean, n int")
    assert [r[0] for r in rows.select(policy.formatter_verdict(*[F.col(c) for c in "tcrwn"])).collect()] == ["PASS", "WARN", "ERROR", "ERROR", "ERROR"]
    runs = spark.createDataFrame([("a", 0, False, False, None), ("b", -9, False, False, None), ("c", None, True, False, None)], "name string, returncode int, timed_out boolean, truncated boolean, error string")
    assert [r["problem"] for r in policy.evidence_rows(runs).orderBy("name").collect()] == [None, "ended by signal 9", "timed out"]
    assert [r[0] for r in spark.createDataFrame([(95.0,), (80.0,), (1.0,), (None,)], "p double").select(policy.coverage_colour(F.col("p"))).collect()] == ["green", "yellow", "red", "grey"]
    yes, no = F.lit(True), F.lit(False)
    label = spark.range(1).select(coverage.source_label(yes, no, yes, yes), coverage.source_label(yes, yes, yes, yes), coverage.source_label(no, no, yes, yes), coverage.source_label(no, yes, no, yes)).first()
    assert tuple(label) == ("coverage.py (partial)", "coverage.py/gcov", "estimated", "gcov")
    low = spark.range(1).select(*[policy.below_threshold(F.lit(1), F.lit(1), F.lit(1), 2, 2, 2, F.lit(f), F.lit(o)) for f, o in ((False, False), (True, False), (False, True), (True, True))]).first()
    assert tuple(low) == (True, False, True, True)


def test_log_helpers(spark):
    logs_ = spark.createDataFrame([("3 passed",), ("0 passed",), ("Ran 2 tests",), ("no tests ran",)], "t string")
    assert [r[0] for r in logs_.select(logs.executed(F.col("t"))).collect()] == [True, False, True, False]
    seen = spark.createDataFrame([("k", "b", 1), ("k", "a", 2), ("k", "b", 3)], "k string, v string, n int")
    assert logs.first_occurrences(seen, "k", "v", "n").first()["values"] == ["b", "a"]
    parts = spark.createDataFrame([(1, 2, True), (3, 3, False)], "passed long, total long, has_failure boolean")
    assert tuple(logs.merged_totals(parts).first()) == (4, 5, True) and tuple(logs.merged_totals(parts.limit(0)).first()) == (0, 0, False)
    files = spark.createDataFrame([("int main() {}",), ("x",)], "c string")
    assert tuple(logs.pattern_count(files, "c", r"\bint\s+main\s*\(").first()) == (1, True)


def test_records(spark):
    runs = spark.createDataFrame([(1, '[{"filename": "a"}, {"filename": "a"}]'), (2, "[{}]"), (3, "[]")], "k int, j string")
    got = {(r["k"], r["file_path"], r["well_formed"]) for r in records.formatter_findings(runs, "k", "j").collect()}
    assert got == {(1, "a", True), (2, None, False), (3, None, True)}
    found, over = (spark.createDataFrame(rows, "host string, name string, available boolean") for rows in ([("h", "gcc", False), ("h", "x", True)], [("h", "gcc", True)]))
    rows = {r["name"]: (r["available"], r["required"]) for r in records.capabilities(found, over, "host", ("gcc",)).collect()}
    assert rows == {"gcc": (True, True), "x": (True, False)}


def test_reports(spark):
    checks = spark.createDataFrame([("a", "FAIL", True, "MEASURED"), ("b", "PASS", True, "MEASURED")], "check string, status string, required boolean, evidence string")
    findings = spark.createDataFrame([("a", 'x"</script>', "FAIL"), ("a", "y", "PASS")], "check string, target string, status string")
    got = json.loads(C.suite_json(checks, findings, "check").first()["json"])
    assert got["suite_status"] == "FAIL" and [len(r["targets"]) for r in got["results"]] == [2, 0] and got["results"][0]["targets"][0]["target"] == 'x"</script>'
    assert {r["check"]: len(r["issues"]) for r in C.summary_rows(checks, findings, "check").collect()} == {"a": 1, "b": 0}


def test_joins(spark):
    names = spark.createDataFrame([("a/b/c",), ("a/bc",), ("a",)], "n string")
    prefixes = spark.createDataFrame([("a/b",), ("a",)], "p string")
    assert {(r["n"], r["p"]) for r in intervals.by_prefix(names, prefixes, "n", "p").collect()} == {("a/b/c", "a/b"), ("a/b/c", "a"), ("a/bc", "a"), ("a", "a")}
    probes = spark.createDataFrame([(1, 5, 9), (1, 3, 8), (2, 1, 7)], "k long, t long, id long")
    events = spark.createDataFrame([(1, 3, "x", 1), (1, 3, "y", 2), (1, 5, "z", 3)], "k long, t long, v string, e long")
    assert {r["id"]: r["as_of"] for r in intervals.as_of(probes, events, "k", "t", "v", "e").collect()} == {9: "y", 8: None, 7: None}
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "xquick brownx"), (3, None)], "d long, t string")
    needles = spark.createDataFrame([(1, "e quick br"), (2, "quick"), (3, "ick brown f"), (4, "x"), (5, "nx"), (6, ""), (7, "zebra the quick"), (8, "w")], "n long, s string")
    got = {(r["n"], r["d"]) for r in intervals.containing(docs, needles, "d", "t", "n", "s").collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (3, 1), (4, 1), (4, 2), (5, 2), (6, 1), (6, 2), (8, 1), (8, 2)}
    assert intervals.containing(docs, needles.limit(0), "d", "t", "n", "s").count() == 0


def test_depth(spark):
    pages = spark.createDataFrame([(1, "<div><ul><li>x</li></ul></DIV><p >")], "k long, h string")
    rows = structure.running_depth(structure.tags(pages, "k", "h"), "k").orderBy("pos").collect()
    assert [r["depth"] for r in rows] == [1, 2, 3, 2, 1, 0, 1]


def test_destructors(spark):
    code = 'struct A {\n  ~A() noexcept {\n    // throw x\n    if (b) { throw 1; }\n  }\n  void f() { throw 2; }\n};\nB::~B()\n{\n  throw "}";\n}\n'
    files = spark.createDataFrame([("a.cpp", code)], "path string, content string")
    assert [r["start_line"] for r in A.destructor_rows(files).orderBy("start_line").collect()] == [4, 10]


def test_a_broken_file_silences_the_rest(spark):
    files = spark.createDataFrame([("a.py", "def _x(): pass\n"), ("b.py", "def (\n")], "path string, content string")
    assert [(r["file"], r["status"]) for r in A.dead_code(files).collect()] == [("b.py", "ERROR")]


def normalised(line):
    """One substitution from left to right."""

    def put(found):
        token = found.group(0)
        if token[0] in "'\"" or token[0].isdigit():
            return "LIT"
        return token if token in T.KEPT_WORDS else "ID"

    tokens = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|\b\d+(?:\.\d+)?\b|\b[A-Za-z_]\w*\b"""
    return "".join(c for c in re.sub(tokens, put, line) if not c.isspace())


def test_normalised_tokens_as_one_pass(spark):
    pick = random.Random(1)
    parts = ["12", "3.5", "12abc", "été", "x1", "if", "iffy", "'a b'", '"q\\""', "'open", ".", " ", "\t", "_", "日本", "٣", "½", "+=", "\x1c", "a.b", "\\", "returns", "not", "\u2003"]
    cases = ["".join(pick.choices(parts, k=pick.randint(1, 12))) for _ in range(3000)]
    rows = spark.createDataFrame([(c,) for c in cases], "s string").select("s", T.normalised_tokens(F.col("s")).alias("n")).collect()
    assert [r["n"] for r in rows] == [normalised(r["s"]) for r in rows]


def test_all_lines_are_normalised(spark, tmp_path):
    texts = ["Der Hund für die Straße 12.5\n\n  été = 'où' + \"ñandú\"  \nif Ça_va: return x1", "été\r\nплюс 3 für", "plain words only\n日本 x", "", " \n\t", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for path, rows in ((str(tmp_path), list(enumerate(texts))), (SF, [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()])):
        for k, text in rows:
            lines = [x.strip() for x in re.split(r"\r\n|\n|\r", text or "") if x.strip()]
            want[k] = (len(lines), hashlib.md5("\n".join(map(normalised, lines)).encode()).hexdigest())
        got = {r["doc_id"]: (r["n_lines"], r["digest"]) for r in catalog.QUERIES["q_normalise_lines"](spark, path).collect()}
        assert got == want
        want = {}


def test_whole_pages_are_reported(spark, tmp_path):
    html = "x" * 300 + "<a|b>`100%\r\nend"
    spark.createDataFrame([(1, "http://h/a", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, 0, 1)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    annotation = catalog.QUERIES["q_annotations"](spark, str(tmp_path)).first()["annotation"]
    assert annotation.endswith("x" * 300 + "<a|b>`100%25%0D%0Aend")
    assert catalog.QUERIES["q_markdown_rows"](spark, str(tmp_path)).first()["row"].endswith("x" * 300 + "&lt;a&#124;b&gt;&#96;100%<br>end |")


def test_whole_items_are_contained(spark, tmp_path):
    item = "a passage that opens with these same words and then goes on"
    spark.createDataFrame([(1, item), (2, "a short one")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, f"x {item} y"), (2, item[:45] + " elsewhere"), (3, "not a short one at all")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, catalog.QUERIES["q_contains_join"](spark, str(tmp_path)).collect())) == [(1, 1), (2, 3)]
