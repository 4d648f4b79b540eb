import json

import pytest
from pyspark.sql import functions as F

from sieveline.operators import coverage, lines, structure
from sieveline.operators import ast_rules as A
from sieveline.operators import clones
from sieveline.operators.storage import numbered
from sieveline.sources import logs, records, trees


def runs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "run long, log string")


def test_file_statistics(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "build").mkdir()
    (tmp_path / "src/a.py").write_text('# c\n\n"""doc"""\nx = 1\n')
    (tmp_path / "src/b.cpp").write_text("/* a\n\nx */\n/* one */ int y;\nint z; // t\n// c\n")
    (tmp_path / "build/c.py").write_text("x = 1\n")
    files = trees.source_files(spark, str(tmp_path), (".py", ".cpp"))
    got = {r["path"]: (r["lang"], r["code"], r["comment"], r["blank"], r["total"]) for r in lines.file_statistics(files).collect()}
    assert got == {"src/a.py": ("Python", 2, 1, 1, 4), "src/b.cpp": ("C++", 1, 4, 1, 6)}
    assert trees.project_type(files).first()[0] == "hybrid"
    assert trees.in_roots(files).count() == 2


def test_pytest_log(spark):
    got = {r["run"]: tuple(r)[1:] for r in logs.pytest_totals(runs(spark, "t/a.py::x PASSED [1%]\nt/a.py::y FAILED\n1 passed", "== 3 passed, 2 failed in 1s ==", "nothing"), "run").collect()}
    assert got == {0: (1, 2, True), 1: (3, 5, True), 2: (0, 0, False)}


def test_unittest_log(spark):
    rows = logs.unittest_results(runs(spark, "test_a (m.T) ... ok\ntest_b (m.T) ... FAIL\nother"), "run").orderBy("line_no").collect()
    assert [(r["target_name"], r["status"]) for r in rows] == [("test_a (m.T)", "PASS"), ("test_b (m.T)", "FAIL")]


def test_diagnostics(spark):
    text = "  3 | early\na.c:3:5: error: bad\n   3 | x;\n     | ^\nIn file included from b.h:1:\nb.c:9: warning: hm\nstrange"
    parts = [r["part"] for r in logs.diagnostics(runs(spark, text), "run").orderBy("line_no").collect()]
    assert parts == ["malformed", "diagnostic", "context", "context", "context", "diagnostic", "malformed"]


def test_type_and_format_runs(spark):
    typed = {r["run"]: (r["success"], r["well_formed"], r["n_errors"]) for r in logs.type_check_runs(runs(spark, "Success: no issues found in 3 source files", "a.py:1: error: x\na.py:2: note: y\nFound 1 error in 1 file (checked 2 source files)", "garbage"), "run").collect()}
    assert typed == {0: (True, True, 0), 1: (False, True, 1), 2: (False, False, 0)}
    formatted = {r["run"]: (r["files"], r["well_formed"]) for r in logs.formatter_runs(runs(spark, "Would reformat: a.py\n1 file would be reformatted, 2 files already formatted", "Would reformat: a.py\n2 files would be reformatted", "Would reformat: a.py"), "run").collect()}
    assert formatted == {0: (["a.py"], True), 1: ([], False), 2: ([], False)}


def test_blocks_and_warnings(spark):
    got = [r["message"] for r in logs.warning_blocks(runs(spark, "warning: a\n  more\nwarning: b"), "run").orderBy("block").collect()]
    assert got == ["warning: a\n  more", "warning: b"]
    assert logs.resource_warnings(runs(spark, "x.py:3: ResourceWarning: y"), "run").first()["start_line"] == 3
    log = runs(spark, "==12== ERROR: AddressSanitizer: heap", "a.c:1:2: runtime error: overflow", "fine").orderBy("run")
    assert [r[0] for r in log.select(logs.sanitizer_hit(F.col("log"))).collect()] == [True, True, False]


def test_gcov(spark):
    text = "        -:    0:Source:a.c\n        5:    1:int a;\n       2*:    2:b;\n    #####:    4:c;\n    =====:    5:d;\nbranch  0 taken 50%\nbranch  1 taken 0%\nfunction f called 1\nfunction g called 0"
    files = spark.createDataFrame([("a.c", text), ("t.c", "        -:    1:x")], "file string, content string")
    row = logs.gcov_modules(files, "file").collect()
    assert [(r["stmts"], r["covered"], r["miss"], r["cover"], r["branch_cover"], r["missing_lines"]) for r in row] == [(3, 2, 1, 66.7, 50.0, [4])]
    assert {r["name"]: r["covered"] for r in logs.gcov_functions(files, "file").collect()} == {"f": True, "g": False}


def counts(c, n, m, b, cb):
    return dict(zip(records.COUNTERS, (c, n, m, b, cb)))


def document(change=None):
    files = {
        "a.py": {"executed_lines": [1, 2], "missing_lines": [3, 4], "summary": counts(2, 4, 2, 4, 2)},
        "b.py": {"executed_lines": [1, 2, 3], "missing_lines": [], "summary": counts(3, 3, 0, 2, 2)},
    }
    doc = {"totals": counts(5, 7, 2, 6, 4), "files": files}
    if change:
        change(doc)
    return json.dumps(doc)


def test_coverage_documents(spark):
    def overlapping(d):
        d["files"]["a.py"]["missing_lines"] = [2, 4]

    def zero(d):
        d["files"]["a.py"]["executed_lines"] = [0, 2]

    def sums(d):
        d["totals"]["covered_lines"] = 4

    docs = spark.createDataFrame(list(enumerate([document(), document(overlapping), document(zero), document(sums), "{}", "no json"])), "k long, j string")
    records_ = coverage.checked_documents(records.coverage_documents(docs, "k", "j"))
    total = coverage.totals(records_).collect()
    assert [(r["doc"], r["stmts"], r["miss"], r["cover"], r["branch_cover"]) for r in total] == [(0, 7, 2, 71.4, 66.7)]
    assert [r["file"] for r in coverage.module_rows(records_).collect()] == ["a.py", "b.py"]
    functions = spark.createDataFrame([("a.py", "f", 1, 3), ("a.py", "g", 4, 9)], "file string, name string, body_start long, end_line long")
    rows = coverage.function_rows(functions, records_)
    assert {r["name"]: (r["covered"], r["missing_lines"]) for r in rows.collect()} == {"f": (True, [3]), "g": (False, [4])}
    runs_ = spark.createDataFrame([("m", 9, False, 66.7), ("n", 9, True, None), ("o", 9, False, None), ("p", 0, True, None)], "run string, code_lines long, has_failure boolean, branch_cover double")
    shares = coverage.function_share(rows.withColumn("run", F.lit("m")), runs_, "run").collect()
    assert {r["run"]: (r["branch_cover"], r["func_cover"]) for r in shares} == {"m": (66.7, 50.0), "n": (45.0, 50.0), "o": (85.0, 95.0), "p": (100.0, 100.0)}
    modules = coverage.module_rows(records_)
    both = coverage.combined(modules, modules.withColumn("file", F.concat(F.lit("n/"), "file")))
    assert tuple(coverage.combined_totals(both).first()) == (14, 4, 71.4, 66.7)


def test_lint_and_reports(spark):
    good = json.dumps([{"filename": "a.py", "code": None, "message": "m", "location": {"row": 3, "column": 1}}])
    rows = {r["run"]: (r["status"], r["start_line"], r["target_name"]) for r in records.lint_findings(runs(spark, good, "[1", '[{"message": 1}]'), "run", "log").collect()}
    assert rows == {0: ("FAIL", 3, "syntax"), 1: ("ERROR", 1, "output"), 2: ("ERROR", 1, "output")}
    saved = json.dumps({"results": [{"engine_name": "a", "status": "PASS"}, {"engine_name": "b", "status": "ODD"}, {"status": "PASS"}]})
    assert [tuple(r)[1:3] for r in records.saved_reports(runs(spark, saved), "run", "log").collect()] == [("a", "PASS")]
    assert runs(spark, '{"issue": {"number": 7}}').select(records.change_number(F.col("log"))).first()[0] == 7
    assert {r["name"]: r["value"] for r in records.key_values(runs(spark, 'ID="x"\n#c=1\nV=a=b'), "run", "log").collect()} == {"ID": "x", "V": "a=b"}


CPP = "int f(int a) {\n  if (a && b) {\n    for (;;) { x; }\n  }\n}\n\nvoid g() {\n  y;\n}\n"


def test_heuristic_functions(spark):
    files = spark.createDataFrame([("a.cpp", CPP)], "path string, content string")
    rows = structure.heuristic_functions(files).orderBy("start_line").collect()
    assert [(r["name"], r["start_line"], r["end_line"], r["complexity"], r["nesting"]) for r in rows] == [("f", 1, 5, 3, 3), ("g", 7, 9, 1, 1)]


PY = """
def dispatch(x, y):
    match x:
        case 1 if y: pass
        case 2 if not y: pass
        case _: pass
    z = 1 if x else 2
    return [a for a in y if a] and (x or y)
"""


def test_complexity_and_rules():
    rows = A.rules("a.py", PY)
    assert next(r[5] for r in rows if r[1] == "complexity") == "8"
    code = "try:\n    a()\nexcept:\n    b()\ntry:\n    c()\nexcept Exception as e:\n    raise e\ntry:\n    d()\nexcept ValueError:\n    ...\n"
    assert {r[1] for r in A.rules("a.py", code)} == {"bare-except", "lost-traceback", "swallowed", "inspected"}
    assert [r[1] for r in A.rules("a.py", "def (")] == ["syntax"]
    body = "def f():\n    try:\n        return 1\n        a\n    finally:\n        raise X\n        b\n"
    assert [r[2] for r in A.rules("a.py", body) if r[1] == "unreachable"] == [4, 7]


def base(code):
    return any(r[1] == "base-exception" for r in A.rules("a.py", code))


def test_base_exception_names():
    handler = "try:\n    a()\nexcept {}:\n    b()\n"
    assert base(handler.format("BaseException")) and base(handler.format("(ValueError, BaseException)"))
    assert base("import builtins as q\n" + handler.format("q.BaseException"))
    assert base("from builtins import BaseException as B\n" + handler.format("B"))
    assert base("E = BaseException\n" + handler.format("E"))
    assert not base("E = BaseException\nE = ValueError\n" + handler.format("E"))
    assert base("E = ValueError\nif x:\n    E = BaseException\n" + handler.format("E"))
    assert not base("BaseException = ValueError\n" + handler.format("BaseException"))


def test_masked_source():
    text = 'a = "x//y"; // c\nR"d(b"c)d" + \'q\' /* m\nn */ z\n'
    out = A.masked_source(text)
    assert len(out) == len(text) and out.count("\n") == text.count("\n")
    assert out.split() == ["a", "=", ";", "+", "z"]


def test_native_exceptions(spark):
    files = spark.createDataFrame([("a.cpp", 'try { f(); }\ncatch (...) {\n}\n"catch (...) {}"\ntry { g(); } catch(...) { }\n')], "path string, content string")
    assert [r["start_line"] for r in A.native_exception_rows(files).orderBy("start_line").collect()] == [2, 5]


def status(spark, files):
    rows = A.dead_code(spark.createDataFrame(files, "path string, content string")).collect()
    return {(r["file"], r["name"]): r["status"] for r in rows}


def test_dead_code(spark):
    got = status(
        spark,
        [
            ("src/p/__init__.py", ""),
            ("src/p/a.py", "def _x(): pass\ndef _y(): pass\n@dec\ndef _z(): pass\ndef __w(): pass\nclass C:\n    def _m(self): pass\n"),
            ("src/p/b.py", "from p.a import _x\n_x()\ndef _x(): pass\n"),
            ("src/p/c.py", "from p import a\na._y()\n"),
            ("src/p/d.py", "__all__ = ['_e']\ndef _e(): pass\ndef _f(): pass\n"),
            ("src/p/e.py", "from . import d\nd._f()\ndef _g(): pass\n"),
        ],
    )
    assert got == {("src/p/a.py", "_x"): "PASS", ("src/p/a.py", "_y"): "PASS", ("src/p/b.py", "_x"): "PASS", ("src/p/d.py", "_f"): "PASS", ("src/p/e.py", "_g"): "WARN"}


def body(names):
    a, b, c, d = names
    return f"def {a}({b}):\n    {c} = 0\n    for {d} in {b}:\n        if {d}:\n            {c} += {d}\n        else:\n            {c} -= 1\n    print({c})\n    return {c}\n"


def test_clones_of_renamed_code(spark):
    files = spark.createDataFrame([("core.py", body("abcd")), ("refund.py", body(["total", "items", "acc", "it"])), ("other.py", "x = 1\n")], "path string, text string")
    code = clones.code_lines(files, "path")
    found = clones.windows(code, "path")
    pairs = clones.candidate_pairs(found, "path")
    blocks = clones.unsubsumed(clones.matched_blocks(code, pairs, "path")).collect()
    assert [tuple(r) for r in blocks] == [("core.py", "refund.py", 1, 9, 1, 9, 9)]
    assert [(r["a_pos"], r["b_pos"], r["length"]) for r in clones.runs(found, "path").collect()] == [(0, 0, 9)]
    assert {(r["group_id"], r["member"], r["n_members"]) for r in clones.clone_groups(found, "path").collect()} == {(1, "core.py", 2), (1, "refund.py", 2)}


def test_clones_within_one_file(spark):
    files = spark.createDataFrame([("a.py", body("abcd") + "x = 1\n" + body("efgh"))], "path string, text string")
    found = clones.windows(clones.code_lines(files, "path"), "path")
    assert [(r["a_pos"], r["b_pos"], r["length"]) for r in clones.self_runs(found, "path").collect()] == [(0, 10, 9)]


def test_clone_report(spark):
    files = spark.createDataFrame([("a.py", body("abcd") + "x = 1\n" + body("efgh")), ("b.py", "# c\n" + body(["total", "items", "acc", "it"])), ("c.py", "y = 2\n")], "path string, text string")
    groups = clones.clone_report(files, "path")
    rows = groups.collect()
    assert {(r["group_id"], r["lines_count"], r["n_occurrences"]) for r in rows} == {(1, 9, 3)}
    assert {(r["key"], r["start_line"], r["end_line"], r["first"]) for r in rows} == {("a.py", 1, 9, True), ("a.py", 11, 19, False), ("b.py", 2, 10, False)}
    assert clones.repeated_lines(groups).count() == 18
    found = clones.clone_findings(groups, files, "path").collect()
    assert len(found) == 3 and all(r["snippet"].startswith("def a(b):") for r in found)


def test_copies_are_rows_and_not_pairs(spark):
    whole, grown = body("abcd"), body("abcd").replace("    print", "    extra = [1]\n    print")
    named = [(f"a{k}.py", whole + "x = 1\n" + body("efgh")) for k in range(9)] + [(f"b{k}.py", grown) for k in range(3)] + [("c.py", "\n" + whole), ("d.py", "y = 2\n")]
    files = spark.createDataFrame(named, "path string, text string")
    code = clones.code_lines(files, "path")
    found = clones.windows(code, "path")
    every = clones.unsubsumed(clones.matched_blocks(code, clones.candidate_pairs(found, "path"), "path"))
    rows = clones.clone_blocks(files, "path").collect()
    assert sum(r["copy"] for r in rows) == 10 and len({(r["a"], r["b"]) for r in rows if not r["copy"]}) == 3
    members = {r["a"]: [r["a"]] for r in rows}
    members |= {r["b"]: [r["b"]] for r in rows if not r["copy"] and r["b"] not in members}
    for r in rows:
        members[r["a"]] += [r["b"]] if r["copy"] else []
    expanded = set()
    for r in rows:
        a_s, b_s = (members[r["a"]], members[r["a"]]) if r["copy"] else (members[r["a"]], members[r["b"]])
        for a, b in ((a, b) for a in a_s for b in b_s if a != b):
            a_place, b_place = (a, r["a_start"], r["a_end"]), (b, r["b_start"], r["b_end"])
            expanded.add((*min(a_place, b_place), *max(a_place, b_place), r["length"]))
    assert expanded == {(r["a"], r["a_start"], r["a_end"], r["b"], r["b_start"], r["b_end"], r["length"]) for r in every.collect()}
    by_pairs = clones.interval_groups(every.unionByName(clones.unsubsumed(clones.self_matches(code, found, "path"))))
    assert sorted(clones.clone_report(files, "path").collect()) == sorted(by_pairs.collect())


def test_inserted_line(spark):
    whole = body("abcd")
    lines_ = whole.splitlines(keepends=True)
    files = spark.createDataFrame([("a.py", whole), ("b.py", "".join(lines_[:7]) + "extra = [1]\n" + "".join(lines_[7:]))], "path string, text string")
    rows = clones.clone_report(files, "path").collect()
    assert {(r["key"], r["start_line"], r["end_line"]) for r in rows} == {("a.py", 1, 7), ("b.py", 1, 7)}


def test_ranks_over_many_ranges(spark):
    rows = spark.range(500).select(((F.col("id") * 37) % 500).alias("v"), (F.col("id") % 7).alias("w")).repartition(5)
    got = numbered(rows, [F.desc("w"), F.col("v")], "place").collect()
    want = sorted(((-r["w"], r["v"]) for r in got))
    assert [(-r["w"], r["v"]) for r in sorted(got, key=lambda r: r["place"])] == want and sorted(r["place"] for r in got) == list(range(1, 501))


def test_languages(spark):
    files = spark.createDataFrame([(f"src/a{s}", "x = 1\n") for s in (*lines.LANGUAGES, ".txt", "")], "path string, content string")
    got = {r["path"]: r["lang"] for r in lines.file_statistics(files).collect()}
    assert got == {"src/a.py": "Python", "src/a.sh": "Shell", "src/a.csh": "Shell", "src/a.toml": "TOML", "src/a.md": "Markdown", "src/a.yml": "YAML", "src/a.yaml": "YAML", "src/a.json": "JSON", **{f"src/a{s}": "C++" for s in (".cpp", ".c", ".h", ".hpp", ".cc", ".cxx")}}


def test_roots():
    assert trees.source_roots() == trees.DEFAULT_ROOTS and trees.source_roots(("a/../b",)) == ("a/../b",)
    for bad in ("", "/x", "../x", "a/../../b", 3):
        with pytest.raises(ValueError):
            trees.source_roots((bad,))
