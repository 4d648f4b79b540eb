import pytest
from pyspark.sql import functions as F

from sieveline.functions import policy
from sieveline.functions import text as T
from sieveline.operators import checks as C


def suite(spark, rows):
    df = spark.createDataFrame(rows, "engine_name string, status string, required boolean, evidence string")
    return policy.suite_status(df).first()


@pytest.mark.parametrize(
    "rows, status",
    [
        ([], "ERROR"),
        ([("a", "SKIP", True, "ESTIMATED")], "ERROR"),
        ([("a", "PASS", True, "NOT_RUN")], "ERROR"),
        ([("a", "ERROR", False, "NOT_RUN")], "WARN"),
        ([("a", "FAIL", False, "MEASURED")], "WARN"),
        ([("a", "SKIP", False, "ESTIMATED")], "WARN"),
        ([("a", "PASS", False, "ESTIMATED")], "WARN"),
        ([("a", "PASS", False, "MEASURED")], "PASS"),
        ([("a", "PASS", True, "ESTIMATED")], "PASS"),
        ([("a", "ERROR", False, "NOT_RUN"), ("b", "FAIL", True, "MEASURED")], "FAIL"),
        ([("a", "FAIL", False, "MEASURED"), ("b", "ERROR", True, "NOT_RUN")], "ERROR"),
    ],
)
def test_suite_status(spark, rows, status):
    assert suite(spark, rows)["suite_status"] == status


@pytest.mark.parametrize(
    "line, branch, func, passed, total, score",
    [(90.0, None, 100.0, 1, 1, 5.0), (40.0, None, 100.0, 1, 1, 2.5), (None, 60.0, 80.0, 9, 10, 3.38), (70.0, None, 95.0, 9, 10, 3.74), (None, 60.0, 95.0, 10, 10, 4.45), (90.0, None, 100.0, 0, 0, 0.0)],
)
def test_effectiveness(spark, line, branch, func, passed, total, score):
    df = spark.createDataFrame([(line, branch, 45.0, func, passed, total)], "line double, branch double, est double, func double, passed long, total long")
    got = df.select(policy.effectiveness(*[F.col(c) for c in df.columns]).alias("s")).first()["s"]
    assert got == pytest.approx(score)


def test_thresholds_and_modes(spark):
    df = spark.createDataFrame([(500,), (501,), (1001,)], "n long")
    assert [r[0] for r in df.select(policy.two_thresholds(F.col("n"), 500, 1000)).collect()] == ["PASS", "WARN", "FAIL"]
    assert [r[0] for r in df.select(policy.two_thresholds(F.col("n"), 500, 1000, F.lit(False))).collect()] == ["PASS"] * 3
    one = spark.range(1)
    by = lambda f, w, m: one.select(policy.by_mode(F.lit(f), F.lit(w), m)).first()[0]
    assert [by(False, True, m) for m in ("pass_warn_fail", "pass_fail", "pass_warn", "other")] == ["WARN", "FAIL", "WARN", "WARN"]
    assert by(True, False, "pass_warn") == "WARN"
    assert one.select(policy.complexity_status(F.lit(10), F.lit(5))).first()[0] == "WARN"
    status, evidence = policy.scope_status(F.lit(0), F.lit(1), F.lit(1), F.lit(False), F.lit(False))
    assert tuple(one.select(status, evidence).first()) == ("WARN", "ESTIMATED")


HOSTILE = "a|b`c\"d'</script>\n%x:,\r```"


def test_escapes(spark):
    df = spark.createDataFrame([(HOSTILE,)], "s string")
    cell, command, prop, fence = df.select(T.cell_escaped(F.col("s")), T.command_escaped(F.col("s")), T.command_escaped(F.col("s"), True), T.fence_for(F.col("s"))).first()
    assert not set("|`<>\n\r") & set(cell.replace("<br>", ""))
    assert "\n" not in command and "%25x" in command and ":" in command
    assert ":" not in prop and "," not in prop
    assert fence == "````"


def test_text_functions(spark):
    df = spark.createDataFrame([(1, "a\r\nb\rc\n"), (2, ""), (3, None), (4, "\n\n")], "k long, t string")
    assert [r[0] for r in df.orderBy("k").select(T.lines_of(F.col("t"))).collect()] == [["a", "b", "c"], [], [], ["", ""]]
    s = spark.createDataFrame([("\u2003\x1c x \xa0",)], "s string")
    assert s.select(T.stripped(F.col("s"))).first()[0] == "x"
    paths = spark.createDataFrame([("src/pkg/a.py",), ("src/pkg/__init__.py",), ("build/x.py",), ("src/v1.2/x.py",)], "p string")
    rows = paths.select(T.module_name(F.col("p")), T.ignored_path(F.col("p"))).collect()
    assert [tuple(r) for r in rows][:2] == [("pkg.a", False), ("pkg", False)] and rows[2][1] and rows[3][1]


@pytest.mark.parametrize("line, want", [("if x1 == 'a b' and y: return 3.5", "ifID==LITandID:returnLIT"), ('tété = "q"', "ID=LIT"), ("x = 'open", "ID='ID"), ("", "")])
def test_normalised_tokens(spark, line, want):
    assert spark.createDataFrame([(line,)], "s string").select(T.normalised_tokens(F.col("s"))).first()[0] == want


def test_report_rows(spark):
    checks = spark.createDataFrame([("c1", "PASS", "fine"), ("c2", "ERROR", "a|b")], "check string, status string, summary string")
    assert "a&#124;b" in C.markdown_report(checks, "check").first()[0]
    findings = spark.createDataFrame([("c1", "t", "PASS"), ("c3", "u", "WARN")], "check string, target string, status string")
    found = {tuple(r) for r in C.issues(checks.select("check", "status"), findings, "check").collect()}
    assert found == {("c3", "u", "WARN"), ("c2", None, "ERROR")}
    detail = spark.createDataFrame([("c", "f", k, "FAIL", "m", "```x```") for k in range(9)], "check string, file_path string, start_line long, status string, message string, snippet string")
    assert C.failure_details(detail, "check").first()["markdown"].count("````\n```x```\n````") == 5
