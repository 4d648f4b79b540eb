"""Tool logs as findings: test runners, compilers, type checkers, formatters, sanitizers, gcov.

Every reader takes a table of runs with a text column and returns rows; whether a
whole run is well-formed is an aggregate over its lines.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions import text as T
from sieveline.operators.lines import exploded

#: Grammars of the tools' output.
DIAGNOSTIC = r"^(.+?):([1-9]\d*)(?::([1-9]\d*))?:\s*(fatal error|error|warning|note):\s*(\S.*)$"
CONTEXT = r"^\s*(?:\d+\s*\|.*|\|.*|[\^~].*)$"
CONTEXT_HEADER = r"^.+:\s+In (?:function|member function|constructor|destructor|lambda function|instantiation of)(?: .*)?:$"
REQUIRED_FROM = r"^.+:[1-9]\d*(?::[1-9]\d*)?:\s+required from here$"
TYPE_SUCCESS = r"^Success: no issues found in (\d+) source files?$"
TYPE_SUMMARY = r"^Found \d+ errors? in \d+ files? \(checked \d+ source files?\)$"
RESOURCE_WARNING = r"(.*?\.py):([1-9]\d*):[^\n]*ResourceWarning"
SANITIZER = (
    r"(?mi)^(?:==\d+==)?\s*ERROR:\s*(?:AddressSanitizer|LeakSanitizer|UndefinedBehaviorSanitizer)\b",
    r"(?mi)^\s*SUMMARY:\s*(?:AddressSanitizer|LeakSanitizer|UndefinedBehaviorSanitizer)\b",
    r"(?m)^.*:\d+(?::\d+)?:\s*runtime error:\s*\S+",
)
FORMAT_FILE = r"^Would reformat: (\S.*)$"
FORMAT_SUMMARY = r"^([1-9]\d*) (file|files) would be reformatted(?:, ([1-9]\d*) (file|files) already formatted)?$"
WARNING_HEAD = r"^warning:\s+\S.*$"


def _lines(runs: DataFrame, key: str, text: str) -> DataFrame:
    return exploded(runs, key, text, T.WIDE_BREAK)


def pytest_results(runs: DataFrame, key: str, text: str = "log") -> DataFrame:
    """(key, file_path, target_name, status) of verbose test lines."""
    lines = _lines(runs, key, text).where(F.contains("raw", F.lit("::")) & F.col("raw").rlike("PASSED|FAILED|ERROR"))
    name = F.element_at(F.split(T.stripped(F.col("raw")), r"\s+"), 1)
    return lines.select(key, "line_no", F.when(F.contains(name, F.lit("::")), F.substring_index(name, "::", 1)).otherwise("tests").alias("file_path"), name.alias("target_name"), F.when(F.contains("raw", F.lit("PASSED")), "PASS").otherwise("FAIL").alias("status"))


def pytest_totals(runs: DataFrame, key: str, text: str = "log") -> DataFrame:
    """(key, passed, total, has_failure); the summary line counts where there is no verbose line."""
    seen = pytest_results(runs, key, text).groupBy(key).agg(F.count_if(F.col("status") == "PASS").alias("__p"), F.count("*").alias("__t"))
    number = lambda what: F.coalesce(F.regexp_extract(text, rf"\b(\d+)\s+(?:{what})\b", 1).try_cast("long"), F.lit(0).cast("long"))
    said = runs.select(key, number("passed").alias("__sp"), number("failed|errors?").alias("__sf")).join(seen, key, "left")
    verbose = F.coalesce(F.col("__t"), F.lit(0)) > 0
    passed = F.when(verbose, F.col("__p")).otherwise(F.col("__sp"))
    total = F.when(verbose, F.col("__t")).otherwise(F.col("__sp") + F.col("__sf"))
    return said.select(key, passed.alias("passed"), total.alias("total"), (passed < total).alias("has_failure"))


def unittest_results(runs: DataFrame, key: str, text: str = "log") -> DataFrame:
    lines = _lines(runs, key, text)
    good = F.contains("raw", F.lit(" ... ok"))
    bad = ~good & (F.contains("raw", F.lit(" ... FAIL")) | F.contains("raw", F.lit(" ... ERROR")))
    name = F.when(good, T.stripped(F.replace("raw", F.lit(" ... ok"), F.lit("")))).otherwise(T.stripped(F.substring_index("raw", " ...", 1)))
    return lines.where(good | bad).select(key, "line_no", F.lit("tests").alias("file_path"), name.alias("target_name"), F.when(good, "PASS").otherwise("FAIL").alias("status"))


def diagnostics(runs: DataFrame, key: str, text: str = "log") -> DataFrame:
    """Compiler lines with ``part``: diagnostic, context, or malformed.

    Source excerpts count as context only after a first diagnostic.
    """
    lines = _lines(runs, key, text).withColumn("bare", T.stripped(F.col("raw"))).where(F.col("bare") != "")
    is_diag = F.col("bare").rlike(DIAGNOSTIC)
    seen = F.max(F.when(is_diag, 1).otherwise(0)).over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumns({"__diag": is_diag, "__seen": seen})
    framed = T.starts_with_any(F.col("bare"), ("In file included from", "from ")) | F.col("bare").rlike(CONTEXT_HEADER) | F.col("bare").rlike(REQUIRED_FROM)
    part = F.when(F.col("__diag"), "diagnostic").when(framed | ((F.col("__seen") == 1) & F.col("raw").rlike(CONTEXT)), "context").otherwise("malformed")
    get = lambda k: F.regexp_extract("bare", DIAGNOSTIC, k)
    return lines.select(key, "line_no", part.alias("part"), get(1).alias("file_path"), get(2).try_cast("long").alias("start_line"), get(4).alias("kind"), F.when(F.contains(get(4), F.lit("error")), "FAIL").otherwise("WARN").alias("status"), F.concat_ws(": ", get(4), get(5)).alias("message"))


def type_check_runs(runs: DataFrame, key: str, text: str = "log") -> DataFrame:
    """(key, n_errors, n_notes, success, well_formed) of type-checker output.

    Well-formed output is one success line alone, or diagnostics and at most one
    summary, which comes last.
    """
    lines = _lines(runs, key, text).where(T.stripped(F.col("raw")) != "")
    kind = F.when(F.col("raw").rlike(TYPE_SUCCESS), "success").when(F.col("raw").rlike(TYPE_SUMMARY), "summary").when(F.col("raw").rlike(DIAGNOSTIC), F.regexp_extract("raw", DIAGNOSTIC, 4)).otherwise("other")
    agg = lines.withColumn("kind", kind).groupBy(key).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("success", "summary", "error", "note", "other")], F.max("line_no").alias("__last"), F.max(F.when(F.col("kind") == "summary", F.col("line_no"))).alias("__at"), F.count("*").alias("__n"))
    alone = (F.col("success") == 1) & (F.col("__n") == 1)
    found = (F.col("success") == 0) & (F.col("other") == 0) & (F.col("error") > 0) & (F.col("summary") <= 1) & (F.coalesce("__at", "__last") == F.col("__last"))
    return agg.select(key, F.col("error").alias("n_errors"), F.col("note").alias("n_notes"), alone.alias("success"), (alone | found).alias("well_formed"))


def formatter_runs(runs: DataFrame, key: str, text: str = "log") -> DataFrame:
    """(key, files, well_formed): files to reformat, and one last summary whose count agrees."""
    lines = _lines(runs, key, text).where(F.col("raw") != "")
    is_file, is_sum = F.col("raw").rlike(FORMAT_FILE), F.col("raw").rlike(FORMAT_SUMMARY)
    number, unit = F.regexp_extract("raw", FORMAT_SUMMARY, 1).try_cast("long"), F.regexp_extract("raw", FORMAT_SUMMARY, 2)
    agg = lines.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(is_file, F.struct("line_no", F.regexp_extract("raw", FORMAT_FILE, 1).alias("path"))))).alias("__files"),
        F.count_if(is_file).alias("__n"), F.count_if(is_sum).alias("__sums"), F.count_if(~is_file & ~is_sum).alias("__odd"),
        F.max("line_no").alias("__last"), F.max(F.when(is_sum, F.col("line_no"))).alias("__at"), F.max(F.when(is_sum, number)).alias("__said"), F.max(F.when(is_sum, unit)).alias("__unit"),
    )
    agrees = (F.col("__sums") == 1) & (F.col("__odd") == 0) & (F.col("__at") == F.col("__last")) & (F.col("__said") == F.col("__n")) & (F.col("__unit") == F.when(F.col("__n") == 1, "file").otherwise("files"))
    good = F.coalesce(agrees, F.lit(False))
    return agg.select(key, F.when(good, F.transform("__files", lambda s: s["path"])).otherwise(F.array().cast("array<string>")).alias("files"), good.alias("well_formed"))


def warning_blocks(runs: DataFrame, key: str, text: str = "log") -> DataFrame:
    """(key, block, message) of ``warning:`` lines with their indented continuations."""
    lines = _lines(runs, key, text)
    head = F.col("raw").rlike(WARNING_HEAD)
    upto = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("block", F.sum(F.when(head, 1).otherwise(0).cast("long")).over(upto))
    inside = marked.where((F.col("block") > 0) & (head | F.col("raw").rlike(r"^\s")))
    return inside.groupBy(key, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda s: s["raw"]), "\n").alias("message"))


def sanitizer_hit(log: Column) -> Column:
    found = F.lit(False)
    for pattern in SANITIZER:
        found = found | log.rlike(pattern)
    return found


def resource_warnings(runs: DataFrame, key: str, text: str = "log") -> DataFrame:
    lines = _lines(runs, key, text).where(F.col("raw").rlike(RESOURCE_WARNING))
    return lines.select(key, F.regexp_extract("raw", RESOURCE_WARNING, 1).alias("file_path"), F.regexp_extract("raw", RESOURCE_WARNING, 2).cast("long").alias("start_line"))


def incomplete(timed_out: Column, truncated: Column, returncode: Column, signals_allowed: bool = False) -> Column:
    """Whether a run's outcome says nothing: cut off, or ended by a signal."""
    return timed_out | truncated | returncode.isNull() | (F.lit(False) if signals_allowed else F.coalesce(returncode < 0, F.lit(False)))


def gcov_modules(files: DataFrame, key: str, text: str = "content") -> DataFrame:
    """(key, stmts, covered, miss, cover, branch_cover, nb, cb, missing_lines) of gcov text.

    Rows of files without statements are left out; unexecuted exceptional lines count
    neither way.
    """
    lines = _lines(files, key, text)
    branch = F.startswith("raw", F.lit("branch"))
    taken = F.coalesce(F.regexp_extract("raw", r"\btaken\s+(\d+)%?", 1).try_cast("long"), F.lit(0))
    parts = F.split("raw", ":", 3)
    count, number = T.stripped(F.get(parts, F.lit(0))), T.stripped(F.get(parts, F.lit(1))).try_cast("long")
    row = ~branch & (F.size(parts) == 3) & ~F.startswith(count, F.lit("-")) & number.isNotNull()
    missed = row & F.startswith(count, F.lit("#"))
    hit = row & ~F.startswith(count, F.lit("#")) & F.coalesce(F.regexp_extract(count, r"^(\d+)\**$", 1).try_cast("long") > 0, F.lit(False))
    agg = lines.groupBy(key).agg(F.count_if(hit).alias("covered"), F.count_if(missed).alias("miss"), F.count_if(branch).alias("nb"), F.count_if(branch & (taken > 0)).alias("cb"), F.array_sort(F.collect_list(F.when(missed, number))).alias("__missing"))
    stmts = F.col("covered") + F.col("miss")
    percent = lambda a, b: F.when(b > 0, F.bround(F.lit(100.0) * a / b, 1))
    return agg.where(stmts > 0).select(key, stmts.alias("stmts"), "covered", "miss", percent(F.col("covered"), stmts).alias("cover"), percent(F.col("cb"), F.col("nb")).alias("branch_cover"), "nb", "cb", F.slice("__missing", 1, 30).alias("missing_lines"))


def gcov_functions(files: DataFrame, key: str, text: str = "content") -> DataFrame:
    """(key, name, covered) of ``function NAME called N`` lines."""
    pattern = r"^function (\S+) called (\d+)"
    lines = _lines(files, key, text).where(F.col("raw").rlike(pattern))
    return lines.select(key, F.regexp_extract("raw", pattern, 1).alias("name"), (F.regexp_extract("raw", pattern, 2).cast("long") > 0).alias("covered"))


def collapsed_repeats(notes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Repeated rows as their first position and a count."""
    return notes.groupBy(*keys).agg(F.min(order).alias("first_at"), F.count("*").alias("n"))


def executed(log: Column) -> Column:
    """Whether a test log says that any test ran."""
    return log.rlike(r"(?i)\b[1-9]\d*\s+(?:passed|failed|xfailed|xpassed)\b") | log.rlike(r"\bRan [1-9]\d* tests?\b")


#: How a runner says that it ran something, or that it is not there.
RESULT_LINE = r"::\S+\s+(?:PASSED|FAILED|ERROR)\b"
RESULT_COUNT = r"\b\d+\s+(?:passed|failed|errors?)\b"


def has_results(log: Column) -> Column:
    """Whether a test log reports a result, be it of no test."""
    return log.rlike(RESULT_LINE) | log.rlike(RESULT_COUNT)


def module_unavailable(log: Column, returncode: Column, timed_out: Column, truncated: Column, module: str) -> Column:
    """Whether all that a failed run said is that the interpreter does not know the module."""
    missing = rf"No module named ['\"]?{re.escape(module)}['\"]?"
    python = r"python(?:3(?:\.\d+)?)?(?:\.exe)?"
    said = F.filter(F.transform(F.split(log, T.WIDE_BREAK), T.stripped), lambda s: s != "")
    alone = F.element_at(said, 1).rlike(rf"\A(?:{missing}|(?:{python}|(?:[A-Za-z]:[\\/]|/)[^\n]*{python})\s*:\s*{missing})\z")
    return F.coalesce((returncode > 0) & ~timed_out & ~truncated & (F.size(said) == 1), F.lit(False)) & F.coalesce(F.when(F.size(said) == 1, alone), F.lit(False))


def first_occurrences(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Distinct values of each key in the order in which they first occur: one array."""
    once = rows.groupBy(key, value).agg(F.min(order).alias("__at"))
    return once.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", F.col(value).alias("v")))), lambda s: s["v"]).alias("values"))


def merged_totals(parts: DataFrame) -> DataFrame:
    """Totals (passed, total, has_failure) over languages or runners."""
    return parts.agg(F.coalesce(F.sum("passed"), F.lit(0)).alias("passed"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.bool_or("has_failure"), F.lit(False)).alias("has_failure"))


def pattern_count(files: DataFrame, text: str, pattern: str) -> DataFrame:
    """Matches of a pattern over all files, and whether there is exactly one."""
    return files.agg(F.coalesce(F.sum(F.regexp_count(text, F.lit(pattern)).cast("long")), F.lit(0)).alias("n")).withColumn("once", F.col("n") == 1)
