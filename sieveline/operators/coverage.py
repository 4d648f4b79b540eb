"""Coverage records: validation, totals, module rows, function coverage and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import policy
from sieveline.functions import text as T
from sieveline.sources.records import COUNTERS

SHOWN_LINES = 30


def consistent_counts(s: Column) -> Column:
    """Whether the counters of a summary fit each other; null counters do not."""
    present = F.lit(True)
    for name in COUNTERS:
        present = present & s[name].isNotNull() & (s[name] >= 0)
    fit = (s["covered_lines"] + s["missing_lines"] == s["num_statements"]) & (s["covered_branches"] <= s["num_branches"])
    return F.coalesce(present & fit, F.lit(False))


def proper_lines(lines: Column, expected: Column) -> Column:
    """Whether an array holds ``expected`` distinct positive line numbers."""
    good = (F.size(lines) == expected) & F.forall(lines, lambda x: F.coalesce(x > 0, F.lit(False))) & (F.size(F.array_distinct(lines)) == F.size(lines))
    return lines.isNotNull() & F.coalesce(good, F.lit(False))


def valid_record(info: Column) -> Column:
    """Whether one file's record is sound."""
    s = info["summary"]
    apart = F.size(F.array_intersect(info["executed_lines"], info["missing_lines"])) == 0
    return F.coalesce(consistent_counts(s) & proper_lines(info["executed_lines"], s["covered_lines"]) & proper_lines(info["missing_lines"], s["missing_lines"]) & apart, F.lit(False))


def checked_documents(documents: DataFrame, root: str = "") -> DataFrame:
    """(doc, file, executed_lines, missing_lines, summary) of documents that are sound as a whole.

    ``documents`` has doc, totals and files. One unsound record, two records of one
    path, counters that do not add up to the totals, or no statements at all reject
    the document.
    """
    entries = documents.select("doc", "totals", F.explode(F.map_entries("files")).alias("e")).select("doc", "totals", T.relative_to(F.col("e.key"), root).alias("file") if root else F.col("e.key").alias("file"), F.col("e.value").alias("info"))
    sums = [F.sum(f"info.summary.{c}").alias(c) for c in COUNTERS]
    judged = entries.groupBy("doc").agg(F.bool_and(valid_record(F.col("info"))).alias("__ok"), (F.count("*") == F.countDistinct("file")).alias("__once"), F.first("totals").alias("totals"), *sums)
    adds_up = F.lit(True)
    for c in COUNTERS:
        adds_up = adds_up & (F.col(c) == F.col(f"totals.{c}"))
    sound = judged.where(F.col("__ok") & F.col("__once") & consistent_counts(F.col("totals")) & adds_up & (F.col("num_statements") != 0)).select("doc")
    return entries.join(sound, "doc", "left_semi").select("doc", "file", "info.executed_lines", "info.missing_lines", "info.summary")


def totals(records: DataFrame) -> DataFrame:
    """(doc, stmts, miss, cover, branch_cover) of sound documents."""
    sums = records.groupBy("doc").agg(*[F.sum(f"summary.{c}").alias(c) for c in COUNTERS])
    return sums.select("doc", F.col("num_statements").alias("stmts"), F.col("missing_lines").alias("miss"), policy.percent(F.col("covered_lines"), F.col("num_statements")).alias("cover"), policy.percent(F.col("covered_branches"), F.col("num_branches")).alias("branch_cover"))


def module_rows(records: DataFrame) -> DataFrame:
    """One row for each file, least covered first."""
    s = F.col("summary")
    out = records.select(
        "file", s["num_statements"].alias("stmts"), s["covered_lines"].alias("covered"), s["missing_lines"].alias("miss"),
        F.coalesce(policy.percent(s["covered_lines"], s["num_statements"]), F.lit(100.0)).alias("cover"),
        policy.percent(s["covered_branches"], s["num_branches"]).alias("branch_cover"), s["num_branches"].alias("nb"), s["covered_branches"].alias("cb"),
        F.slice(F.array_sort("missing_lines"), 1, SHOWN_LINES).alias("missing_lines"),
    )
    return out.orderBy("cover", "file")


def combined(python: DataFrame, native: DataFrame) -> DataFrame:
    """Module rows of both languages, least covered first; rows without statements count as covered."""
    rows = python.unionByName(native).withColumn("cover", F.when(F.col("stmts") == 0, 100.0).otherwise(F.col("cover")))
    return rows.orderBy("cover", "file")


def combined_totals(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, stmts, miss, cover, branch_cover) over module rows of any languages; percents are null without anything to cover."""
    grouped = rows.groupBy(*keys) if keys else rows.groupBy()
    sums = grouped.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("stmts", "covered", "miss", "nb", "cb")])
    return sums.select(*(keys or []), "stmts", "miss", policy.percent(F.col("covered"), F.col("stmts")).alias("cover"), policy.percent(F.col("cb"), F.col("nb")).alias("branch_cover"))


def source_label(python: Column, native: Column, python_attempted: Column, native_attempted: Column) -> Column:
    """Where coverage came from; partial where an attempted language is missing."""
    base = F.concat_ws("/", F.when(python, "coverage.py"), F.when(native, "gcov"))
    missing = (python_attempted & ~python) | (native_attempted & ~native)
    return F.when(base == "", "estimated").when(missing, F.concat(base, F.lit(" (partial)"))).otherwise(base)


def low_rows(modules: DataFrame, least_stmts: int = 5, least_cover: float = 80.0) -> DataFrame:
    """Modules large enough to judge that are covered too little."""
    return modules.where((F.col("stmts") >= least_stmts) & (F.col("cover") < least_cover))


def function_rows(functions: DataFrame, records: DataFrame, block: int = 256) -> DataFrame:
    """Functions (file, name, body_start, end_line) of covered files: covered, missing lines inside.

    A line meets the functions that reach into its block of ``block`` lines: no function
    is joined to all lines of its file.
    """
    keys = ["file", "name", "body_start", "end_line"]
    known = functions.select(*keys).join(records.select("file"), "file", "left_semi")
    with_mark = lambda lines, hit: F.transform(lines, lambda x: F.struct(x.cast("long").alias("line"), F.lit(hit).alias("hit")))
    each = F.explode(F.concat(with_mark("executed_lines", True), with_mark("missing_lines", False))).alias("__line")
    lines = records.select(F.col("file").alias("__file"), each).select("__file", "__line.*").withColumn("__of", F.floor(F.col("line") / block))
    spans = F.sequence(F.floor(F.col("body_start") / block), F.floor(F.col("end_line") / block))
    blocks = known.where("body_start <= end_line").withColumn("__block", F.explode(spans))
    met = blocks.join(lines, (F.col("file") == F.col("__file")) & (F.col("__block") == F.col("__of")) & F.col("line").between(F.col("body_start"), F.col("end_line")))
    inside = met.groupBy(*keys).agg(F.bool_or("hit").alias("__hit"), F.collect_list(F.when(~F.col("hit"), F.col("line"))).alias("__missing"))
    found = known.join(inside, keys, "left")
    missing = F.coalesce("__missing", F.array().cast("array<long>"))
    return found.select(*keys, F.coalesce("__hit", F.lit(False)).alias("covered"), F.slice(F.array_sort(missing), 1, SHOWN_LINES).alias("missing_lines"))


def function_share(rows: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """(key, branch_cover, func_cover) of every run (key, code_lines, has_failure, branch_cover).

    Measured where there are function rows or branches; without any code all is
    covered, else what is not measured is estimated by whether tests failed.
    """
    shares = rows.groupBy(key).agg((F.avg(F.col("covered").cast("int")) * 100).alias("share"))
    joined = runs.join(shares, key, "left")
    none, failed = F.col("code_lines") == 0, F.col("has_failure")
    branch = F.when(none, 100.0).otherwise(F.coalesce("branch_cover", F.when(failed, 45.0).otherwise(85.0)))
    function = F.when(none, 100.0).otherwise(F.coalesce("share", F.when(failed, 50.0).otherwise(95.0)))
    return joined.select(key, branch.alias("branch_cover"), function.alias("func_cover"))


def source_paths(reports: DataFrame, sources: DataFrame, root: str = "/", report: str = "report", path: str = "path") -> DataFrame:
    """Reports (named like ``a#b.c.gcov``) with the source file they are about; others go.

    The name's own path counts first, then the path below ``root`` that it comes to.
    """
    raw = F.regexp_replace(F.replace(F.regexp_replace(report, r"\.gcov$", ""), F.lit("#"), F.lit("/")), "^$", ".")
    base = F.lit(root.rstrip("/") + "/")
    absolute = F.when(F.startswith(raw, F.lit("/")), raw).otherwise(F.concat(base, raw))
    settled = T.normal_path(absolute)
    below = F.when(F.startswith(settled, base), F.substring(settled, len(root.rstrip("/")) + 2, 1 << 30))
    known = sources.select(F.col(path).alias("__known")).distinct()
    each = reports.withColumns({"__raw": raw, "__below": below})
    candidates = each.select("*", F.posexplode(F.array("__raw", "__below")).alias("__rank", "__path"))
    met = candidates.join(known, F.col("__path") == F.col("__known"))
    best = met.groupBy(*reports.columns).agg(F.min_by("__path", "__rank").alias(path))
    return best


def suites(targets: DataFrame, key: str, order: str) -> DataFrame:
    """(key, passed, failed, total, tests) of targets (key, target_name, status), coverage rows left out."""
    kept = targets.where(~F.startswith("target_name", F.lit("Coverage:")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, "target_name", "status"))), lambda s: F.struct(s["target_name"].alias("name"), s["status"].alias("status")))
    return kept.groupBy(key).agg(F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") != "PASS").alias("failed"), F.count("*").alias("total"), listed.alias("tests"))


def score_rows(inputs: DataFrame) -> DataFrame:
    """Adds tem_score and pass_rate to (line_cov, branch_cov, est_cov, func_cov, passed, total)."""
    rate = F.when(F.col("total") > 0, F.bround(F.col("passed") / F.col("total"), 4)).otherwise(F.lit(0.0))
    return inputs.withColumns({"tem_score": policy.effectiveness(F.col("line_cov"), F.col("branch_cov"), F.col("est_cov"), F.col("func_cov"), F.col("passed"), F.col("total")), "pass_rate": rate})
