"""Check and finding tables: statuses, issue views, leaderboards, and the rows of every report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions import policy
from sieveline.functions import text as T

BAR = 50
SHOWN_SNIPPETS = 5


def enabled(checks: DataFrame, switches: DataFrame, key: str) -> DataFrame:
    """Checks but those whose switch (key, enabled) is off; a check without a switch is on."""
    off = switches.where(~F.coalesce("enabled", F.lit(True))).select(key).distinct()
    return checks.join(off, key, "left_anti")


def check_rows(findings: DataFrame, key: str, required: Column, evidence: Column, mode: str = "pass_warn_fail", warnings: DataFrame | None = None) -> DataFrame:
    """One check for each key of findings (key, status): counts, status by mode, required, evidence.

    ``warnings`` (key, message) are what the tools themselves warned of: each counts
    as a warning.
    """
    counted = findings.groupBy(key).agg(*[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("PASS", "WARN", "FAIL")])
    if warnings is not None:
        more = warnings.groupBy(key).agg(F.count("*").alias("__more"))
        counted = counted.join(more, key, "full").select(key, *[F.coalesce(f"n_{s}", F.lit(0)).alias(f"n_{s}") for s in ("pass", "warn", "fail")], F.coalesce("__more", F.lit(0)).alias("__more"))
        counted = counted.withColumn("n_warn", F.col("n_warn") + F.col("__more")).drop("__more")
    return counted.withColumns({"status": policy.by_mode(F.col("n_fail") > 0, F.col("n_warn") > 0, mode), "required": required, "evidence": evidence})


def issues(checks: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """Findings that are no PASS, and one row for each ERROR or SKIP check without any."""
    found = findings.where(F.col("status") != "PASS")
    silent = checks.where(F.col("status").isin("ERROR", "SKIP")).join(found.select(key).distinct(), key, "left_anti")
    return found.select(key, "target", "status").unionByName(silent.select(key, F.lit(None).cast(dict(found.dtypes)["target"]).alias("target"), "status"))


def ranked(rows: DataFrame, *order) -> DataFrame:
    """Adds ``rank`` from 1 in a total order."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def bar(part: Column, total: Column, width: int = BAR) -> Column:
    """A bar of ``width`` characters."""
    n = F.floor(part * width / F.greatest(total, F.lit(1))).cast("int")
    return F.rpad(F.repeat(F.lit("█"), n), width, "░")


def annotations(findings: DataFrame) -> DataFrame:
    """Workflow commands for every finding that is no PASS (file_path, start_line, check, message, status)."""
    level = policy.issue_level(F.col("status"))
    line = F.format_string("::%s file=%s,line=%d,title=%s::%s", level, T.command_escaped(F.col("file_path"), True), F.col("start_line"), T.command_escaped(F.col("check"), True), T.command_escaped(F.col("message")))
    return findings.where(level.isNotNull()).select(*findings.columns, line.alias("annotation"))


ICONS = {"PASS": "✅", "WARN": "⚠️", "FAIL": "❌", "ERROR": "🚨", "SKIP": "⏭️"}


def icon(status: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in ICONS.items() for x in pair]), status)


def markdown_rows(checks: DataFrame) -> DataFrame:
    """A table row for each check (check, status, summary)."""
    return checks.select(*checks.columns, F.format_string("| %s | %s | %s |", T.cell_escaped(F.col("check")), F.col("status"), T.cell_escaped(F.col("summary"))).alias("row"))


def markdown_report(checks: DataFrame, order: str) -> DataFrame:
    """One row with the whole table; checks are few."""
    rows = markdown_rows(checks).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "row"))), lambda s: s["row"]), "\n").alias("rows"))
    return rows.select(F.concat(F.lit("| Check | Status | Summary |\n| --- | --- | --- |\n"), "rows").alias("markdown"))


def failure_details(findings: DataFrame, key: str) -> DataFrame:
    """(key, markdown) with at most five fenced snippets of failures in order of position."""
    first = F.row_number().over(Window.partitionBy(key).orderBy("file_path", "start_line"))
    top = findings.where(F.col("status").isin("FAIL", "ERROR")).withColumn("__k", first).where(F.col("__k") <= SHOWN_SNIPPETS)
    fence = T.fence_for(F.col("snippet"))
    block = F.concat(F.lit("**"), T.cell_escaped(F.col("message")), F.lit("**\n"), fence, F.lit("\n"), F.col("snippet"), F.lit("\n"), fence)
    return top.withColumn("__b", block).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__k", "__b"))), lambda s: s["__b"]), "\n").alias("markdown"))


def json_report(checks: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """One JSON object for each check with its findings nested, in order."""
    nested = findings.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in findings.columns if c != key]))).alias("targets"))
    joined = checks.join(nested, key, "left").withColumn("targets", F.coalesce("targets", F.array().cast(dict(nested.dtypes)["targets"])))
    return joined.select(key, F.to_json(F.struct(*joined.columns)).alias("json"))


def directory_tree(files: DataFrame, path: str, measures: list[str]) -> DataFrame:
    """Sums of direct children by directory, with depth, in path order."""
    out = files.groupBy(T.parent_of(F.col(path)).alias("dir")).agg(F.count("*").alias("n_files"), *[F.sum(m).alias(m) for m in measures])
    return out.withColumn("depth", F.size(F.split("dir", "/"))).orderBy(F.split("dir", "/"))


def with_empty_scopes(scopes: DataFrame, findings: DataFrame, key: str, message: str = "not run") -> DataFrame:
    """Findings and one SKIP row for each selected scope that has none."""
    silent = scopes.join(findings.select(key).distinct(), key, "left_anti").select(key, F.lit("SKIP").alias("status"), F.lit(message).alias("message"))
    return findings.select(key, "status", "message").unionByName(silent)


def suite_json(checks: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """The whole suite as one JSON object: status, counts and every check with its findings.

    ``checks`` has key, status, required and evidence; checks are few, findings nest
    within theirs. Both sides of the join are one row.
    """
    each = json_report(checks, findings, key).agg(F.array_sort(F.collect_list(F.struct(key, "json"))).alias("r"))
    rows = F.concat(F.lit("["), F.array_join(F.transform("r", lambda s: s["json"]), ","), F.lit("]"))
    suite = policy.suite_status(checks)
    head = F.to_json(F.struct(*suite.columns))
    joined = suite.select(head.alias("head")).join(each.select(rows.alias("rows")))
    return joined.select(F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"results":'), "rows", F.lit("}")).alias("json"))


def summary_rows(checks: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """One row for each check with its issues inlined, in order."""
    bad = findings.where(F.col("status") != "PASS").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("target", "status"))).alias("issues"))
    empty = F.array().cast(dict(bad.dtypes)["issues"])
    return checks.join(bad, key, "left").withColumn("issues", F.coalesce("issues", empty))


def dashboard(checks: DataFrame, key: str) -> DataFrame:
    """The console's table: key, status with its mark, summary, score and duration as shown.

    ``checks`` has key, status, summary, score, max_score, metrics and duration.
    """
    score = policy.shown_score(F.col("score"), F.col("max_score"), F.col("metrics"))
    duration = F.when(F.col("duration") > 0, F.format_string("%.2fs", "duration")).otherwise("-")
    return checks.select(key, F.concat_ws(" ", icon(F.col("status")), "status").alias("badge"), "summary", score.alias("score"), duration.alias("duration"))


def footer(checks: DataFrame) -> DataFrame:
    """One row: how many checks there are of each status. Errors do not count as failures here."""
    n = {s: F.count_if(F.col("status") == s) for s in ("PASS", "WARN", "FAIL", "ERROR", "SKIP")}
    return checks.agg(F.format_string("Total: %d (Pass: %d, Warn: %d, Fail: %d, Error: %d, Skip: %d)", F.count("*"), *n.values()).alias("footer"))


def tree_search(rows: DataFrame, query: str, shown: Column, folder: Column) -> DataFrame:
    """Rows whose shown text holds the query in any case, and every folder; all of them for a blank query."""
    wanted = query.lower().strip()
    return rows.where(folder | F.contains(F.lower(shown), F.lit(wanted))) if wanted else rows
