"""Policies as column expressions: thresholds, modes, evidence, suite status, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASS, WARN, FAIL, ERROR, SKIP = "PASS", "WARN", "FAIL", "ERROR", "SKIP"
MEASURED, ESTIMATED, NOT_RUN = "MEASURED", "ESTIMATED", "NOT_RUN"


def two_thresholds(value: Column, warn, fail, gated: Column | None = None) -> Column:
    """FAIL above ``fail``, WARN above ``warn``, both strictly; PASS where not gated."""
    gate = F.lit(True) if gated is None else F.coalesce(gated, F.lit(False))
    return F.when(gate & (value > fail), FAIL).when(gate & (value > warn), WARN).otherwise(PASS)


def complexity_status(complexity: Column, nesting: Column, warn=15, fail=25, warn_nesting=4) -> Column:
    """Complexity strictly above its limits, nesting from its limit on."""
    return F.when(complexity > fail, FAIL).when((complexity > warn) | (nesting >= warn_nesting), WARN).otherwise(PASS)


def share_status(percent: Column, groups: Column, warn, fail) -> Column:
    """By percent, and WARN wherever there is any group."""
    return F.when(percent > fail, FAIL).when((percent > warn) | (groups > 0), WARN).otherwise(PASS)


def by_mode(has_fail: Column, has_warn: Column, mode: str = "pass_warn_fail") -> Column:
    """``pass_fail``: any issue fails; ``pass_warn``: none does; anything else: as they are."""
    if mode == "pass_fail":
        return F.when(has_fail | has_warn, FAIL).otherwise(PASS)
    if mode == "pass_warn":
        return F.when(has_fail | has_warn, WARN).otherwise(PASS)
    return F.when(has_fail, FAIL).when(has_warn, WARN).otherwise(PASS)


def evidence(tool_error: Column, required_missing: Column, optional_missing: Column) -> Column:
    return F.when(tool_error | required_missing, NOT_RUN).when(optional_missing, ESTIMATED).otherwise(MEASURED)


def result_status(tool_error: Column, required_missing: Column, optional_missing: Column, has_fail: Column, has_warn: Column, mode: str = "pass_warn_fail") -> Column:
    """Errors first; a missing optional part warns unless something failed; else by mode."""
    return F.when(tool_error | required_missing, ERROR).when(optional_missing & ~has_fail, WARN).otherwise(by_mode(has_fail, has_warn, mode))


def scope_status(errors: Column, measured: Column, skipped: Column, has_fail: Column, has_warn: Column, mode: str = "pass_fail") -> tuple[Column, Column]:
    """Status and evidence of a check whose scopes ran in part."""
    judged = by_mode(has_fail, has_warn, mode)
    some, part = measured > 0, (measured > 0) & (skipped > 0)
    status = F.when(errors > 0, ERROR).when(part, F.when(has_fail, judged).otherwise(WARN)).when(some, judged).otherwise(SKIP)
    return status, F.when(errors > 0, NOT_RUN).when(part, ESTIMATED).when(some, MEASURED).otherwise(ESTIMATED)


def below_threshold(score: Column, branch: Column, function: Column, least_score, least_branch, least_function, has_fail: Column, optional_missing: Column) -> Column:
    """Whether a measured score warns: forced where an optional part is missing, not judged after failures."""
    low = (score < least_score) | (branch < least_branch) | (function < least_function)
    return F.when(optional_missing | has_fail, optional_missing).otherwise(F.coalesce(low, F.lit(False)))


def exit_code(status: Column) -> Column:
    return F.when(status.isin(FAIL, ERROR), 1).when(status == SKIP, 2).otherwise(0)


def issue_level(status: Column) -> Column:
    """Annotation level; null where nothing is to be said."""
    return F.when(status.isin(FAIL, ERROR), "error").when(status.isin(WARN, SKIP), "warning")


def severity_rank(status: Column) -> Column:
    """Order of the statuses in a published comment."""
    return F.when(status == SKIP, 0).when(status == WARN, 1).when(status == ERROR, 2).when(status == PASS, 3).when(status == FAIL, 4)


def suite_status(checks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row for each suite (one in all without ``keys``): status and counts.

    ``checks`` has status, required and evidence. A suite without checks is an
    error; so is a required check that did not run.
    """
    bad = F.col("required") & (F.col("status").isin(ERROR, SKIP) | (F.col("evidence") == NOT_RUN))
    failed = F.col("required") & (F.col("status") == FAIL)
    warned = (F.col("status") == WARN) | (~F.col("required") & ((F.col("status") != PASS) | (F.col("evidence") != MEASURED)))
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in (PASS, WARN, FAIL, ERROR, SKIP)]
    status = F.when(F.count("*") == 0, ERROR).when(any_of(bad), ERROR).when(any_of(failed), FAIL).when(any_of(warned), WARN).otherwise(PASS)
    grouped = checks.groupBy(*keys) if keys else checks.groupBy()
    out = grouped.agg(status.alias("suite_status"), F.count("*").alias("n_checks"), *counts)
    return out.withColumn("exit_code", exit_code(F.col("suite_status")).cast("long"))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percent rounded half to even; null where there is nothing."""
    return F.when(whole > 0, F.bround(F.lit(100.0) * part / whole, digits))


def ratio(part: Column, whole: Column) -> Column:
    """Share with a guard: nothing of nothing is 0."""
    return part / F.when(whole == 0, F.lit(1)).otherwise(whole)


def effectiveness(line: Column, branch: Column, estimated: Column, function: Column, passed: Column, total: Column) -> Column:
    """Score from 0 to 5: coverage up to 80 %, function coverage and pass rate multiply."""
    rate = F.when(total > 0, passed / total).otherwise(F.lit(0.0))
    covered = F.coalesce(line, branch * 1.25, estimated)
    raw = F.least(F.lit(80.0), covered) / 80.0 * (function / 100.0) * rate * 5.0
    return F.greatest(F.lit(0.0), F.least(F.lit(5.0), F.bround(raw, 2)))


def shown_score(score: Column, most: Column, summary: Column) -> Column:
    """Score of the most there is, else the score, else the summary, else a dash."""
    alone = F.when(score.isNotNull(), F.format_string("%.2f", score))
    return F.coalesce(F.when(score.isNotNull() & most.isNotNull(), F.format_string("%.2f / %.2f", score, most)), alone, summary, F.lit("-"))


def coverage_colour(percent_: Column) -> Column:
    return F.when(percent_ >= 90, "green").when(percent_ >= 75, "yellow").when(percent_.isNotNull(), "red").otherwise("grey")


#: Marks of the statuses.
STATUS_COLOURS = {PASS: "#10b981", WARN: "#f59e0b", FAIL: "#ef4444", ERROR: "#dc2626", SKIP: "#9ca3af"}


def status_colour(status: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in STATUS_COLOURS.items() for x in pair]), status)


def formatter_verdict(timed_out: Column, truncated: Column, returncode: Column, well_formed: Column, n_files: Column) -> Column:
    """What a formatter's run says: cut-off or odd output is an error, files to change a warning."""
    lost = timed_out | truncated | returncode.isNull() | ~returncode.isin(0, 1)
    return F.when(lost, ERROR).when((returncode == 1) & (~well_formed | (n_files == 0)), ERROR).when(returncode == 1, WARN).when(n_files > 0, ERROR).otherwise(PASS)


def evidence_rows(runs: DataFrame) -> DataFrame:
    """One row for each tool attempt with what went wrong, null if nothing did.

    ``runs`` has name, returncode, timed_out, truncated and error.
    """
    wrong = F.coalesce(F.col("error"), F.when(F.col("timed_out"), "timed out"), F.when(F.col("truncated"), "output cut off"), F.when(F.col("returncode").isNull(), "did not start"), F.when(F.col("returncode") < 0, F.format_string("ended by signal %d", -F.col("returncode"))))
    return runs.withColumn("problem", wrong)
