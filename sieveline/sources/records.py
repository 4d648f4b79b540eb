"""Structured sources: coverage JSON, linter JSON, saved reports, event payloads, key-value files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The counters of a coverage summary.
COUNTERS = ("covered_lines", "num_statements", "missing_lines", "num_branches", "covered_branches")

_SUMMARY = T.StructType([T.StructField(c, T.LongType()) for c in COUNTERS])
COVERAGE = T.StructType(
    [
        T.StructField("totals", _SUMMARY),
        T.StructField("files", T.MapType(T.StringType(), T.StructType([T.StructField("executed_lines", T.ArrayType(T.LongType())), T.StructField("missing_lines", T.ArrayType(T.LongType())), T.StructField("summary", _SUMMARY)]))),
    ]
)
LINT = T.ArrayType(
    T.StructType(
        [
            T.StructField("filename", T.StringType()),
            T.StructField("code", T.StringType()),
            T.StructField("message", T.StringType()),
            T.StructField("location", T.StructType([T.StructField("row", T.LongType()), T.StructField("column", T.LongType())])),
        ]
    )
)
REPORT = T.StructType(
    [
        T.StructField("schema", T.StringType()),
        T.StructField("suite_status", T.StringType()),
        T.StructField("results", T.ArrayType(T.StructType([T.StructField("engine_name", T.StringType()), T.StructField("status", T.StringType()), T.StructField("summary", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("required", T.BooleanType()), T.StructField("evidence", T.StringType())]))),
    ]
)
STATUSES = ("PASS", "WARN", "FAIL", "ERROR", "SKIP")


def coverage_documents(docs: DataFrame, key: str, json: str) -> DataFrame:
    """(doc, totals, files); malformed documents and those without files are left out."""
    parsed = docs.select(F.col(key).alias("doc"), F.from_json(json, COVERAGE, {"mode": "PERMISSIVE"}).alias("j")).select("doc", "j.totals", "j.files")
    return parsed.where(F.col("files").isNotNull() & (F.size("files") > 0))


def lint_findings(runs: DataFrame, key: str, json: str) -> DataFrame:
    """(key, file_path, start_line, target_name, status, message) of linter output.

    A run whose output is no array of whole records gives one ERROR row.
    """
    parsed = runs.select(key, F.from_json(json, LINT).alias("r"))
    whole = F.forall("r", lambda x: x["filename"].isNotNull() & x["message"].isNotNull() & F.coalesce(x["location"]["row"] > 0, F.lit(False)))
    judged = parsed.withColumn("__ok", F.coalesce(F.col("r").isNotNull() & whole, F.lit(False)))
    good = judged.where("__ok").select(key, F.explode("r").alias("x")).select(key, F.col("x.filename").alias("file_path"), F.col("x.location.row").alias("start_line"), F.coalesce("x.code", F.lit("syntax")).alias("target_name"), F.lit("FAIL").alias("status"), F.col("x.message").alias("message"))
    bad = judged.where(~F.col("__ok")).select(key, F.lit(".").alias("file_path"), F.lit(1).cast("long").alias("start_line"), F.lit("output").alias("target_name"), F.lit("ERROR").alias("status"), F.lit("malformed linter output").alias("message"))
    return good.unionByName(bad)


def saved_reports(docs: DataFrame, key: str, json: str) -> DataFrame:
    """Check rows of saved reports; rows without a name or a known status are skipped, the rest get defaults."""
    rows = docs.select(key, F.explode(F.from_json(json, REPORT)["results"]).alias("r")).select(key, "r.*")
    known = rows.where(F.col("engine_name").isNotNull() & F.col("status").isin(*STATUSES))
    return known.withColumns({"summary": F.coalesce("summary", F.lit("")), "required": F.coalesce("required", F.lit(True)), "evidence": F.coalesce("evidence", F.lit("MEASURED"))})


def change_number(payload: Column) -> Column:
    """Number of the pull request, else of the issue, in an event payload."""
    return F.coalesce(F.get_json_object(payload, "$.pull_request.number"), F.get_json_object(payload, "$.issue.number")).try_cast("long")


def key_values(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, value) of KEY=VALUE lines; quotes around values go, other lines are skipped."""
    lines = docs.select(key, F.explode(F.split(text, "\n")).alias("line")).where(F.contains("line", F.lit("=")) & ~F.startswith("line", F.lit("#")))
    value = F.regexp_replace(F.expr("substring(line, instr(line, '=') + 1)"), r"^[\"']|[\"']$", "")
    return lines.select(key, F.trim(F.substring_index("line", "=", 1)).alias("name"), F.trim(value).alias("value"))


FORMATTED = T.ArrayType(T.StructType([T.StructField("filename", T.StringType()), T.StructField("message", T.StringType()), T.StructField("code", T.StringType())]))


def formatter_findings(runs: DataFrame, key: str, json: str) -> DataFrame:
    """(key, file_path, well_formed) of files that a formatter's JSON output would change."""
    parsed = runs.select(key, F.from_json(json, FORMATTED).alias("r"))
    good = F.coalesce(F.col("r").isNotNull() & F.forall("r", lambda x: x["filename"].isNotNull()), F.lit(False))
    return parsed.select(key, F.explode_outer(F.when(good, F.array_distinct(F.transform("r", lambda x: x["filename"])))).alias("file_path"), good.alias("well_formed"))


def capabilities(found: DataFrame, overrides: DataFrame, key: str, required: tuple[str, ...]) -> DataFrame:
    """Tool rows (key, name, available); overrides win, and each row says whether it is required."""
    both = found.withColumn("__rank", F.lit(0)).unionByName(overrides.withColumn("__rank", F.lit(1)))
    return both.groupBy(key, "name").agg(F.max_by("available", "__rank").alias("available")).withColumn("required", F.col("name").isin(*required))
