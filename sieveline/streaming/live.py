"""Extension: the same operators over streams.

Line statistics are stateless. Status counts over event time keep only the open
windows. Both take and give streaming DataFrames; sources and sinks are the
caller's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions import policy
from sieveline.operators.lines import kind_counts


def line_statistics(docs: DataFrame, key: str, comment_starts: tuple[str, ...], warn: int, fail: int) -> DataFrame:
    """Counts and status of each arriving text."""
    counted = kind_counts(docs, key, comment_starts)
    return counted.withColumn("status", policy.two_thresholds(F.col("code"), warn, fail))


def windowed_status(findings: DataFrame, time: str = "ts", every: str = "10 minutes", late: str = "20 minutes") -> DataFrame:
    """Counts by status, and the suite status, of each window of event time."""
    grouped = findings.withWatermark(time, late).groupBy(F.window(time, every).alias("w"))
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("PASS", "WARN", "FAIL", "ERROR")]
    status = F.when(F.count_if(F.col("status") == "ERROR") > 0, "ERROR").when(F.count_if(F.col("status") == "FAIL") > 0, "FAIL").when(F.count_if(F.col("status") == "WARN") > 0, "WARN").otherwise("PASS")
    return grouped.agg(*counts, status.alias("suite_status")).select(F.col("w.start").alias("start"), *[f"n_{s}" for s in ("pass", "warn", "fail", "error")], "suite_status")
