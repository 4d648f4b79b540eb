"""A suite's JSON report of any size: fragments in order, in many files, with a manifest.

The report is one JSON object that nests findings in checks. Each finding, and each
check's and the suite's opening and end, is a fragment with a place in the order; ranges
of places are sorted and written as text files, a fragment a line. The files, joined in
the order of their names, are the object; no row, task or driver holds all of it.

Edge cases: a check without findings has an empty list; no checks give an empty list of
results; a finding whose check is unknown is left out; rows equal in the whole order have
no defined sequence among themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions import policy
from sieveline.operators.scans import running, total

HEAD, CHECK, FINDING, CLOSE, END = range(5)


def fragments(checks: DataFrame, findings: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(section, key, kind, n, fragment): the pieces of the report; their order is that of the first four.

    ``checks`` has the key, status, required and evidence; findings have the key and
    ``order``, which tells those of a check apart.
    """
    kind = dict(checks.dtypes)[key]
    row = lambda section, name, kind, n, text: [F.lit(section).alias("section"), name.alias("key"), F.lit(kind).alias("kind"), n.alias("n"), text.alias("fragment")]
    none, zero = F.lit(None).cast(kind), F.lit(0).cast("long")
    opened = lambda json: F.expr(f"substring({json}, 1, length({json}) - 1)")

    suite = policy.suite_status(checks)
    head = suite.select(F.to_json(F.struct(*suite.columns)).alias("json")).select(*row(0, none, HEAD, zero, F.concat(opened("json"), F.lit(',"results":['))))
    first = checks.agg(F.min(key).alias("__first"))
    each = checks.select(key, F.to_json(F.struct(key, *[c for c in checks.columns if c != key])).alias("json")).join(F.broadcast(first))  # one row
    comma = F.when(F.col(key) > F.col("__first"), ",").otherwise("")
    openings = each.select(*row(1, F.col(key), CHECK, zero, F.concat(comma, opened("json"), F.lit(',"targets":['))))
    closings = checks.select(*row(1, F.col(key), CLOSE, zero, F.lit("]}")))
    end = checks.agg(F.count("*").alias("__n")).select(*row(2, none, END, zero, F.lit("]}")))

    known = findings.join(checks.select(F.col(key).alias("__known")), F.col(key) == F.col("__known"), "left_semi")
    numbered = running(known, [key], order, __n=total(F.lit(1).cast("long"), before=True))
    json = F.to_json(F.struct(*[c for c in findings.columns if c != key]))
    found = numbered.select(*row(1, F.col(key), FINDING, F.col("__n"), F.concat(F.when(F.col("__n") > 0, ",").otherwise(""), json)))
    return head.unionByName(openings).unionByName(found).unionByName(closings).unionByName(end)


PLACE = ["section", "key", "kind", "n"]


def write(pieces: DataFrame, path: str, parts: int | None = None) -> None:
    """The fragments as text files under ``path``, in the order of the files' names.

    ``parts`` is the number of ranges; Spark chooses it where it is not given.
    """
    dealt = pieces.repartitionByRange(parts, *PLACE) if parts else pieces.repartitionByRange(*PLACE)
    dealt.sortWithinPartitions(*PLACE).select(F.col("fragment").alias("value")).write.mode("overwrite").text(path)


def manifest(spark, path: str) -> DataFrame:
    """(file, n_fragments, n_chars) of a written report, in the order in which files are joined."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.length("value").cast("long").alias("n"))
    return lines.groupBy("file").agg(F.count("*").alias("n_fragments"), F.sum("n").alias("n_chars")).orderBy("file")
