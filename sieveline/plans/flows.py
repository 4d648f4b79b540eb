"""Queries whose results pass through files in order or through a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sieveline.operators import sharded
from sieveline.operators.storage import shared_folder
from sieveline.plans.registry import query, read
from sieveline.plans.reporting import _FINDINGS, _SUITE, _checks, _findings
from sieveline.sources import gcov
from sieveline.streaming import runs


@query(f"""WITH {_FINDINGS}, k AS (SELECT *, row_number() OVER (PARTITION BY chk ORDER BY target) AS n FROM findings
), s AS (SELECT {_SUITE} AS st, count(*) AS n, count(*) FILTER (status = 'PASS') AS p, count(*) FILTER (status = 'WARN') AS w, count(*) FILTER (status = 'FAIL') AS f, count(*) FILTER (status = 'ERROR') AS e, count(*) FILTER (status = 'SKIP') AS sk FROM checks)
SELECT '{{"suite_status":"' || st || '","n_checks":' || n || ',"n_pass":' || p || ',"n_warn":' || w || ',"n_fail":' || f || ',"n_error":' || e || ',"n_skip":' || sk || ',"exit_code":' || CASE WHEN st IN ('FAIL', 'ERROR') THEN 1 WHEN st = 'SKIP' THEN 2 ELSE 0 END || ',"results":[' AS fragment FROM s
UNION ALL SELECT CASE WHEN chk > (SELECT min(chk) FROM checks) THEN ',' ELSE '' END || '{{"chk":"' || chk || '","status":"' || status || '","evidence":"' || evidence || '","required":' || required || ',"suite":' || suite || ',"targets":[' FROM checks
UNION ALL SELECT CASE WHEN n > 1 THEN ',' ELSE '' END || '{{"target":' || target || ',"status":"' || status || '"}}' FROM k
UNION ALL SELECT ']}}' FROM checks UNION ALL SELECT ']}}'""")
def q_report_fragments(spark, sf_dir):
    """The suite's JSON report, written as files of ordered fragments and read back."""
    findings = _findings(spark, sf_dir)
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    sharded.write(sharded.fragments(_checks(findings), findings, "chk", ["target"]), path)
    return spark.read.text(path).select(F.col("value").alias("fragment"))


def _log_lines(spark, sf_dir):
    """(run, line_no, raw): events as lines of tool output, 200 in a row to a run."""
    event, kind = F.col("event_id").cast("string"), F.col("event_type")
    line = F.when(kind == "signup", F.concat(F.lit("src/f.c:"), (F.col("event_id") + 1).cast("string"), F.lit(":3: fatal error: bad"))).when(kind == "purchase", F.concat(F.lit("warning: w"), event))
    line = line.when(kind == "view", F.lit("   | ^~~")).when(kind == "click", F.lit("In file included from x.h:3:")).otherwise(F.lit("strange"))
    return read(spark, sf_dir, "events", "event_id", "event_type").select(F.expr("event_id div 200").alias("run"), F.col("event_id").alias("line_no"), line.alias("raw"))


@query("""WITH e AS (SELECT event_id // 200 AS run, event_id, event_type FROM events
), l AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w AS seen, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS block FROM e WINDOW w AS (PARTITION BY run ORDER BY event_id))
SELECT run, event_id AS line_no, CASE WHEN event_type = 'signup' THEN 'diagnostic' WHEN event_type = 'click' OR (event_type = 'view' AND seen = 1) THEN 'context' ELSE 'malformed' END AS part, NULL AS block, NULL AS message FROM l
UNION ALL SELECT run, NULL, 'block', CAST(block AS BIGINT), string_agg(CASE WHEN event_type = 'purchase' THEN 'warning: w' || event_id ELSE '   | ^~~' END, chr(10) ORDER BY event_id) FROM l WHERE block > 0 AND event_type IN ('purchase', 'view') GROUP BY run, block""")
def q_stream_runs(spark, sf_dir):
    """Tool output that arrives in two instalments: diagnostics, context and warning blocks by state, across a restart."""
    root = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    lines = _log_lines(spark, sf_dir)
    ends = lines.select("run").distinct().select("run", F.lit(None).cast("long").alias("line_no"), F.lit(None).cast("string").alias("raw"))
    late = F.col("line_no") % 200 >= 100
    for arriving in (lines.where(~late), lines.where(late).unionByName(ends)):
        # A run's rows of one instalment stay in one file, so that they arrive together.
        arriving.repartition("run").write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(lines.schema).parquet(f"{root}/in")
        started = runs.judged(stream).writeStream.format("parquet").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start(f"{root}/out")
        started.awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("""SELECT l_suppkey, CAST(count(*) FILTER (l_returnflag = 'R' OR l_quantity > 0 AND l_returnflag = 'N') AS BIGINT) AS stmts,
  count(*) FILTER (l_quantity > 0 AND l_returnflag = 'N') AS covered, count(*) FILTER (l_returnflag = 'R') AS miss FROM lineitem
  GROUP BY l_suppkey HAVING count(*) FILTER (l_returnflag = 'R' OR l_quantity > 0 AND l_returnflag = 'N') > 0""")
def q_gcov_source(spark, sf_dir):
    """Order lines written as coverage reports, many to a file, and read by the data source."""
    items = read(spark, sf_dir, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    count = F.when(F.col("l_returnflag") == "R", "#####").when(F.col("l_returnflag") == "A", "-").otherwise(F.col("l_quantity").cast("int").cast("string"))
    line = F.format_string("%9s:%5d:code", count, F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    folder = f"{shared_folder(spark)}/gcov-{uuid.uuid4().hex}"
    heads = items.select("l_suppkey").distinct().select("l_suppkey", F.lit(0).alias("at"), F.format_string("%9s:%5d:Source:%d", F.lit("-"), F.lit(0), "l_suppkey").alias("value"))
    # Files are as many as tasks: one for each supplier would cost more than its lines.
    reports = items.select("l_suppkey", F.lit(1).alias("at"), line.alias("value")).unionByName(heads)
    reports.repartition("l_suppkey").sortWithinPartitions("l_suppkey", "at").select("value").write.text(folder)
    gcov.register(spark)
    rows = spark.read.format("gcov").load(folder).where("hit or missed")
    by = F.col("source").try_cast("long").alias("l_suppkey")
    return rows.groupBy(by).agg(F.count("*").alias("stmts"), F.count_if("hit").alias("covered"), F.count_if("missed").alias("miss"))
