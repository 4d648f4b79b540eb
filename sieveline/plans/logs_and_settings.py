"""Queries that write records as tool output and read them back, and over layered settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.functions import policy, settings
from sieveline.operators import checks as C
from sieveline.operators import coverage
from sieveline.plans.registry import query, read
from sieveline.sources import logs, records


def _joined(df, key, line, order):
    """One text for each key from its lines in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda s: s["line"])
    return df.groupBy(key).agg(F.array_join(listed, "\n").alias("log"))


@query("""SELECT l_suppkey, CAST(count(*) FILTER (l_returnflag = 'R' OR l_quantity > 0 AND l_returnflag = 'N') AS BIGINT) AS stmts,
  count(*) FILTER (l_quantity > 0 AND l_returnflag = 'N') AS covered, count(*) FILTER (l_returnflag = 'R') AS miss
  FROM lineitem GROUP BY l_suppkey HAVING count(*) FILTER (l_returnflag = 'R' OR l_quantity > 0 AND l_returnflag = 'N') > 0""")
def q_gcov_rows(spark, sf_dir):
    """Order lines written as execution counts, parsed into covered and missed statements."""
    items = read(spark, sf_dir, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    count = F.when(F.col("l_returnflag") == "R", "#####").when(F.col("l_returnflag") == "A", "-").otherwise(F.col("l_quantity").cast("int").cast("string"))
    line = F.format_string("%9s:%5d:code", count, F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    texts = _joined(items, "l_suppkey", line, F.struct("l_orderkey", "l_linenumber").alias("at"))
    return logs.gcov_modules(texts, "l_suppkey", "log").select("l_suppkey", "stmts", "covered", "miss")


@query("""SELECT o_custkey % 100 AS suite, count(*) FILTER (o_orderstatus <> 'F') AS passed, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') > 0 AS has_failure
  FROM orders GROUP BY 1""")
def q_test_log(spark, sf_dir):
    """Orders written as verbose test output, counted by suite."""
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus").withColumn("suite", F.col("o_custkey") % 100)
    line = F.format_string("tests/test_%d.py::test_%d %s [ 1%%]", F.col("suite"), F.col("o_orderkey"), F.when(F.col("o_orderstatus") == "F", "FAILED").otherwise("PASSED"))
    return logs.pytest_totals(_joined(orders, "suite", line, F.col("o_orderkey").alias("at")), "suite").select("suite", "passed", "total", "has_failure")


@query("""WITH f AS (SELECT source AS doc, lang AS file, count(*) AS n, count(l.doc_id) AS c FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL)
SELECT doc, CAST(sum(n) AS BIGINT) AS stmts, CAST(sum(n - c) AS BIGINT) AS miss, round_even(100.0 * sum(c) / sum(n), 1) AS cover FROM f GROUP BY doc""")
def q_coverage_json(spark, sf_dir):
    """Labels written as coverage JSON for each source, validated and totalled."""
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "lang").join(read(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id", "left")
    hit = F.col("quality").isNotNull()
    line = F.col("doc_id") + 1
    files = docs.groupBy("source", "lang").agg(F.array_sort(F.collect_list(F.when(hit, line))).alias("executed_lines"), F.array_sort(F.collect_list(F.when(~hit, line))).alias("missing_lines"))
    zero = F.lit(0).cast("long")
    covered, missed = F.size("executed_lines").cast("long"), F.size("missing_lines").cast("long")
    summary = F.struct(covered.alias("covered_lines"), (covered + missed).alias("num_statements"), missed.alias("missing_lines"), zero.alias("num_branches"), zero.alias("covered_branches"))
    infos = files.select("source", "lang", F.struct("executed_lines", "missing_lines", summary.alias("summary")).alias("info"))
    sums = F.struct(*[F.sum(f"info.summary.{c}").alias(c) for c in records.COUNTERS])
    texts = infos.groupBy("source").agg(F.to_json(F.struct(sums.alias("totals"), F.map_from_entries(F.collect_list(F.struct("lang", "info"))).alias("files"))).alias("json"))
    return coverage.totals(coverage.checked_documents(records.coverage_documents(texts, "source", "json"))).select("doc", "stmts", "miss", "cover")


@query("""SELECT event_type, user_id % 20 AS name, arg_max(CAST(json_extract_string(props, '$.k') AS BIGINT), event_id) AS value FROM events GROUP BY ALL""")
def q_layered_settings(spark, sf_dir):
    """Events as settings layers: the last one wins."""
    rows = read(spark, sf_dir, "events", "event_id", "event_type", "user_id", "props").select("event_type", (F.col("user_id") % 20).alias("name"), F.get_json_object("props", "$.k").cast("long").alias("value"), "event_id")
    return settings.layered(rows, ["event_type", "name"], "event_id")


@query("""SELECT p_partkey, c AS "constraint" FROM (SELECT p_partkey, unnest([CASE WHEN p_size <= 40 THEN NULL ELSE 'size' END, CASE WHEN p_retailprice >= 950 THEN NULL ELSE 'price' END, CASE WHEN starts_with(p_brand, 'Brand') THEN NULL ELSE 'brand' END]) AS c FROM part) WHERE c IS NOT NULL""")
def q_violations(spark, sf_dir):
    """Parts that break constraints, one row for each."""
    parts = read(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice", "p_brand")
    return settings.violations(parts, "p_partkey", {"size": F.col("p_size") <= 40, "price": F.col("p_retailprice") >= 950, "brand": F.startswith("p_brand", F.lit("Brand"))})


@query("""WITH f AS (SELECT 's' || doc_id % 60 AS scope, CASE WHEN toxic = 1 THEN 'FAIL' ELSE 'PASS' END AS status, 'label' AS message FROM labels WHERE quality = 0),
s AS (SELECT DISTINCT 's' || doc_id % 60 AS scope FROM documents)
SELECT scope, status, message FROM f UNION ALL SELECT scope, 'SKIP', 'not run' FROM s WHERE scope NOT IN (SELECT scope FROM f)""")
def q_empty_scopes(spark, sf_dir):
    """Findings, and a row for every scope without any."""
    scope = F.concat(F.lit("s"), (F.col("doc_id") % 60).cast("string")).alias("scope")
    found = read(spark, sf_dir, "labels").where("quality = 0").select(scope, F.when(F.col("toxic") == 1, "FAIL").otherwise("PASS").alias("status"), F.lit("label").alias("message"))
    return C.with_empty_scopes(read(spark, sf_dir, "documents", "doc_id").select(scope).distinct(), found, "scope")


@query("""SELECT user_id, arg_max(event_type, event_id) FILTER (event_type <> 'view') AS decision FROM events GROUP BY user_id HAVING count(*) FILTER (event_type <> 'view') > 0""")
def q_innermost_scope(spark, sf_dir):
    """The decision of the deepest scope that has one; views decide nothing."""
    rows = read(spark, sf_dir, "events", "user_id", "event_id", "event_type").select("user_id", F.col("event_id").alias("depth"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("decision"))
    return settings.innermost(rows, "user_id", "depth", "decision")


_SCOPES = """SELECT source, count(*) FILTER (l.toxic = 1) AS bad, count(l.doc_id) AS measured, count(*) - count(l.doc_id) AS skipped, count(*) FILTER (l.quality = 0) AS warned FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source"""


@query(f"""SELECT source, CASE WHEN measured > 0 AND skipped > 0 THEN CASE WHEN bad > 2 THEN 'FAIL' ELSE 'WARN' END WHEN measured > 0 THEN CASE WHEN bad > 2 OR warned > 0 THEN 'FAIL' ELSE 'PASS' END ELSE 'SKIP' END AS status,
  CASE WHEN measured > 0 AND skipped > 0 THEN 'ESTIMATED' WHEN measured > 0 THEN 'MEASURED' ELSE 'ESTIMATED' END AS evidence FROM ({_SCOPES})""")
def q_scope_status(spark, sf_dir):
    """Status of sources of which only a part is labelled."""
    joined = read(spark, sf_dir, "documents", "doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    sums = joined.groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count("toxic").alias("measured"), F.count_if(F.col("toxic").isNull()).alias("skipped"), F.count_if(F.col("quality") == 0).alias("warned"))
    status, evidence = policy.scope_status(F.lit(0), F.col("measured"), F.col("skipped"), F.col("bad") > 2, F.col("warned") > 0)
    return sums.select("source", status.alias("status"), evidence.alias("evidence"))
