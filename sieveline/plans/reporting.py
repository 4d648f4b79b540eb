"""Queries over checks and findings: suites, issues, leaderboards and report rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.functions import policy
from sieveline.operators import checks as C
from sieveline.plans.registry import query, read

_FINDINGS = """findings AS (
  SELECT d.source AS chk, d.doc_id AS target, CASE WHEN l.toxic = 1 THEN 'FAIL' WHEN l.quality = 0 THEN 'WARN' WHEN l.doc_id IS NULL THEN 'SKIP' ELSE 'PASS' END AS status
  FROM documents d LEFT JOIN labels l USING (doc_id)
), checks AS (
  SELECT chk, CASE WHEN count(*) FILTER (status <> 'SKIP') < 3 THEN 'ERROR' WHEN count(*) FILTER (status = 'FAIL') > 3 THEN 'FAIL' WHEN count(*) FILTER (status IN ('FAIL', 'WARN')) > 0 THEN 'WARN' ELSE 'PASS' END AS status,
    ascii(substr(chk, length(chk), 1)) % 3 <> 0 AS required, CASE WHEN count(*) FILTER (status = 'SKIP') * 2 > count(*) THEN 'ESTIMATED' ELSE 'MEASURED' END AS evidence, ascii(substr(chk, length(chk), 1)) % 4 AS suite
  FROM findings GROUP BY chk)"""


def _findings(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("toxic") == 1, "FAIL").when(F.col("quality") == 0, "WARN").when(F.col("quality").isNull(), "SKIP").otherwise("PASS")
    return docs.select(F.col("source").alias("chk"), F.col("doc_id").alias("target"), status.alias("status"))


def _checks(findings):
    n = {s: F.count_if(F.col("status") == s) for s in ("SKIP", "FAIL", "WARN")}
    status = F.when(F.count("*") - n["SKIP"] < 3, "ERROR").when(n["FAIL"] > 3, "FAIL").when(n["FAIL"] + n["WARN"] > 0, "WARN").otherwise("PASS")
    last = F.ascii(F.substring("chk", -1, 1))
    grouped = findings.groupBy("chk").agg(status.alias("status"), F.when(n["SKIP"] * 2 > F.count("*"), "ESTIMATED").otherwise("MEASURED").alias("evidence"))
    return grouped.withColumns({"required": last % 3 != 0, "suite": (last % 4).cast("long")})


_SUITE = """CASE WHEN count(*) = 0 THEN 'ERROR' WHEN bool_or(required AND (status IN ('ERROR', 'SKIP') OR evidence = 'NOT_RUN')) THEN 'ERROR'
  WHEN bool_or(required AND status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARN' OR (NOT required AND (status <> 'PASS' OR evidence <> 'MEASURED'))) THEN 'WARN' ELSE 'PASS' END"""


@query(f"""WITH {_FINDINGS}, s AS (SELECT suite, {_SUITE} AS suite_status, count(*) AS n_checks, count(*) FILTER (status = 'PASS') AS n_pass, count(*) FILTER (status = 'WARN') AS n_warn,
  count(*) FILTER (status = 'FAIL') AS n_fail, count(*) FILTER (status = 'ERROR') AS n_error, count(*) FILTER (status = 'SKIP') AS n_skip FROM checks GROUP BY suite)
SELECT CAST(suite AS BIGINT) AS suite, suite_status, n_checks, n_pass, n_warn, n_fail, n_error, n_skip, CAST(CASE WHEN suite_status IN ('FAIL', 'ERROR') THEN 1 WHEN suite_status = 'SKIP' THEN 2 ELSE 0 END AS BIGINT) AS exit_code FROM s""")
def q_suite_status(spark, sf_dir):
    """Status, counts and exit code of each suite of checks."""
    return policy.suite_status(_checks(_findings(spark, sf_dir)), ["suite"])


@query(f"""WITH {_FINDINGS}, found AS (SELECT chk, target, status FROM findings WHERE status IN ('FAIL', 'WARN'))
SELECT chk, target, status FROM found UNION ALL SELECT chk, NULL, status FROM checks WHERE status IN ('ERROR', 'SKIP') AND chk NOT IN (SELECT chk FROM found)""")
def q_issue_view(spark, sf_dir):
    """Issues, with a row for each silent check that did not run."""
    findings = _findings(spark, sf_dir)
    return C.issues(_checks(findings), findings.where(F.col("status") != "SKIP"), "chk")


@query(f"""WITH {_FINDINGS}, b AS (SELECT chk, count(*) FILTER (status = 'PASS') AS good, count(*) AS n FROM findings GROUP BY chk)
SELECT chk, good, n, rpad(repeat('█', CAST(floor(good * 50 / greatest(n, 1)) AS INTEGER)), 50, '░') AS bar FROM b""")
def q_status_bar(spark, sf_dir):
    """Share of passes of each check as a bar."""
    counts = _findings(spark, sf_dir).groupBy("chk").agg(F.count_if(F.col("status") == "PASS").alias("good"), F.count("*").alias("n"))
    return counts.withColumn("bar", C.bar(F.col("good"), F.col("n")))


@query(f"""WITH {_FINDINGS}, b AS (SELECT chk, count(*) FILTER (status = 'FAIL') AS n_fail FROM findings GROUP BY chk)
SELECT row_number() OVER (ORDER BY n_fail DESC, chk) AS rank, chk, n_fail FROM b ORDER BY n_fail DESC, chk LIMIT 15""")
def q_leaderboard(spark, sf_dir):
    """The fifteen checks with most failures, ranked."""
    counts = _findings(spark, sf_dir).groupBy("chk").agg(F.count_if(F.col("status") == "FAIL").alias("n_fail"))
    return C.ranked(counts.orderBy(F.desc("n_fail"), "chk").limit(15), F.desc("n_fail"), "chk").select("rank", "chk", "n_fail")


def _command(sql: str, prop: bool) -> str:
    for old, new in [("'%'", "'%25'"), ("chr(13)", "'%0D'"), ("chr(10)", "'%0A'")] + ([("':'", "'%3A'"), ("','", "'%2C'")] if prop else []):
        sql = f"replace({sql}, {old}, {new})"
    return sql


_PAGES = "SELECT p.page_id, p.url, p.html AS message, CASE WHEN l.toxic = 1 THEN 'FAIL' WHEN l.quality = 0 THEN 'WARN' ELSE 'PASS' END AS status FROM pages p LEFT JOIN labels l ON l.doc_id = p.page_id"


def _page_findings(spark, sf_dir):
    pages = read(spark, sf_dir, "pages", "page_id", "url", "html")
    labels = read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "page_id")
    status = F.when(F.col("toxic") == 1, "FAIL").when(F.col("quality") == 0, "WARN").otherwise("PASS")
    return pages.join(labels, "page_id", "left").select("page_id", F.col("url").alias("file_path"), (F.col("page_id") + 1).alias("start_line"), F.lit("page, label").alias("check"), F.col("html").alias("message"), status.alias("status"))


@query(f"""SELECT page_id, '::' || CASE WHEN status = 'FAIL' THEN 'error' ELSE 'warning' END || ' file=' || {_command("url", True)} || ',line=' || (page_id + 1) || ',title=page%2C label::' || {_command("message", False)} AS annotation
  FROM ({_PAGES}) WHERE status <> 'PASS'""")
def q_annotations(spark, sf_dir):
    """Escaped annotations for labelled pages."""
    return C.annotations(_page_findings(spark, sf_dir)).select("page_id", "annotation")


def _cell(sql: str) -> str:
    pairs = [("'&'", "'&amp;'"), ("'<'", "'&lt;'"), ("'>'", "'&gt;'"), ("'\"'", "'&quot;'"), ("''''", "'&#x27;'"), ("chr(13) || chr(10)", "'<br>'"), ("chr(10)", "'<br>'"), ("chr(13)", "'<br>'"), ("'|'", "'&#124;'"), ("'`'", "'&#96;'")]
    for old, new in pairs:
        sql = f"replace({sql}, {old}, {new})"
    return sql


@query(f"SELECT page_id, '| ' || {_cell('url')} || ' | ' || status || ' | ' || {_cell('message')} || ' |' AS row FROM ({_PAGES})")
def q_markdown_rows(spark, sf_dir):
    """Escaped table rows for pages."""
    rows = _page_findings(spark, sf_dir).select("page_id", F.col("file_path").alias("check"), "status", F.col("message").alias("summary"))
    return C.markdown_rows(rows).select("page_id", "row")


@query(f"""WITH {_FINDINGS} SELECT chk, '{{"chk":"' || chk || '","n":' || count(*) || ',"targets":[' || string_agg('{{"target":' || target || ',"status":"' || status || '"}}', ',' ORDER BY target) || ']}}' AS json FROM findings GROUP BY chk""")
def q_json_report(spark, sf_dir):
    """Each check as one JSON object with its findings nested."""
    findings = _findings(spark, sf_dir)
    counts = findings.groupBy("chk").agg(F.count("*").alias("n"))
    return C.json_report(counts, findings, "chk")


@query(f"""WITH {_FINDINGS} SELECT chk, status, CASE status WHEN 'SKIP' THEN 0 WHEN 'WARN' THEN 1 WHEN 'ERROR' THEN 2 WHEN 'PASS' THEN 3 ELSE 4 END::BIGINT AS rank FROM checks ORDER BY rank, chk""")
def q_comment_order(spark, sf_dir):
    """Checks in the order in which a published comment lists them."""
    rows = _checks(_findings(spark, sf_dir)).select("chk", "status", policy.severity_rank(F.col("status")).cast("long").alias("rank"))
    return rows.orderBy("rank", "chk")
