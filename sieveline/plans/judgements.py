"""Queries over policies, reports, coverage views and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.functions import policy, settings
from sieveline.functions import text as T
from sieveline.operators import checks as C
from sieveline.operators import coverage, symbols
from sieveline.operators.storage import numbered
from sieveline.plans.registry import query, read
from sieveline.plans.reporting import _FINDINGS, _SUITE, _checks, _findings


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN 'FAIL' WHEN p_size > 30 OR p_partkey % 7 >= 5 THEN 'WARN' ELSE 'PASS' END AS status FROM part""")
def q_complexity_status(spark, sf_dir):
    """Parts judged as functions: size as complexity, strictly above its limits, nesting from its limit on."""
    parts = read(spark, sf_dir, "part", "p_partkey", "p_size")
    return parts.select("p_partkey", policy.complexity_status(F.col("p_size"), F.col("p_partkey") % 7, 30, 40, 5).alias("status"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN TRUE WHEN p_partkey % 3 = 0 THEN FALSE ELSE p_size < 10 OR p_retailprice < 1000 OR p_partkey % 11 < 2 END AS warns FROM part""")
def q_threshold_warning(spark, sf_dir):
    """Whether scores warn: forced without an optional part, not judged after failures."""
    parts = read(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")
    key = F.col("p_partkey")
    return parts.select("p_partkey", policy.below_threshold(F.col("p_size"), F.col("p_retailprice"), key % 11, 10, 1000, 2, key % 3 == 0, key % 5 == 0).alias("warns"))


_MODES = """CASE WHEN e OR q THEN 'ERROR' WHEN o AND NOT f THEN 'WARN' WHEN {fails} THEN 'FAIL' WHEN {warns} THEN 'WARN' ELSE 'PASS' END"""


@query(f"""SELECT p_partkey, {_MODES.format(fails="f", warns="w")} AS whole, {_MODES.format(fails="f OR w", warns="FALSE")} AS strict, {_MODES.format(fails="FALSE", warns="f OR w")} AS soft
  FROM (SELECT p_partkey, p_partkey % 11 = 0 AS e, p_partkey % 13 = 0 AS q, p_partkey % 5 = 0 AS o, p_size > 40 AS f, p_size > 30 AS w FROM part)""")
def q_result_status(spark, sf_dir):
    """Status of a check by precedence, under each mode."""
    parts, key, size = read(spark, sf_dir, "part", "p_partkey", "p_size"), F.col("p_partkey"), F.col("p_size")
    modes = {"whole": "pass_warn_fail", "strict": "pass_fail", "soft": "pass_warn"}
    return parts.select("p_partkey", *[policy.result_status(key % 11 == 0, key % 13 == 0, key % 5 == 0, size > 40, size > 30, mode).alias(name) for name, mode in modes.items()])


@query(f"""WITH {_FINDINGS}, off AS (SELECT 'src' || s_suppkey AS chk FROM supplier WHERE s_acctbal < 5000) SELECT chk, status FROM checks WHERE chk NOT IN (SELECT chk FROM off)""")
def q_enabled_checks(spark, sf_dir):
    """Checks that are switched on; those without a switch are."""
    switches = read(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal").select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("chk"), F.when(F.col("s_acctbal") < 5000, False).when(F.col("s_acctbal") < 7000, True).alias("enabled"))
    return C.enabled(_checks(_findings(spark, sf_dir)), switches, "chk").select("chk", "status")


_NAMES = "n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '_' WHEN 1 THEN '__' ELSE '' END || replace(p_name, ' ', '_') || CASE WHEN p_partkey % 3 = 0 THEN '__' ELSE '' END AS name FROM part)"


@query(f"WITH {_NAMES} SELECT p_partkey, starts_with(name, '_') AND NOT starts_with(name, '__') AS private, starts_with(name, '__') AND ends_with(name, '__') AS dunder FROM n")
def q_private_names(spark, sf_dir):
    """Which names are private, and which are reserved."""
    key = F.col("p_partkey")
    name = F.concat(F.when(key % 4 == 0, "_").when(key % 4 == 1, "__").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("_")), F.when(key % 3 == 0, "__").otherwise(""))
    return read(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", symbols.is_private(name).alias("private"), symbols.is_dunder(name).alias("dunder"))


@query("""SELECT p_partkey, CASE WHEN p_size >= 90 THEN 'green' WHEN p_size * 2 >= 90 THEN 'green' WHEN p_size * 2 >= 75 THEN 'yellow' ELSE 'red' END AS colour,
  CASE p_partkey % 5 WHEN 0 THEN '#10b981' WHEN 1 THEN '#f59e0b' WHEN 2 THEN '#ef4444' WHEN 3 THEN '#dc2626' ELSE '#9ca3af' END AS mark FROM part""")
def q_colours(spark, sf_dir):
    """Colours of coverage and of statuses."""
    key = F.col("p_partkey") % 5
    status = F.when(key == 0, "PASS").when(key == 1, "WARN").when(key == 2, "FAIL").when(key == 3, "ERROR").otherwise("SKIP")
    return read(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", policy.coverage_colour(F.col("p_size") * 2).alias("colour"), policy.status_colour(status).alias("mark"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || '.00 / 50.00' WHEN 1 THEN p_size || '.00' WHEN 2 THEN p_name ELSE '-' END AS shown FROM part""")
def q_shown_scores(spark, sf_dir):
    """Scores as shown: of the most there is, alone, the summary instead, or a dash."""
    key = F.col("p_partkey") % 4
    score, most = F.when(key < 2, F.col("p_size").cast("double")), F.when(key.isin(0, 2), F.lit(50.0))
    return read(spark, sf_dir, "part", "p_partkey", "p_size", "p_name").select("p_partkey", policy.shown_score(score, most, F.when(key != 3, F.col("p_name"))).alias("shown"))


@query("""SELECT p_partkey, CASE WHEN NOT p AND NOT n THEN 'estimated' ELSE concat_ws('/', CASE WHEN p THEN 'coverage.py' END, CASE WHEN n THEN 'gcov' END) || CASE WHEN (pa AND NOT p) OR (na AND NOT n) THEN ' (partial)' ELSE '' END END AS label
  FROM (SELECT p_partkey, p_partkey % 2 = 0 AS p, p_partkey % 3 = 0 AS n, p_partkey % 5 < 3 AS pa, p_partkey % 7 < 3 AS na FROM part)""")
def q_source_labels(spark, sf_dir):
    """Where coverage came from, and whether an attempted language is missing."""
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part", "p_partkey").select("p_partkey", coverage.source_label(key % 2 == 0, key % 3 == 0, key % 5 < 3, key % 7 < 3).alias("label"))


_MODULES = """m AS (SELECT source, lang AS file, count(*) AS stmts, count(l.doc_id) AS covered, count(*) - count(l.doc_id) AS miss, count(l.quality) FILTER (l.quality = 1) AS cb, count(l.doc_id) AS nb FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL)"""


def _modules(spark, sf_dir):
    joined = read(spark, sf_dir, "documents", "doc_id", "source", "lang").join(read(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id", "left")
    rows = joined.groupBy("source", F.col("lang").alias("file")).agg(F.count("*").alias("stmts"), F.count("quality").alias("covered"), F.count_if(F.col("quality").isNull()).alias("miss"), F.count_if(F.col("quality") == 1).alias("cb"), F.count("quality").alias("nb"))
    return rows.withColumn("cover", policy.percent(F.col("covered"), F.col("stmts")))


@query(f"""WITH {_MODULES} SELECT source, CAST(sum(stmts) AS BIGINT) AS stmts, CAST(sum(miss) AS BIGINT) AS miss, round_even(100.0 * sum(covered) / sum(stmts), 1) AS cover, CASE WHEN sum(nb) > 0 THEN round_even(100.0 * sum(cb) / sum(nb), 1) END AS branch_cover FROM m GROUP BY source""")
def q_combined_totals(spark, sf_dir):
    """Module rows of two languages put together, and their totals for each source."""
    rows = _modules(spark, sf_dir)
    return coverage.combined_totals(coverage.combined(rows.where("file = 'en'"), rows.where("file <> 'en'")), ["source"])


@query("""WITH r AS (SELECT source, count(*) AS n, count(l.doc_id) AS judged, count(*) FILTER (l.quality = 1) AS good, count(*) FILTER (l.toxic = 1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source)
SELECT source, CASE WHEN source = 'src7' THEN 100.0 WHEN n % 2 = 0 THEN CAST(n AS DOUBLE) WHEN toxic > 0 THEN 45.0 ELSE 85.0 END AS branch_cover,
  CASE WHEN source = 'src7' THEN 100.0 WHEN source <> 'src3' AND judged > 0 THEN CAST(good AS DOUBLE) / judged * 100 WHEN toxic > 0 THEN 50.0 ELSE 95.0 END AS func_cover FROM r""")
def q_function_share(spark, sf_dir):
    """Function and branch coverage of each source, with what is assumed where nothing was measured."""
    joined = read(spark, sf_dir, "documents", "doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    runs = joined.groupBy("source").agg(F.count("*").alias("n"), (F.count_if(F.col("toxic") == 1) > 0).alias("has_failure"))
    runs = runs.select("source", F.when(F.col("source") == "src7", 0).otherwise(F.col("n")).alias("code_lines"), "has_failure", F.when(F.col("n") % 2 == 0, F.col("n").cast("double")).alias("branch_cover"))
    rows = joined.where("quality IS NOT NULL AND source <> 'src3'").select("source", (F.col("quality") == 1).alias("covered"))
    return coverage.function_share(rows, runs, "source")


@query("""SELECT user_id % 25 AS file, CAST(user_id AS BIGINT) AS start, EXISTS (SELECT 1 FROM events e WHERE e.user_id % 25 = f.user_id % 25 AND e.event_type = 'view' AND e.event_id BETWEEN f.user_id * 10 AND f.user_id * 10 + 40) AS covered,
  coalesce((SELECT string_agg(event_id, ',' ORDER BY event_id) FROM events e WHERE e.user_id % 25 = f.user_id % 25 AND e.event_type = 'error' AND e.event_id BETWEEN f.user_id * 10 AND f.user_id * 10 + 40), '') AS missing
  FROM (SELECT DISTINCT user_id FROM events) f""")
def q_function_rows(spark, sf_dir):
    """Functions of covered files: views are executed lines, errors missing ones."""
    events = read(spark, sf_dir, "events", "event_id", "user_id", "event_type").withColumn("file", F.col("user_id") % 25)
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("event_type") == kind, F.col("event_id"))))
    files = events.groupBy("file").agg(of("view").alias("executed_lines"), of("error").alias("missing_lines"))
    functions = events.select("file", F.col("user_id").alias("name")).distinct().select("file", "name", (F.col("name") * 10).alias("body_start"), (F.col("name") * 10 + 40).alias("end_line"))
    rows = coverage.function_rows(functions, files)
    return rows.select("file", F.col("name").alias("start"), "covered", F.array_join(F.transform("missing_lines", lambda x: x.cast("string")), ",").alias("missing"))


@query("""WITH p AS (SELECT p_partkey, 'src/' || replace(p_name, ' ', '/') || '.c' AS path FROM part), s AS (SELECT DISTINCT path FROM p WHERE p_partkey % 3 = 0)
SELECT p_partkey, path FROM p WHERE path IN (SELECT path FROM s) AND p_partkey % 5 <> 4""")
def q_gcov_paths(spark, sf_dir):
    """Reports of source files, named plainly, by absolute path, or by a way round; others are about no source."""
    key = F.col("p_partkey")
    path = F.concat(F.lit("src/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit(".c"))
    parts = read(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", path.alias("path"))
    way = F.when(key % 5 == 1, F.concat(F.lit("/work/"), "path")).when(key % 5 == 2, F.concat(F.lit("x/../"), "path")).when(key % 5 == 3, F.concat(F.lit("./"), "path")).when(key % 5 == 4, F.concat(F.lit("../"), "path")).otherwise(F.col("path"))
    reports = parts.select("p_partkey", F.concat(F.replace(way, F.lit("/"), F.lit("#")), F.lit(".gcov")).alias("report"))
    return coverage.source_paths(reports, parts.where(key % 3 == 0).select("path"), "/work").select("p_partkey", "path")


@query("""SELECT source, count(*) FILTER (s = 'PASS') AS n_pass, count(*) FILTER (s = 'WARN') + CASE WHEN source < 'src15' THEN 2 ELSE 0 END AS n_warn, count(*) FILTER (s = 'FAIL') AS n_fail, max(n) AS most,
  CASE WHEN count(*) FILTER (s = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (s = 'WARN') > 0 OR source < 'src15' THEN 'WARN' ELSE 'PASS' END AS status
  FROM (SELECT source, n_chars AS n, CASE WHEN n_chars > 30000 THEN 'FAIL' WHEN n_chars > 5000 THEN 'WARN' ELSE 'PASS' END AS s FROM documents) GROUP BY source""")
def q_check_rows(spark, sf_dir):
    """Checks made from findings: counts, the greatest value, and what the tools warned of themselves."""
    docs = read(spark, sf_dir, "documents", "source", "n_chars")
    found = docs.select("source", F.col("n_chars").alias("n"), policy.two_thresholds(F.col("n_chars"), 5000, 30000).alias("status"))
    warnings = docs.where("source < 'src15'").select("source").distinct().select("source", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("message"))
    rows = C.check_rows(found, "source", F.lit(True), F.lit("MEASURED"), warnings=warnings)
    return rows.join(found.groupBy("source").agg(F.max("n").alias("most")), "source").select("source", "n_pass", "n_warn", "n_fail", "most", "status")


_TARGETS = """'[' || string_agg('{"target":' || target || ',"status":"' || status || '"}', ',' ORDER BY target, status) || ']'"""


@query(f"""WITH {_FINDINGS}, t AS (SELECT chk, {_TARGETS} AS targets FROM findings GROUP BY chk
), r AS (SELECT string_agg('{{"chk":"' || chk || '","status":"' || c.status || '","evidence":"' || evidence || '","required":' || required || ',"suite":' || suite || ',"targets":' || targets || '}}', ',' ORDER BY chk) AS rows FROM checks c JOIN t USING (chk)
), s AS (SELECT {_SUITE} AS st, count(*) AS n, count(*) FILTER (status = 'PASS') AS p, count(*) FILTER (status = 'WARN') AS w, count(*) FILTER (status = 'FAIL') AS f, count(*) FILTER (status = 'ERROR') AS e, count(*) FILTER (status = 'SKIP') AS k FROM checks)
SELECT '{{"suite_status":"' || st || '","n_checks":' || n || ',"n_pass":' || p || ',"n_warn":' || w || ',"n_fail":' || f || ',"n_error":' || e || ',"n_skip":' || k || ',"exit_code":' || CASE WHEN st IN ('FAIL', 'ERROR') THEN 1 WHEN st = 'SKIP' THEN 2 ELSE 0 END || ',"results":[' || rows || ']}}' AS json FROM s, r""")
def q_suite_json(spark, sf_dir):
    """The whole suite as one JSON object."""
    findings = _findings(spark, sf_dir)
    return C.suite_json(_checks(findings), findings, "chk")


@query(f"""WITH {_FINDINGS}, i AS (SELECT chk, string_agg(target || ':' || status, ',' ORDER BY target, status) AS issues FROM findings WHERE status <> 'PASS' GROUP BY chk) SELECT chk, status, coalesce(issues, '') AS issues FROM checks LEFT JOIN i USING (chk)""")
def q_summary_rows(spark, sf_dir):
    """Checks with their issues inlined."""
    findings = _findings(spark, sf_dir)
    rows = C.summary_rows(_checks(findings), findings, "chk")
    return rows.select("chk", "status", F.array_join(F.transform("issues", lambda s: F.concat_ws(":", s["target"].cast("string"), s["status"])), ",").alias("issues"))


@query(f"""WITH {_FINDINGS}, n AS (SELECT chk, count(*) AS n FROM findings GROUP BY chk)
SELECT chk, CASE status WHEN 'PASS' THEN '✅' WHEN 'WARN' THEN '⚠️' WHEN 'FAIL' THEN '❌' WHEN 'ERROR' THEN '🚨' ELSE '⏭️' END || ' ' || status AS badge, n || ' findings' AS summary, CASE WHEN n % 2 = 0 THEN n || '.00 / 99.00' ELSE n || ' in all' END AS score, CASE WHEN n % 3 = 0 THEN '-' ELSE n || '.50s' END AS duration FROM checks JOIN n USING (chk)""")
def q_dashboard(spark, sf_dir):
    """The console's table of checks."""
    findings = _findings(spark, sf_dir)
    rows = _checks(findings).join(findings.groupBy("chk").agg(F.count("*").alias("n")), "chk")
    n = F.col("n").cast("string")
    return C.dashboard(rows.select("chk", "status", F.concat(n, F.lit(" findings")).alias("summary"), F.when(F.col("n") % 2 == 0, F.col("n").cast("double")).alias("score"), F.lit(99.0).alias("max_score"), F.concat(n, F.lit(" in all")).alias("metrics"), F.when(F.col("n") % 3 == 0, 0.0).otherwise(F.col("n") + 0.5).alias("duration")), "chk")


@query(f"""WITH {_FINDINGS} SELECT 'Total: ' || count(*) || ' (Pass: ' || count(*) FILTER (status = 'PASS') || ', Warn: ' || count(*) FILTER (status = 'WARN') || ', Fail: ' || count(*) FILTER (status = 'FAIL') || ', Error: ' || count(*) FILTER (status = 'ERROR') || ', Skip: ' || count(*) FILTER (status = 'SKIP') || ')' AS footer FROM checks""")
def q_footer(spark, sf_dir):
    """The console's last line."""
    return C.footer(_checks(_findings(spark, sf_dir)))


@query("""WITH f AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents JOIN labels USING (doc_id) WHERE quality = 0)
SELECT source, string_agg('**d' || doc_id || '**' || chr(10) || '```' || chr(10) || 's' || doc_id || chr(10) || '```', chr(10) ORDER BY k) AS markdown FROM f WHERE k <= 5 GROUP BY source""")
def q_failure_details(spark, sf_dir):
    """The first five failures of each source with fenced snippets."""
    found = read(spark, sf_dir, "documents", "doc_id", "source").join(read(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id")
    key = F.col("doc_id").cast("string")
    rows = found.select("source", F.lit("f").alias("file_path"), F.col("doc_id").alias("start_line"), F.when(F.col("quality") == 0, "FAIL").otherwise("PASS").alias("status"), F.concat(F.lit("d"), key).alias("message"), F.concat(F.lit("s"), key).alias("snippet"))
    return C.failure_details(rows, "source")


_URL = r"""u AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)"""


def _urls(spark, sf_dir):
    return read(spark, sf_dir, "pages", "page_id", "url").withColumn("path", F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", ""))


@query(rf"""WITH {_URL}, d AS (SELECT page_id, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir FROM u)
SELECT dir, count(*) AS n_files, CAST(sum(page_id) AS BIGINT) AS pages, CAST(len(string_split(dir, '/')) AS BIGINT) AS depth, row_number() OVER (ORDER BY string_split(dir, '/')) AS place FROM d GROUP BY dir""")
def q_directory_tree(spark, sf_dir):
    """Directories in order of their parts, with sums over their own files."""
    tree = C.directory_tree(_urls(spark, sf_dir).select("path", F.col("page_id").alias("pages")), "path", ["pages"])
    return numbered(tree, [F.split("dir", "/")], "place").select("dir", "n_files", "pages", F.col("depth").cast("long").alias("depth"), F.col("place").cast("long").alias("place"))


@query("""SELECT page_id, repeat('`', greatest(3, 1 + page_id % 9)) AS fence FROM pages""")
def q_fences(spark, sf_dir):
    """Fences longer than any run of back-ticks in a text."""
    text = F.concat(F.lit("a`b"), F.repeat(F.lit("`"), (F.col("page_id") % 9).cast("int")), F.lit("c``"))
    text = F.when(F.col("page_id") % 9 < 2, F.lit("a`b")).otherwise(F.concat(F.lit("a`b "), F.repeat(F.lit("`"), (F.col("page_id") % 9).cast("int")), F.lit(" c``")))
    return read(spark, sf_dir, "pages", "page_id").select("page_id", T.fence_for(text).alias("fence"))


@query(rf"""WITH {_URL} SELECT page_id, CASE WHEN page_id % 4 = 3 THEN NULL ELSE 'https://h.x/r/blob/a%20' || page_id || '/d%C3%A9/' || path || '#L' || page_id || CASE WHEN page_id % 2 = 0 THEN '-L' || (page_id + 3) ELSE '' END END AS link FROM u""")
def q_permalinks(spark, sf_dir):
    """Links to lines of files at a revision; none for what is no address."""
    page = F.col("page_id")
    base = F.when(page % 4 == 3, "javascript:x").otherwise("https://h.x/r/")
    end = F.when(page % 2 == 0, page + 3).otherwise(page)
    return _urls(spark, sf_dir).select("page_id", T.permalink(base, F.concat(F.lit("a "), page.cast("string")), F.concat(F.lit("dé/"), "path"), page, end).alias("link"))


@query("SELECT o_orderkey, format('{:,}', o_orderkey * 977) AS shown FROM orders")
def q_grouped_digits(spark, sf_dir):
    """Numbers with separators."""
    return read(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", T.grouped_digits(F.col("o_orderkey") * 977).alias("shown"))


@query(rf"""SELECT doc_id, substr(trim(regexp_replace(translate(text, '{T.WHITE_SPACE}', repeat(' ', {len(T.WHITE_SPACE)})), ' +', ' ', 'g')), 1, 300) AS shown FROM documents""")
def q_shortened(spark, sf_dir):
    """Texts with white space collapsed, at most 300 characters."""
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.shortened(F.col("text")).alias("shown"))


@query("""WITH p AS (SELECT p_partkey, replace(p_name, ' ', '.') AS pkg, p_partkey % 4 AS level, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'm' || p_partkey END AS name FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN pkg ELSE pkg || '.x' END AS module, CASE WHEN level = 0 THEN name
  ELSE concat_ws('.', nullif(array_to_string(list_slice(string_split('a.' || pkg, '.'), 1, 4 - level), '.'), ''), nullif(name, '')) END AS resolved FROM p""")
def q_module_names(spark, sf_dir):
    """Module names of source paths, and what relative imports mean."""
    key = F.col("p_partkey")
    parts = read(spark, sf_dir, "part", "p_partkey", "p_name").withColumn("pkg", F.replace("p_name", F.lit(" "), F.lit(".")))
    path = F.concat(F.lit("lib/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.when(key % 2 == 0, "/__init__.py").otherwise("/x.py"))
    name = F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("m"), key.cast("string")))
    return parts.select("p_partkey", T.module_name(path).alias("module"), T.resolved_import(F.concat(F.lit("a."), "pkg"), (key % 4).cast("int"), name).alias("resolved"))


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE 'v' || p_size || '.' || p_partkey END AS release, CASE WHEN p_partkey % 5 < 2 THEN 'n-' || p_partkey END AS name FROM part""")
def q_release_names(spark, sf_dir):
    """Versions and project names where they are such."""
    key = F.col("p_partkey")
    version = F.concat(F.when(key % 4 == 1, "v").otherwise(""), F.col("p_size").cast("string"), F.when(key % 4 == 3, " ").otherwise("."), key.cast("string"))
    name = F.when(key % 5 == 2, "..").when(key % 5 == 3, "a/b").when(key % 5 == 4, "x\n").otherwise(F.concat(F.lit("n-"), key.cast("string")))
    return read(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", T.release_name(version).alias("release"), T.project_name(name).alias("name"))


@query(rf"""WITH {_URL} SELECT page_id, CASE page_id % 3 WHEN 0 THEN path WHEN 1 THEN '/other/' || path ELSE 'x/../' || path END AS relative, page_id % 3 = 0 AS inside FROM u""")
def q_relative_paths(spark, sf_dir):
    """Paths below a root, and whether they stay there."""
    way = F.col("page_id") % 3
    path = F.concat(F.when(way == 0, "/work/").when(way == 1, "/other/").otherwise("/work/x/../"), "path")
    return _urls(spark, sf_dir).select("page_id", T.relative_to(path, "/work").alias("relative"), (T.within(path, "/work") & (way != 2)).alias("inside"))


@query(r"""SELECT doc_id, CAST(len([s FOR s IN parts IF s <> '' AND NOT (starts_with(s, '#') OR starts_with(s, '//') OR starts_with(s, '/*'))]) AS BIGINT) AS n
  FROM (SELECT doc_id, [trim(x) FOR x IN string_split_regex(replace(replace(replace(text, 'The ', '# '), 'And ', '// '), 'In ', '  /* '), '\r\n|\n|\r')] AS parts FROM documents)""")
def q_simple_code_lines(spark, sf_dir):
    """Code lines without regard to blocks; some lines begin like comments."""
    text = T.replaced(F.col("text"), [("The ", "# "), ("And ", "// "), ("In ", "  /* ")])
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.simple_code_lines(text).alias("n"))


_SETTINGS = {
    0: ("engines.line.warn_limit", "{k}"), 1: ("engines.line.fail_limit", "400"), 2: ("engines.line.mode", '"soft"'), 3: ("engines.test.min_tem_score", "{k}.5"), 4: ("engines.dup.warn_pct", "true"),
    5: ("engines.line.gate_dirs", '["src", "../x{k}"]'), 6: ("project.name", '" "'), 7: ("engines.lint.size", "{k}"), 8: ("engines.lint.enabled", "1"), 9: ("project.source_dirs", '["a", ""]'), 10: ("engines.complexity.fail_cc", "{k}"), 11: ("type", '"cpp"'),
}


@query("""WITH e AS (SELECT user_id, event_id, event_id % 12 AS kind, user_id % 30 AS k FROM events), one AS (SELECT DISTINCT user_id, kind, k FROM e), said AS (
  SELECT user_id, CASE kind WHEN 0 THEN 'engines.line.warn_limit' WHEN 2 THEN 'engines.line.mode' WHEN 3 THEN 'engines.test.min_tem_score' WHEN 4 THEN 'engines.dup.warn_pct' WHEN 5 THEN 'engines.line.gate_dirs' WHEN 6 THEN 'project.name' WHEN 7 THEN 'engines.lint.size' WHEN 8 THEN 'engines.lint.enabled' WHEN 9 THEN 'project.source_dirs' WHEN 10 THEN 'engines.complexity.fail_cc' END AS path,
    CASE kind WHEN 0 THEN CASE WHEN k < 1 THEN 'must be greater than or equal to 1' END WHEN 2 THEN 'must be one of: pass_fail, pass_warn, pass_warn_fail' WHEN 3 THEN CASE WHEN k >= 5 THEN 'must be less than or equal to 5' END WHEN 4 THEN 'must be a number'
      WHEN 5 THEN 'must stay inside the project' WHEN 6 THEN 'must be a non-empty string' WHEN 7 THEN 'is an unknown configuration key' WHEN 8 THEN 'must be a boolean' WHEN 9 THEN 'must be a list of non-empty strings' WHEN 10 THEN CASE WHEN k < 1 THEN 'must be greater than or equal to 1' END END AS message FROM one)
SELECT user_id, path, message FROM said WHERE message IS NOT NULL
UNION ALL SELECT user_id, 'engines.line.warn_limit', 'must be less than or equal to engines.line.fail_limit' FROM one GROUP BY user_id HAVING bool_or(kind = 1) AND NOT bool_or(kind = 0 AND k < 1) AND coalesce(max(CASE WHEN kind = 0 THEN k END), 500) > 400
UNION ALL SELECT user_id, 'engines.complexity.warn_cc', 'must be less than or equal to engines.complexity.fail_cc' FROM one GROUP BY user_id HAVING bool_or(kind = 10) AND max(CASE WHEN kind = 10 THEN k END) BETWEEN 1 AND 14""")
def q_setting_violations(spark, sf_dir):
    """Settings of many projects against the closed schema: unknown keys, kinds, limits, choices, paths, pairs."""
    rows = read(spark, sf_dir, "events", "user_id", "event_id").select("user_id", (F.col("event_id") % 12).alias("kind")).distinct()
    k = (F.col("user_id") % 30).cast("string")
    path, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, (name, template) in _SETTINGS.items():
        path = F.when(F.col("kind") == kind, name).otherwise(path)
        value = F.when(F.col("kind") == kind, F.replace(F.lit(template), F.lit("{k}"), k)).otherwise(value)
    return settings.setting_violations(rows.select("user_id", path.alias("path"), value.alias("json")), "user_id")
