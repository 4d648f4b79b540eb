"""Queries that write rows as the output of tools, read it back, and judge the runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.functions import policy
from sieveline.plans.registry import query, read
from sieveline.sources import logs, records


def _of_type(**lines):
    """The line of each type of event; none for types that are not named."""
    out = F.lit(None).cast("string")
    for kind, line in lines.items():
        out = F.when(F.col("event_type") == kind, line).otherwise(out)
    return out


def _id():
    return F.col("event_id").cast("string")


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events", "event_id", "user_id", "event_type").withColumn("run", F.expr("event_id div 200"))


def _runs(spark, sf_dir, line):
    """(run, log): one log for 200 events in a row, a line for each event that has one."""
    rows = _events(spark, sf_dir).withColumn("line", line).where(F.col("line").isNotNull())
    listed = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda s: s["line"])
    return rows.groupBy("run").agg(F.array_join(listed, "\n").alias("log"))


_E = "e AS (SELECT *, event_id // 200 AS run FROM events)"
_D = "d AS (SELECT *, source || '/' || doc_id // 200 AS part FROM documents)"


def _parts(spark, sf_dir, *columns):
    """Documents with ``part``: those of a source among 200 ids in a row."""
    part = F.concat_ws("/", "source", F.expr("cast(doc_id div 200 as string)"))
    return read(spark, sf_dir, "documents", "doc_id", "source", *columns).withColumn("part", part)


@query("""SELECT l_orderkey // 200 AS part, 'f' || l_orderkey || '_' || l_linenumber AS name, l_returnflag <> 'R' AND l_quantity >= 1 AS covered FROM lineitem""")
def q_gcov_functions(spark, sf_dir):
    """Order lines written as function counts, parsed again."""
    items = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    calls = F.when(F.col("l_returnflag") == "R", 0).otherwise(F.col("l_quantity").cast("int"))
    line = F.format_string("function f%d_%d called %d returned 100%% blocks executed 75%%", "l_orderkey", "l_linenumber", calls)
    texts = items.groupBy(F.expr("l_orderkey div 200").alias("part")).agg(F.array_join(F.collect_list(line), "\n").alias("log"))
    return logs.gcov_functions(texts, "part", "log")


@query(f"""WITH {_E} SELECT run, 'test_' || event_id || ' (m.T)' AS target_name, CASE WHEN event_type = 'view' THEN 'PASS' ELSE 'FAIL' END AS status FROM e WHERE event_type IN ('view', 'error', 'click')""")
def q_unittest_log(spark, sf_dir):
    """Events written as unittest output, parsed again; other lines say nothing."""
    name = F.concat(F.lit("test_"), _id(), F.lit(" (m.T) ... "))
    line = _of_type(view=F.concat(name, F.lit("ok")), error=F.concat(name, F.lit("ERROR")), click=F.concat(name, F.lit("FAIL")), signup=F.lit("Ran 3 tests"))
    return logs.unittest_results(_runs(spark, sf_dir, line), "run").select("run", "target_name", "status")


@query(f"""WITH {_D} SELECT part, 'd' || doc_id || '.py' AS file_path, doc_id + 1 AS start_line, CASE WHEN lang = 'fr' THEN 'syntax' ELSE 'E' || doc_id % 7 END AS target_name, 'FAIL' AS status, 'in ' || lang AS message
  FROM d WHERE source NOT IN ('src3', 'src4')
UNION ALL SELECT DISTINCT part, '.', 1, 'output', 'ERROR', 'malformed linter output' FROM d WHERE source IN ('src3', 'src4')""")
def q_lint_json(spark, sf_dir):
    """Documents written as linter JSON, parsed again; one source's output is cut, one lacks fields."""
    docs = _parts(spark, sf_dir, "lang")
    found = F.struct(
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".py")).alias("filename"), F.when(F.col("lang") != "fr", F.concat(F.lit("E"), (F.col("doc_id") % 7).cast("string"))).alias("code"),
        F.concat(F.lit("in "), "lang").alias("message"), F.struct((F.col("doc_id") + 1).alias("row"), F.lit(1).alias("column")).alias("location"),
    )
    texts = docs.groupBy("source", "part").agg(F.to_json(F.collect_list(found)).alias("json"))
    broken = F.when(F.col("source") == "src3", F.substring("json", 1, 30)).when(F.col("source") == "src4", '[{"message": 1}]').otherwise(F.col("json"))
    return records.lint_findings(texts.select("part", broken.alias("json")), "part", "json")


@query(f"""WITH {_D} SELECT DISTINCT part, 'f' || doc_id % 9 || '.py' AS file_path, TRUE AS well_formed FROM d WHERE source <> 'src5'
UNION ALL SELECT DISTINCT part, NULL, FALSE FROM d WHERE source = 'src5'""")
def q_formatter_json(spark, sf_dir):
    """Documents written as formatter JSON: the files it would change, each once."""
    docs = _parts(spark, sf_dir)
    found = F.struct(F.concat(F.lit("f"), (F.col("doc_id") % 9).cast("string"), F.lit(".py")).alias("filename"), F.lit("x").alias("message"))
    texts = docs.groupBy("source", "part").agg(F.to_json(F.collect_list(found)).alias("json"))
    return records.formatter_findings(texts.select("part", F.when(F.col("source") == "src5", "[{}]").otherwise(F.col("json")).alias("json")), "part", "json")


@query(f"""WITH {_E}, n AS (SELECT run, count(*) FILTER (event_type = 'click') AS n FROM e GROUP BY run)
SELECT run, CASE WHEN run % 5 = 0 OR run % 7 = 0 OR n = 0 THEN 0 ELSE n END AS n_files, run % 5 <> 0 AND run % 7 <> 0 AND n > 0 AS well_formed FROM n""")
def q_formatter_text(spark, sf_dir):
    """Clicks written as files to reformat with a closing count, which is wrong or missing in some runs."""
    runs = _events(spark, sf_dir).groupBy("run").agg(F.array_sort(F.collect_list(F.when(F.col("event_type") == "click", F.col("event_id")))).alias("ids"))
    n = F.size("ids") + F.when(F.col("run") % 5 == 0, 1).otherwise(0)
    summary = F.concat(n.cast("string"), F.when(n == 1, " file").otherwise(" files"), F.lit(" would be reformatted, 3 files already formatted"))
    files = F.transform("ids", lambda i: F.concat(F.lit("Would reformat: a "), i.cast("string"), F.lit(".py")))
    log = F.array_join(F.when(F.col("run") % 7 == 0, files).otherwise(F.concat(files, F.array(summary))), "\n")
    found = logs.formatter_runs(runs.select("run", F.when(log == "", "odd").otherwise(log).alias("log")), "run")
    return found.select("run", F.size("files").cast("long").alias("n_files"), "well_formed")


@query(f"""WITH {_E}, b AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY event_id) AS block FROM e WHERE event_type IN ('signup', 'view', 'click'))
SELECT run, CAST(block AS BIGINT) AS block, string_agg(CASE WHEN event_type = 'signup' THEN 'warning: w' || event_id ELSE '  more ' || event_id END, chr(10) ORDER BY event_id) AS message
FROM b WHERE block > 0 AND event_type <> 'click' GROUP BY run, block""")
def q_warning_blocks(spark, sf_dir):
    """Signups written as warnings, views as their indented continuations, clicks as other lines."""
    line = _of_type(signup=F.concat(F.lit("warning: w"), _id()), view=F.concat(F.lit("  more "), _id()), click=F.lit("plain"))
    return logs.warning_blocks(_runs(spark, sf_dir, line), "run")


@query(f"""WITH {_E}, l AS (SELECT *, row_number() OVER w AS line_no, max(CASE WHEN event_type IN ('signup', 'purchase') THEN 1 ELSE 0 END) OVER w AS seen FROM e WINDOW w AS (PARTITION BY run ORDER BY event_id))
SELECT run, line_no, CASE WHEN event_type IN ('signup', 'purchase') THEN 'diagnostic' WHEN event_type = 'click' OR (event_type = 'view' AND seen = 1) THEN 'context' ELSE 'malformed' END AS part,
  CASE WHEN event_type IN ('signup', 'purchase') THEN event_id + 1 END AS start_line,
  CASE event_type WHEN 'signup' THEN 'fatal error: bad ' || event_id WHEN 'purchase' THEN 'warning: w' ELSE ': ' END AS message, CASE WHEN event_type = 'signup' THEN 'FAIL' ELSE 'WARN' END AS status FROM l""")
def q_diagnostics(spark, sf_dir):
    """Events written as compiler output: diagnostics, frames, excerpts that count after a diagnostic, and odd lines."""
    at = (F.col("event_id") + 1).cast("string")
    line = _of_type(
        signup=F.concat(F.lit("src/f.c:"), at, F.lit(":3: fatal error: bad "), _id()), purchase=F.concat(F.lit("f.c:"), at, F.lit(": warning: w")),
        view=F.lit("   | ^~~"), click=F.lit("In file included from x.h:3:"), error=F.lit("strange"),
    )
    return logs.diagnostics(_runs(spark, sf_dir, line), "run").select("run", F.col("line_no"), "part", "start_line", "message", "status")


@query(f"""WITH {_E}, n AS (SELECT run, count(*) FILTER (event_type = 'signup') AS errors, count(*) FILTER (event_type = 'view') AS notes FROM e GROUP BY run)
SELECT run, CASE WHEN run % 10 = 9 THEN 0 ELSE errors END AS n_errors, CASE WHEN run % 10 = 9 THEN 0 ELSE notes END AS n_notes, run % 10 = 9 AS success, run % 10 = 9 OR (run % 4 <> 1 AND errors > 0) AS well_formed FROM n""")
def q_type_check(spark, sf_dir):
    """Events written as type-checker output; some runs succeed, some hold odd lines, some end in a summary."""
    at = (F.col("event_id") + 1).cast("string")
    line = _of_type(signup=F.concat(F.lit("a.py:"), at, F.lit(": error: e")), view=F.concat(F.lit("a.py:"), at, F.lit(": note: n")))
    runs = _runs(spark, sf_dir, line)
    log = F.when(F.col("run") % 10 == 9, "Success: no issues found in 3 source files").when(F.col("run") % 4 == 1, F.concat("log", F.lit("\ngarbage"))).when(F.col("run") % 2 == 0, F.concat("log", F.lit("\nFound 2 errors in 1 file (checked 2 source files)"))).otherwise(F.col("log"))
    return logs.type_check_runs(runs.withColumn("log", log), "run")


@query("""SELECT event_type, event_type IN ('error', 'click', 'purchase') AS hit, count(*) AS n FROM events GROUP BY ALL""")
def q_sanitizer_hits(spark, sf_dir):
    """Which logs hold a sanitizer's finding."""
    log = _of_type(error=F.lit("x\n==12== ERROR: AddressSanitizer: heap"), click=F.lit("a.c:1:2: runtime error: overflow"), purchase=F.lit("SUMMARY: LeakSanitizer: 3"), view=F.lit("no ERROR: of AddressSanitizer"), signup=F.lit("runtime error: x"))
    return _events(spark, sf_dir).select("event_type", logs.sanitizer_hit(log).alias("hit")).groupBy("event_type", "hit").agg(F.count("*").alias("n"))


@query(f"WITH {_E} SELECT run, 'dir/t' || event_id || '.py' AS file_path, event_id + 1 AS start_line FROM e WHERE event_type = 'error'")
def q_resource_warnings(spark, sf_dir):
    """Errors written as resource warnings, parsed again."""
    at = (F.col("event_id") + 1).cast("string")
    line = _of_type(error=F.concat(F.lit("dir/t"), _id(), F.lit(".py:"), at, F.lit(": ResourceWarning: unclosed")), view=F.concat(F.lit("v.py:"), at, F.lit(": Warning")), click=F.lit("t.py:0: ResourceWarning: x"))
    return logs.resource_warnings(_runs(spark, sf_dir, line), "run")


@query("""SELECT source, lang AS engine_name, CASE WHEN lang = 'en' THEN 'PASS' ELSE 'WARN' END AS status, CASE WHEN lang = 'es' THEN 'n' || count(*) ELSE '' END AS summary,
  CASE WHEN lang = 'es' THEN FALSE ELSE TRUE END AS required, CASE WHEN lang = 'es' THEN 'ESTIMATED' ELSE 'MEASURED' END AS evidence FROM documents WHERE lang IN ('en', 'es') GROUP BY source, lang""")
def q_saved_reports(spark, sf_dir):
    """Sources written as saved reports: rows without a name or a known status go, the rest get defaults."""
    counts = read(spark, sf_dir, "documents", "source", "lang").groupBy("source", "lang").agg(F.count("*").alias("n"))
    spanish = F.col("lang") == "es"
    row = F.struct(
        F.when(F.col("lang") != "de", F.col("lang")).alias("engine_name"), F.when(F.col("lang") == "fr", "ODD").when(F.col("lang") == "en", "PASS").otherwise("WARN").alias("status"),
        F.when(spanish, F.concat(F.lit("n"), F.col("n").cast("string"))).alias("summary"), F.when(spanish, False).alias("required"), F.when(spanish, "ESTIMATED").alias("evidence"),
    )
    texts = counts.groupBy("source").agg(F.to_json(F.struct(F.lit("v2").alias("schema"), F.collect_list(row).alias("results"))).alias("json"))
    return records.saved_reports(texts, "source", "json").select("source", "engine_name", "status", "summary", "required", "evidence")


@query("SELECT event_id, CASE WHEN event_type IN ('signup', 'click') THEN event_id + 1 WHEN event_type = 'view' THEN event_id END AS number FROM events")
def q_change_numbers(spark, sf_dir):
    """The change that an event payload is about: the request's number, else the issue's."""
    payload = _of_type(
        signup=F.format_string('{"pull_request": {"number": %d}}', F.col("event_id") + 1), view=F.format_string('{"issue": {"number": %d}}', "event_id"),
        click=F.format_string('{"issue": {"number": 3}, "pull_request": {"number": %d}}', F.col("event_id") + 1), error=F.lit("{}"), purchase=F.lit("no json"),
    )
    return _events(spark, sf_dir).select("event_id", records.change_number(payload).alias("number"))


@query(f"""WITH {_E} SELECT run, CASE event_type WHEN 'view' THEN 'K' || event_id WHEN 'signup' THEN 'S' END AS name, CASE event_type WHEN 'view' THEN 'a=b ' || event_id ELSE event_id || '' END AS value FROM e WHERE event_type IN ('view', 'signup')""")
def q_key_values(spark, sf_dir):
    """Events written as settings of a system file, with quotes, comments and other lines."""
    line = _of_type(view=F.concat(F.lit("K"), _id(), F.lit('="a=b '), _id(), F.lit('"')), signup=F.concat(F.lit("S ='"), _id(), F.lit("'")), click=F.lit("#C=1"), error=F.lit("no value"))
    return records.key_values(_runs(spark, sf_dir, line), "run", "log")


@query("""WITH f AS (SELECT c_custkey % 30 AS host, 't' || c_custkey % 7 AS name, bool_or(c_acctbal > 5000) AS available FROM customer GROUP BY ALL), o AS (SELECT o_custkey % 30 AS host, 't' || o_custkey % 9 AS name, bool_and(o_orderstatus = 'F') AS available FROM orders WHERE o_custkey % 30 < 10 GROUP BY ALL)
SELECT coalesce(o.host, f.host) AS host, coalesce(o.name, f.name) AS name, coalesce(o.available, f.available) AS available, coalesce(o.name, f.name) IN ('t1', 't8') AS required FROM f FULL JOIN o ON f.host = o.host AND f.name = o.name""")
def q_capabilities(spark, sf_dir):
    """Tools of hosts: overrides win over what was found, and required ones are marked."""
    tool = lambda key, n: F.concat(F.lit("t"), (F.col(key) % n).cast("string")).alias("name")
    found = read(spark, sf_dir, "customer", "c_custkey", "c_acctbal").groupBy((F.col("c_custkey") % 30).alias("host"), tool("c_custkey", 7)).agg(F.bool_or(F.col("c_acctbal") > 5000).alias("available"))
    over = read(spark, sf_dir, "orders", "o_custkey", "o_orderstatus").where("o_custkey % 30 < 10").groupBy((F.col("o_custkey") % 30).alias("host"), tool("o_custkey", 9)).agg(F.bool_and(F.col("o_orderstatus") == "F").alias("available"))
    return records.capabilities(found, over, "host", ("t1", "t8"))


@query("""SELECT event_type, count(*) FILTER (event_type IN ('signup', 'view', 'click')) AS n_results, count(*) FILTER (event_type IN ('signup', 'purchase')) AS n_executed, count(*) FILTER (event_type = 'error' AND event_id % 2 = 1) AS n_unavailable FROM events GROUP BY event_type""")
def q_execution_evidence(spark, sf_dir):
    """What the logs of test runs prove: a result, that a test ran, that the runner is not there."""
    log = _of_type(signup=F.lit("== 3 passed in 1s"), view=F.lit("t.py::a  FAILED [1%]"), click=F.lit("0 passed"), purchase=F.lit("Ran 2 tests in 1s"), error=F.lit("/usr/bin/python3.11: No module named 'pytest'\n"))
    code = (F.col("event_id") % 2).cast("int")
    rows = _events(spark, sf_dir).select("event_type", logs.has_results(log).alias("r"), logs.executed(log).alias("x"), logs.module_unavailable(log, code, F.lit(False), F.lit(False), "pytest").alias("u"))
    return rows.groupBy("event_type").agg(F.count_if("r").alias("n_results"), F.count_if("x").alias("n_executed"), F.count_if("u").alias("n_unavailable"))


_FLAGS = "f AS (SELECT event_id, event_type = 'error' AS t, event_id % 5 = 0 AS c, CASE WHEN event_id % 7 = 6 THEN NULL ELSE event_id % 7 - 1 END AS r, event_type <> 'view' AS w, event_id % 3 AS n FROM events)"


def _flags(spark, sf_dir):
    e = F.col("event_id")
    code = F.when(e % 7 != 6, e % 7 - 1)
    return _events(spark, sf_dir).select("event_id", (F.col("event_type") == "error").alias("t"), (e % 5 == 0).alias("c"), code.alias("r"), (F.col("event_type") != "view").alias("w"), (e % 3).alias("n"))


@query(f"""WITH {_FLAGS} SELECT event_id, CASE WHEN t OR c OR r IS NULL OR r NOT IN (0, 1) THEN 'ERROR' WHEN r = 1 AND (NOT w OR n = 0) THEN 'ERROR' WHEN r = 1 THEN 'WARN' WHEN n > 0 THEN 'ERROR' ELSE 'PASS' END AS verdict FROM f""")
def q_formatter_verdict(spark, sf_dir):
    """What runs of a formatter come to, by how they ended and what they printed."""
    return _flags(spark, sf_dir).select("event_id", policy.formatter_verdict(*[F.col(c) for c in "tcrwn"]).alias("verdict"))


@query(f"WITH {_FLAGS} SELECT event_id, t OR c OR r IS NULL OR r < 0 AS strict, t OR c OR r IS NULL AS lenient FROM f")
def q_incomplete_runs(spark, sf_dir):
    """Runs whose outcome says nothing, with and without those that a signal ended."""
    t, c, r = (F.col(x) for x in "tcr")
    return _flags(spark, sf_dir).select("event_id", logs.incomplete(t, c, r).alias("strict"), logs.incomplete(t, c, r, True).alias("lenient"))


@query(f"""WITH {_FLAGS} SELECT event_id AS name, CASE WHEN n = 2 THEN 'e' || event_id WHEN t THEN 'timed out' WHEN c THEN 'output cut off' WHEN r IS NULL THEN 'did not start' WHEN r < 0 THEN 'ended by signal ' || (-r) END AS problem FROM f""")
def q_evidence_rows(spark, sf_dir):
    """One row for each attempt to run a tool, with what went wrong."""
    runs = _flags(spark, sf_dir).select(F.col("event_id").alias("name"), F.col("r").alias("returncode"), F.col("t").alias("timed_out"), F.col("c").alias("truncated"), F.when(F.col("n") == 2, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error"))
    return policy.evidence_rows(runs).select("name", "problem")


@query(f"""WITH {_E}, o AS (SELECT run, event_type, min(event_id) AS first_at FROM e GROUP BY run, event_type) SELECT run, string_agg(event_type, ';' ORDER BY first_at) AS messages FROM o GROUP BY run""")
def q_first_messages(spark, sf_dir):
    """Each run's distinct messages in the order in which they first occur."""
    found = logs.first_occurrences(_events(spark, sf_dir), "run", "event_type", "event_id")
    return found.select("run", F.array_join("values", ";").alias("messages"))


@query("SELECT CAST(sum(len(regexp_extract_all(html, '<p[ >]'))) AS BIGINT) AS n, sum(len(regexp_extract_all(html, '<p[ >]'))) = 1 AS once FROM pages")
def q_pattern_count(spark, sf_dir):
    """How often a pattern stands in all pages, and whether exactly once."""
    return logs.pattern_count(read(spark, sf_dir, "pages", "html"), "html", "<p[ >]")


@query(f"WITH {_E}, p AS (SELECT run, count(*) FILTER (event_type = 'view') AS passed, count(*) AS total FROM e GROUP BY run) SELECT CAST(sum(passed) AS BIGINT) AS passed, CAST(sum(total) AS BIGINT) AS total, bool_or(passed < total) AS has_failure FROM p")
def q_merged_totals(spark, sf_dir):
    """Test totals merged over runs."""
    parts = _events(spark, sf_dir).groupBy("run").agg(F.count_if(F.col("event_type") == "view").alias("passed"), F.count("*").alias("total"))
    return logs.merged_totals(parts.withColumn("has_failure", F.col("passed") < F.col("total")))
