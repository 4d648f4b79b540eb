"""Queries over evidence, scores, ranges, records, logs, structure and symbols."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sieveline.functions import policy
from sieveline.operators import checks as C
from sieveline.operators import coverage, intervals, structure, symbols
from sieveline.plans.registry import query, read
from sieveline.sources import logs


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'ESTIMATED' WHEN l.toxic = 1 THEN 'NOT_RUN' ELSE 'MEASURED' END AS evidence
  FROM documents d LEFT JOIN labels l USING (doc_id)""")
def q_evidence(spark, sf_dir):
    """Evidence of each document: measured where labelled, not run where the label says toxic."""
    joined = read(spark, sf_dir, "documents", "doc_id").join(read(spark, sf_dir, "labels", "doc_id", "toxic"), "doc_id", "left")
    none = F.lit(False)
    return joined.select("doc_id", policy.evidence(F.coalesce(F.col("toxic") == 1, none), none, F.col("toxic").isNull()).alias("evidence"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_unlabelled(spark, sf_dir):
    """Documents without a label."""
    return read(spark, sf_dir, "documents", "doc_id").join(read(spark, sf_dir, "labels", "doc_id"), "doc_id", "left_anti")


_SOURCES = """src AS (
  SELECT source, count(*) AS stmts, count(l.doc_id) AS covered, count(*) FILTER (l.quality = 1) AS passed, count(*) FILTER (l.toxic = 1) AS toxic
  FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source)"""


def _sources(spark, sf_dir):
    joined = read(spark, sf_dir, "documents", "doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("source").agg(F.count("*").alias("stmts"), F.count("quality").alias("covered"), F.count_if(F.col("quality") == 1).alias("passed"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query(f"WITH {_SOURCES} SELECT source, passed, covered AS total, passed < covered AS has_failure FROM src")
def q_pass_rate(spark, sf_dir):
    """Good labels of all labels by source."""
    return _sources(spark, sf_dir).select("source", "passed", F.col("covered").alias("total"), (F.col("passed") < F.col("covered")).alias("has_failure"))


@query(f"""WITH {_SOURCES} SELECT source, greatest(0.0, least(5.0, round_even(least(80.0, coalesce(100.0 * covered / nullif(stmts, 0), 45.0)) / 80.0
  * ((100.0 - 100.0 * toxic / greatest(covered, 1)) / 100.0) * (CASE WHEN covered > 0 THEN passed / covered ELSE 0.0 END) * 5.0, 2))) AS score FROM src""")
def q_score(spark, sf_dir):
    """Effectiveness of each source: labels as line coverage, non-toxic as function coverage, good as passed."""
    line = F.lit(100.0) * F.col("covered") / F.col("stmts")
    clean = F.lit(100.0) - F.lit(100.0) * F.col("toxic") / F.greatest("covered", F.lit(1))
    score = policy.effectiveness(line, F.lit(None).cast("double"), F.lit(45.0), clean, F.col("passed"), F.col("covered"))
    return _sources(spark, sf_dir).select("source", score.alias("score"))


@query(f"""WITH {_SOURCES} SELECT source, stmts, covered, stmts - covered AS miss, CASE WHEN stmts > 0 THEN round_even(100.0 * covered / stmts, 1) END AS cover
  FROM src ORDER BY cover, source""")
def q_ratio_rows(spark, sf_dir):
    """Labelled share of each source, least first."""
    out = _sources(spark, sf_dir).select("source", "stmts", "covered", (F.col("stmts") - F.col("covered")).alias("miss"), policy.percent(F.col("covered"), F.col("stmts")).alias("cover"))
    return out.orderBy("cover", "source")


@query(f"WITH {_SOURCES} SELECT source, stmts, covered FROM src WHERE stmts >= 5 AND 100.0 * covered / stmts < 40.0")
def q_low_coverage(spark, sf_dir):
    """Sources of some size with few labels."""
    shares = _sources(spark, sf_dir).withColumn("cover", 100.0 * F.col("covered") / F.col("stmts"))
    return coverage.low_rows(shares, 5, 40.0).select("source", "stmts", "covered")


@query("""SELECT conv_id, count(*) FILTER (role = 'assistant') AS passed, count(*) FILTER (role <> 'assistant') AS failed, count(*) AS total,
  string_agg('t' || turn || ':' || CASE WHEN role = 'assistant' THEN 'PASS' ELSE 'FAIL' END, ',' ORDER BY turn, role) AS tests FROM conversations WHERE turn % 5 <> 4 GROUP BY conv_id""")
def q_suite_group(spark, sf_dir):
    """Turns of each conversation as a suite: counts, and the members in order; every fifth is a coverage row."""
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    name = F.concat(F.when(F.col("turn") % 5 == 4, "Coverage:t").otherwise("t"), F.col("turn").cast("string"))
    targets = turns.select("conv_id", F.struct("turn", "role").alias("at"), name.alias("target_name"), F.when(F.col("role") == "assistant", "PASS").otherwise("FAIL").alias("status"))
    found = coverage.suites(targets, "conv_id", "at")
    return found.withColumn("tests", F.array_join(F.transform("tests", lambda s: F.concat_ws(":", s["name"], s["status"])), ","))


_RANGES = """ranges AS (SELECT user_id, min(event_id) AS lo, min(event_id) + 2000 AS hi FROM events WHERE event_type = 'signup' GROUP BY user_id)"""


@query(f"""WITH {_RANGES} SELECT r.user_id, r.lo, r.hi, count(e.event_id) > 0 AS covered, count(e.event_id) AS n_points
  FROM ranges r LEFT JOIN events e ON e.user_id = r.user_id AND e.event_type = 'purchase' AND e.event_id BETWEEN r.lo AND r.hi GROUP BY ALL""")
def q_range_cover(spark, sf_dir):
    """Which users' first spans hold a purchase, and how many."""
    events = read(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    ranges = events.where("event_type = 'signup'").groupBy("user_id").agg(F.min("event_id").alias("lo")).withColumn("hi", F.col("lo") + 2000)
    return intervals.covered_by_points(ranges, events.where("event_type = 'purchase'"), "user_id", "lo", "hi", "event_id").select("user_id", "lo", "hi", "covered", "n_points")


@query("""WITH e AS (SELECT DISTINCT doc_id FROM documents), f AS (SELECT DISTINCT doc_id FROM labels)
SELECT (SELECT count(*) FROM e) AS n_expected, (SELECT count(*) FROM f) AS n_found, (SELECT count(*) FROM e WHERE doc_id NOT IN (SELECT doc_id FROM f)) AS n_missing,
  (SELECT count(*) FROM f WHERE doc_id NOT IN (SELECT doc_id FROM e)) AS n_extra,
  (SELECT count(*) FROM e WHERE doc_id NOT IN (SELECT doc_id FROM f)) = 0 AND (SELECT count(*) FROM f WHERE doc_id NOT IN (SELECT doc_id FROM e)) = 0 AS same""")
def q_set_equal(spark, sf_dir):
    """Whether exactly the documents are labelled."""
    return intervals.set_comparison(read(spark, sf_dir, "documents", "doc_id"), read(spark, sf_dir, "labels", "doc_id"), "doc_id")


@query("""SELECT event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS sum_k, count(*) FILTER (k IS NULL OR k < 0) AS n_invalid
  FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type""")
def q_json_fields(spark, sf_dir):
    """A number in a JSON column, validated and summed."""
    k = F.from_json("props", "k long")["k"]
    rows = read(spark, sf_dir, "events", "event_type", "props").select("event_type", k.alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("sum_k"), F.count_if(F.col("k").isNull() | (F.col("k") < 0)).alias("n_invalid"))


@query("""SELECT 'f' || (user_id % 50) || '.c' AS file_path, CASE WHEN event_type = 'error' THEN 'error' ELSE 'note' END AS kind, event_type AS message,
  min(event_id) AS first_at, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def q_log_parse(spark, sf_dir):
    """Events written as diagnostics, parsed again, repeats collapsed."""
    events = read(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    kind = F.when(F.col("event_type") == "error", "error").otherwise("note")
    line = F.format_string("f%d.c:%d:%d: %s: %s", F.col("user_id") % 50, F.col("event_id") + 1, F.lit(1), kind, F.col("event_type"))
    found = logs.diagnostics(events.select("event_id", line.alias("log")), "event_id").where("part = 'diagnostic'")
    parsed = found.select("file_path", (F.col("start_line") - 1).alias("at"), "kind", F.substring_index("message", ": ", -1).alias("message"))
    return logs.collapsed_repeats(parsed, ["file_path", "kind", "message"], "at")


@query("""SELECT user_id, string_agg(event_type, '; ' ORDER BY event_id) AS summary FROM (
  SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 3 GROUP BY user_id""")
def q_first_n_join(spark, sf_dir):
    """The first three entries of each user, joined."""
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    top = read(spark, sf_dir, "events", "event_id", "user_id", "event_type").withColumn("k", first).where("k <= 3")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda s: s["event_type"])
    return top.groupBy("user_id").agg(F.array_join(listed, "; ").alias("summary"))


_TAGS = f"""tags AS (
  SELECT page_id, i AS pos, t[i] AS tag, CASE WHEN starts_with(t[i], '</') THEN -1 ELSE 1 END AS step FROM (
    SELECT page_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(lower(html), '</?(?:{"|".join(structure.TAGS)})[ >]') AS t FROM pages)))"""


@query(f"""WITH {_TAGS}, depths AS (SELECT page_id, sum(step) OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM tags)
SELECT page_id, CAST(max(depth) AS BIGINT) AS max_depth, count(*) AS n_tags FROM depths GROUP BY page_id""")
def q_tag_depth(spark, sf_dir):
    """Greatest nesting of each page."""
    stream = structure.tags(read(spark, sf_dir, "pages", "page_id", "html"), "page_id", "html")
    return structure.running_depth(stream, "page_id").groupBy("page_id").agg(F.max("depth").alias("max_depth"), F.count("*").alias("n_tags"))


@query(f"""WITH {_TAGS}, named AS (SELECT page_id, pos, step, regexp_replace(tag, '[<>/ ]', '', 'g') AS tag FROM tags
), seg AS (SELECT *, sum(CASE WHEN step = 1 AND tag IN ('p', 'li') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS segment FROM named)
SELECT page_id, CAST(segment AS BIGINT) AS segment, count(*) AS n_tags, min(pos) AS first_pos FROM seg WHERE segment > 0 GROUP BY ALL""")
def q_segments(spark, sf_dir):
    """Tags of each page cut at paragraphs and list items."""
    stream = structure.tags(read(spark, sf_dir, "pages", "page_id", "html"), "page_id", "html")
    cut = structure.segments(stream, "page_id", (F.col("step") == 1) & F.col("tag").isin("p", "li"))
    return cut.where("segment > 0").groupBy("page_id", "segment").agg(F.count("*").alias("n_tags"), F.min("pos").alias("first_pos"))


@query(r"""SELECT page_id, CAST(len(c) AS BIGINT) AS n_comments, CAST(list_sum([len(x) FOR x IN c]) AS BIGINT) AS comment_chars, CAST(len(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) AS BIGINT) AS rest
  FROM (SELECT page_id, html, regexp_extract_all(html, '(?s)<!--.*?-->') AS c FROM pages)""")
def q_comment_mask(spark, sf_dir):
    """Comments of each page that span lines: number, size, and what is left."""
    found = F.regexp_extract_all("html", F.lit(r"(?s)(<!--.*?-->)"), F.lit(1))
    chars = F.aggregate(F.transform(found, F.length), F.lit(0), lambda a, x: a + x)
    return read(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.size(found).cast("long").alias("n_comments"), F.when(F.size(found) > 0, chars).cast("long").alias("comment_chars"), F.length(F.regexp_replace("html", r"(?s)<!--.*?-->", "")).cast("long").alias("rest"))


@query("""SELECT p.event_id, p.user_id, (SELECT max(s.event_id) FROM events s WHERE s.user_id = p.user_id AND s.event_type = 'signup' AND s.ts < p.ts) AS as_of
  FROM events p WHERE p.event_type = 'purchase'""")
def q_asof_binding(spark, sf_dir):
    """The latest signup strictly before each purchase of a user."""
    events = read(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    signups = events.where("event_type = 'signup'").withColumn("value", F.col("event_id"))
    probes = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return intervals.as_of(probes, signups, "user_id", "ts", "value", "event_id").select("event_id", "user_id", "as_of")


@query("""WITH e AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS era FROM events)
SELECT user_id, CAST(era AS BIGINT) AS era, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds, count(*) AS n_events FROM e GROUP BY user_id, era""")
def q_reset_kinds(spark, sf_dir):
    """Kinds of events since each signup."""
    events = read(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    return intervals.kinds_since(events, "user_id", ["event_id"], F.col("event_type") == "signup", "event_type").withColumn("kinds", F.array_join("kinds", ","))


_PATHS = r"""paths AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)"""


def _paths(spark, sf_dir):
    bare = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    return read(spark, sf_dir, "pages", "page_id", "url").select("page_id", bare.alias("path"))


@query(f"""WITH {_PATHS}, prefixes AS (SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS prefix FROM paths)
SELECT prefix, count(*) AS n FROM paths JOIN prefixes ON path = prefix OR starts_with(path, prefix || '/') GROUP BY prefix""")
def q_prefix_join(spark, sf_dir):
    """Pages below each host and first path part."""
    paths = _paths(spark, sf_dir)
    prefixes = paths.select(F.concat_ws("/", F.coalesce(F.get(F.split("path", "/"), F.lit(0)), F.lit("")), F.coalesce(F.get(F.split("path", "/"), F.lit(1)), F.lit(""))).alias("prefix")).distinct()
    return intervals.by_prefix(paths, prefixes, "path", "prefix").groupBy("prefix").agg(F.count("*").alias("n"))


@query(f"""WITH {_PATHS}, p AS (SELECT page_id, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir FROM paths)
SELECT dir, count(*) AS n_files, CAST(len(string_split(dir, '/')) AS BIGINT) AS depth, CAST(sum(len(html)) AS BIGINT) AS chars FROM p JOIN pages USING (page_id) GROUP BY dir""")
def q_dir_rollup(spark, sf_dir):
    """Pages and characters of each directory, direct children only."""
    bare = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    rows = read(spark, sf_dir, "pages", "url", "html").select(bare.alias("path"), F.length("html").cast("long").alias("chars"))
    return C.directory_tree(rows, "path", ["chars"]).select("dir", "n_files", F.col("depth").cast("long").alias("depth"), "chars")


@query(f"WITH {_PATHS} SELECT page_id, path FROM paths WHERE contains(lower(path), '/de/') OR page_id % 10 = 0")
def q_tree_search(spark, sf_dir):
    """Case-insensitive search in paths; every tenth row is a folder, which always shows."""
    return C.tree_search(_paths(spark, sf_dir), " /De/ ", F.col("path"), F.col("page_id") % 10 == 0)


@query("""SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def q_contains_join(spark, sf_dir):
    """Benchmark items whose whole text, of any length, stands in a document."""
    items = read(spark, sf_dir, "benchmark", "item_id", F.col("text").alias("item"))
    return intervals.containing(read(spark, sf_dir, "documents", "doc_id", "text"), items, "doc_id", "text", "item_id", "item")


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY CAST(substr(source, 4) AS BIGINT), doc_id) AS k FROM documents) WHERE k = 1""")
def q_first_wins(spark, sf_dir):
    """One document for each text: that of the first source."""
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "text")
    keyed = docs.select("doc_id", "source", F.substring("source", 4, 9).cast("long").alias("rank"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
    return intervals.first_by(keyed, ["digest"], ["rank", "doc_id"]).select("doc_id", "source")


@query("""WITH e AS (SELECT *, coalesce(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM events
), k AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e WHERE seen = 1)
SELECT user_id, event_id, event_type FROM k WHERE k = 1""")
def q_after_terminator(spark, sf_dir):
    """What follows each user's first error."""
    events = read(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    return structure.first_after_terminator(events, "user_id", F.col("event_type") == "error", "event_id").select("user_id", "event_id", "event_type")


@query("""WITH private AS (SELECT doc_id, source FROM documents WHERE lang <> 'en'), refs AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)
SELECT p.doc_id, p.source, CASE WHEN r.doc_id IS NULL THEN 'WARN' ELSE 'PASS' END AS status FROM private p LEFT JOIN refs r USING (doc_id)""")
def q_unreferenced(spark, sf_dir):
    """Definitions nothing refers to: non-English documents without a good label."""
    name = F.concat(F.lit("_d"), F.col("doc_id").cast("string")).alias("name")
    defs = read(spark, sf_dir, "documents", "doc_id", "source", "lang").where("lang <> 'en'").select(F.col("source").alias("file"), name, F.col("doc_id").alias("line"), F.lit(False).alias("decorated"))
    good = read(spark, sf_dir, "labels", "doc_id", "quality").where("quality = 1").select(name)
    refs = defs.select("file", "name").join(good, "name", "left_semi")
    none = defs.select("file", "name").limit(0)
    found = symbols.private_usage(defs, refs, none, none)
    return found.select(F.col("line").alias("doc_id"), F.col("file").alias("source"), "status")
