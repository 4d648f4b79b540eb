"""Queries over source trees and paths made from the tables."""

from __future__ import annotations

import functools
import zlib

from pyspark.sql import functions as F

from sieveline.functions import text as T
from sieveline.operators import lines
from sieveline.operators.storage import numbered, shared_folder
from sieveline.plans.registry import query, read
from sieveline.sources import trees


@query("""SELECT source, CAST(sum(1 + length(t) - length(replace(t, chr(10), ''))) AS BIGINT) AS n_lines, CAST(sum(1 + strlen(t)) AS BIGINT) AS n_bytes, TRUE AS valid FROM (SELECT source, coalesce(text, '') AS t FROM documents) GROUP BY source""")
def q_source_scan(spark, sf_dir):
    """Documents written as text files by source, scanned again by suffix, with hidden directories left out."""
    root = f"{shared_folder(spark)}/scan-{zlib.crc32(sf_dir.encode()):x}"
    docs = read(spark, sf_dir, "documents", "source", "text")
    docs.write.mode("overwrite").partitionBy("source").text(f"{root}/src")
    docs.select("text").write.mode("overwrite").text(f"{root}/build")
    found = trees.in_roots(trees.source_files(spark, root, (".txt",)), ("src",))
    content = F.col("content")
    return found.groupBy(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source")).agg(F.sum((F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))).cast("long")).alias("n_lines"), F.sum(F.octet_length(content).cast("long")).alias("n_bytes"), F.bool_and("valid").alias("valid"))


_PARTS = """p AS (SELECT event_id, user_id, CASE event_id % 9 WHEN 0 THEN 'src' WHEN 1 THEN 'lib' WHEN 2 THEN 'docs' WHEN 3 THEN 'build' WHEN 4 THEN 'tests' WHEN 5 THEN 'v1.2' WHEN 6 THEN 'app/.git' WHEN 7 THEN 'srcs' ELSE 'src/v0.x' END
  || '/' || CASE WHEN event_id % 4 = 0 THEN 'test_' ELSE 'm' END || user_id || CASE WHEN event_id % 7 = 0 THEN '_test' ELSE '' END || CASE event_type WHEN 'view' THEN '.py' WHEN 'click' THEN '.cpp' WHEN 'signup' THEN '.cc' WHEN 'error' THEN '.h' ELSE '.txt' END AS path FROM events)"""


def _paths(spark, sf_dir):
    events = read(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    pick = lambda key, names, rest: functools.reduce(lambda out, kv: F.when(key == kv[0], kv[1]).otherwise(out), names.items(), F.lit(rest))
    folder = pick(F.col("event_id") % 9, dict(enumerate(("src", "lib", "docs", "build", "tests", "v1.2", "app/.git", "srcs"))), "src/v0.x")
    suffix = pick(F.col("event_type"), {"view": ".py", "click": ".cpp", "signup": ".cc", "error": ".h"}, ".txt")
    name = F.concat(F.when(F.col("event_id") % 4 == 0, "test_").otherwise("m"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 7 == 0, "_test").otherwise(""), suffix)
    return events.select("event_id", "user_id", F.concat(folder, F.lit("/"), name).alias("path"))


@query(f"""WITH {_PARTS} SELECT event_id, event_id % 9 IN (3, 5, 6, 8) AS ignored, event_id % 9 IN (0, 8) AS gated FROM p""")
def q_ignored_paths(spark, sf_dir):
    """Paths that no scan reports, and paths that size limits hold for."""
    return _paths(spark, sf_dir).select("event_id", T.ignored_path(F.col("path")).alias("ignored"), lines.gated(F.col("path"), ("src", "lib"), ("lib",)).alias("gated"))


@query(f"""WITH {_PARTS} SELECT event_id, CASE event_id % 9 WHEN 2 THEN 1 WHEN 0 THEN 2 ELSE 2 END AS root_rank FROM p WHERE event_id % 9 IN (0, 2, 8)""")
def q_source_roots(spark, sf_dir):
    """Files below configured roots, by the first root that has them."""
    found = trees.in_roots(_paths(spark, sf_dir), trees.source_roots(("docs", "src", "src/v0.x", "none/../other")))
    return found.select("event_id", F.col("root_rank").cast("int").alias("root_rank"))


@query(f"""WITH {_PARTS}, d AS (SELECT DISTINCT path FROM p WHERE regexp_matches(path, '\\.(cpp|cc|cxx|c)$')) SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS place FROM d""")
def q_sorted_sources(spark, sf_dir):
    """C-like sources in order of their parts; headers are none."""
    suffix = lines.suffix_of(F.col("path"))
    found = _paths(spark, sf_dir).where(suffix.isin(*trees.NATIVE_SUFFIXES)).select("path").distinct()
    return numbered(trees.by_path(found), [F.split("path", "/")], "place").select("path", "place")


@query(f"""WITH {_PARTS} SELECT event_id, regexp_matches(path, '(^|/)(test_[^/]*\\.py|[^/]*_test\\.py)$') OR (starts_with(path, 'tests/') AND ends_with(path, '.cpp')) AS is_test FROM p""")
def q_test_files(spark, sf_dir):
    """Files that test runners pick up."""
    return _paths(spark, sf_dir).select("event_id", trees.is_test_path(F.col("path")).alias("is_test"))


@query("""WITH f AS (SELECT user_id, bool_or(event_type = 'view' AND event_id % 3 = 0) AS py, bool_or(event_type = 'click' AND event_id % 3 = 0) AS cpp, bool_or(event_type = 'error' AND event_id % 50 = 0) AS stated, bool_or(event_type = 'purchase' AND event_id % 40 = 0) AS make FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN stated THEN 'cpp' WHEN py AND (cpp OR make) THEN 'hybrid' WHEN cpp OR make THEN 'cpp' ELSE 'python' END AS project_type FROM f""")
def q_project_types(spark, sf_dir):
    """Types of projects: as a configuration states, else by the files that are there."""
    events = read(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    third = F.col("event_id") % 3 == 0
    kind = F.col("event_type")
    path = F.when((kind == "view") & third, "src/a.py").when((kind == "click") & third, "lib/b.cpp").when((kind == "error") & (F.col("event_id") % 50 == 0), "dev.toml").when((kind == "purchase") & (F.col("event_id") % 40 == 0), "Makefile").when(kind == "view", "docs/a.py").otherwise("src/x.txt")
    content = F.when(path == "dev.toml", "[p]\ntype = 'cpp'\n").otherwise("type = 'python'")
    return trees.project_type(events.select("user_id", path.alias("path"), content.alias("content")), ["user_id"])


_SUFFIXES = (*lines.LANGUAGES, ".txt", "")
_MARKS = [("The ", "# "), ("And ", "// "), ("In ", "/* "), (" of ", " */ ")]


def _marked(sql: str) -> str:
    for old, new in _MARKS:
        sql = f"replace({sql}, '{old}', '{new}')"
    return sql


_LANGUAGE = " ".join(f"WHEN '{suffix}' THEN '{name}'" for suffix, name in lines.LANGUAGES.items())
_SUFFIX_SQL = " ".join(f"WHEN {k} THEN '{suffix}'" for k, suffix in enumerate(_SUFFIXES))
_HASH, _SLASH = (", ".join(f"'{s}'" for s in group) for group in (lines.HASH_SUFFIXES, lines.SLASH_SUFFIXES))


@query(rf"""WITH f AS (SELECT doc_id, CASE doc_id % {len(_SUFFIXES)} {_SUFFIX_SQL} END AS suffix, {_marked("coalesce(text, '')")} AS content FROM documents), known AS (
  SELECT *, CASE suffix {_LANGUAGE} END AS lang, string_split_regex(content, '\r\n|\n|\r') AS parts FROM f WHERE suffix NOT IN ('.txt', '')
), l AS (SELECT doc_id, suffix, i, trim(parts[i], '{T.WHITE_SPACE}') AS bare FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM known) WHERE NOT (i = len(parts) AND parts[i] = '')
), m AS (SELECT *, suffix IN ({_SLASH}) AND starts_with(bare, '/*') AS opens, suffix IN ({_SLASH}) AND contains(bare, '*/') AS closes FROM l
), s AS (SELECT *, coalesce(last_value(CASE WHEN closes THEN 0 WHEN opens THEN 1 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM m
), c AS (SELECT doc_id, CASE WHEN bare = '' THEN 'blank' WHEN suffix IN ({_SLASH}) AND (inside = 1 OR opens OR starts_with(bare, '//')) OR suffix IN ({_HASH}) AND starts_with(bare, '#') THEN 'comment' ELSE 'code' END AS kind FROM s)
SELECT 'src/f' || k.doc_id || k.suffix AS path, lang, count(kind) FILTER (kind = 'code') AS code, count(kind) FILTER (kind = 'comment') AS comment, count(kind) FILTER (kind = 'blank') AS blank, count(kind) AS total
FROM known k LEFT JOIN c ON c.doc_id = k.doc_id GROUP BY k.doc_id, k.suffix, lang""")
def q_language_lines(spark, sf_dir):
    """Documents as sources of fourteen suffixes and seven languages, their lines by kind."""
    suffix = F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.col("doc_id") % len(_SUFFIXES) + 1).cast("int"))
    path = F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), suffix)
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return lines.file_statistics(docs.select(path.alias("path"), T.replaced(F.coalesce("text", F.lit("")), _MARKS).alias("content")))
