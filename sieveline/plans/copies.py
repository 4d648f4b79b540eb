"""Queries over repeated passages of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.operators import clones, intervals, repeats
from sieveline.operators.storage import stored
from sieveline.plans.corpus import _WINDOWS, _windows
from sieveline.plans.registry import query

_LONGEST = (
    _WINDOWS
    + """, met AS (
  SELECT x.doc_id AS a, y.doc_id AS b, x.pos AS a_pos, y.pos AS b_pos FROM windows x JOIN windows y USING (hash) WHERE (x.doc_id, x.pos) <> (y.doc_id, y.pos)
), islands AS (SELECT *, a_pos - row_number() OVER (PARTITION BY a, b, b_pos - a_pos ORDER BY a_pos) AS g FROM met
), reach AS (SELECT a, a_pos, max(a_pos) OVER (PARTITION BY a, b, b_pos - a_pos, g) - a_pos + 1 AS m FROM islands
), best AS (SELECT a AS doc_id, a_pos AS pos, max(m) AS m FROM reach GROUP BY ALL
), starts AS (SELECT s.doc_id, s.pos, s.m + 5 AS length FROM best s LEFT JOIN best p ON p.doc_id = s.doc_id AND p.pos = s.pos - 1 WHERE p.m IS NULL OR p.m - 1 < s.m
), blocks AS MATERIALIZED (SELECT s.doc_id, s.pos, s.length, string_agg(norm, chr(0) ORDER BY c.pos) AS block FROM starts s JOIN code c ON c.doc_id = s.doc_id AND c.pos >= s.pos AND c.pos < s.pos + s.length GROUP BY ALL)"""
)


@query(f"""WITH {_LONGEST}, ends AS (SELECT block, count(*) AS n_places, min((doc_id, pos)) AS f FROM blocks GROUP BY block)
SELECT doc_id, pos, length, n_places, f[1] AS first_doc, f[2] AS first_pos FROM blocks JOIN ends USING (block)""")
def q_longest_repeats(spark, sf_dir):
    """Longest repeated passages of documents, each with the places that share it."""
    found = repeats.longest_repeats(stored(_windows(spark, sf_dir)), "doc_id", clones.WINDOW)
    return found.select("doc_id", "pos", F.col("length").cast("long").alias("length"), "n_places", F.col("first_key").alias("first_doc"), "first_pos")


@query()
def q_clone_alignment(spark, sf_dir):
    """Passages that neighbouring documents share, one-to-one and in the same order, by line numbers."""
    found = stored(_windows(spark, sf_dir))
    blocks = repeats.aligned(repeats.anchors(found, "doc_id", clones.WINDOW))
    return repeats.with_lines(blocks, found, "doc_id", clones.WINDOW)


@query()
def q_clone_intervals(spark, sf_dir):
    """Ranked groups of the passages that alignments connect."""
    return clones.interval_groups(q_clone_alignment(spark, sf_dir))


@query(f"""WITH {_WINDOWS}, later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id, pos) AS k FROM windows) WHERE k > 1
), dup AS (SELECT DISTINCT doc_id, unnest(range(start_line, end_line + 1)) AS line_no FROM later
), runs AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM dup)
SELECT doc_id, min(line_no) AS start_line, max(line_no) AS end_line FROM runs GROUP BY doc_id, g""")
def q_duplicate_spans(spark, sf_dir):
    """Stretches of lines that repeat an earlier window, overlapping windows merged."""
    later = clones.later_windows(_windows(spark, sf_dir), "doc_id")
    return intervals.merged(later, "doc_id", "start_line", "end_line").select("doc_id", "start_line", "end_line")
