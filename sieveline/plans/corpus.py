"""Queries over documents as line corpora: statistics, thresholds, clones."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.functions import policy
from sieveline.functions import text as T
from sieveline.operators import clones, lines
from sieveline.operators.components import components
from sieveline.operators.storage import stored
from sieveline.plans.registry import query, read

COMMENTS = ("The ", "And ")
"""Line starts that count as comments in prose, which has no comment marks of its own."""
GATED = ("src0", "src1", "src2", "src3", "src4", "src5", "src6", "src7", "src8", "src9")
WARN_LINES, FAIL_LINES = 10, 30

_LINES = r"""
lines AS (
  SELECT doc_id, source, CAST(i AS BIGINT) AS line_no, parts[i] AS raw, regexp_replace(parts[i], '^\s+|\s+$', '', 'g') AS bare
  FROM (SELECT doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, source, string_split_regex(coalesce(text, ''), '\r\n|\n|\r') AS parts FROM documents))
  WHERE NOT (i = len(parts) AND parts[i] = '')
)"""
_COUNTS = (
    _LINES
    + """, stats AS (
  SELECT d.doc_id, d.source, count(l.doc_id) FILTER (l.bare <> '' AND NOT (starts_with(l.bare, 'The ') OR starts_with(l.bare, 'And '))) AS code,
         count(l.doc_id) FILTER (starts_with(l.bare, 'The ') OR starts_with(l.bare, 'And ')) AS comment,
         count(l.doc_id) FILTER (l.bare = '') AS blank, count(l.doc_id) AS total
  FROM documents d LEFT JOIN lines l ON l.doc_id = d.doc_id GROUP BY d.doc_id, d.source
)"""
)


def _counts(spark, sf_dir):
    return lines.kind_counts(read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", COMMENTS)


@query(f"WITH {_COUNTS} SELECT doc_id, code, comment, blank, total FROM stats")
def q_line_stats(spark, sf_dir):
    """Lines of each document by kind."""
    return _counts(spark, sf_dir)


@query(f"""WITH {_COUNTS} SELECT count(*) AS n_docs, CAST(sum(code) AS BIGINT) AS code, CAST(sum(comment) AS BIGINT) AS comment,
  CAST(sum(blank) AS BIGINT) AS blank, CAST(sum(total) AS BIGINT) AS total, round_even(100.0 * sum(code) / greatest(sum(total), 1), 1) AS code_pct FROM stats""")
def q_line_totals(spark, sf_dir):
    """Sums over all documents, and the share of code lines."""
    sums = _counts(spark, sf_dir).agg(F.count("*").alias("n_docs"), *[F.sum(c).alias(c) for c in ("code", "comment", "blank", "total")])
    return sums.withColumn("code_pct", F.bround(100.0 * F.col("code") / F.greatest("total", F.lit(1)), 1))


_GATE = ", ".join(f"'{s}'" for s in GATED)


@query(f"""WITH {_COUNTS} SELECT doc_id, code, CASE WHEN source IN ({_GATE}) AND code > {FAIL_LINES} THEN 'FAIL'
  WHEN source IN ({_GATE}) AND code > {WARN_LINES} THEN 'WARN' ELSE 'PASS' END AS status FROM stats""")
def q_line_threshold(spark, sf_dir):
    """Two thresholds on code lines, for some sources only."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    keyed = docs.withColumn("__key", F.struct("doc_id", "source"))
    counted = lines.kind_counts(keyed, "__key", COMMENTS).select("__key.doc_id", "__key.source", "code")
    return counted.select("doc_id", "code", policy.two_thresholds(F.col("code"), WARN_LINES, FAIL_LINES, F.col("source").isin(*GATED)).alias("status"))


@query(f"WITH {_COUNTS} SELECT doc_id, code FROM stats ORDER BY code DESC, doc_id LIMIT 5")
def q_top5_docs(spark, sf_dir):
    """The five documents with most code lines."""
    return _counts(spark, sf_dir).select("doc_id", "code").orderBy(F.desc("code"), "doc_id").limit(5)


@query(f"""WITH {_LINES}, marks AS (
  SELECT *, CASE WHEN contains(bare, '.') AND NOT (starts_with(bare, 'In ') AND NOT contains(bare, '.')) THEN 0 WHEN starts_with(bare, 'In ') THEN 1 END AS mark FROM lines
), state AS (
  SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM marks
) SELECT CASE WHEN bare = '' THEN 'blank' WHEN inside = 1 OR starts_with(bare, 'In ') OR starts_with(bare, 'The ') OR starts_with(bare, 'And ') THEN 'comment' ELSE 'code' END AS kind,
  count(*) AS n FROM state GROUP BY ALL""")
def q_block_comments(spark, sf_dir):
    """Line kinds with block comments that one line opens and a later one closes."""
    all_lines = lines.exploded(read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")
    return lines.classified(all_lines, "doc_id", COMMENTS, ("In ", ".")).groupBy("kind").agg(F.count("*").alias("n"))


_KEPT = ", ".join(f"'{w}'" for w in T.KEPT_WORDS)
_STRINGS = T.STRING_TOKEN.replace("'", "''")
_W = f"[{T.WORD_CHARACTERS}]"


def _name(sql: str) -> str:
    return f"CASE WHEN NOT regexp_matches({sql}, '^[A-Za-z_]') THEN {sql} WHEN {sql} IN ({_KEPT}) THEN {sql} ELSE 'ID' END"


_AFTER_NUMBER = r"regexp_replace(t, '^\p{Nd}+\.', '')"


@query(rf"""WITH lines AS (
  SELECT doc_id, CAST(i AS BIGINT) AS line_no, trim(parts[i], '{T.WHITE_SPACE}') AS bare
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\r\n|\n|\r') AS parts FROM documents))
), cut AS (
  SELECT doc_id, line_no, regexp_extract_all(bare, '{_STRINGS}|\p{{Nd}}+\.{_W}+|{_W}+|(?s:.)') AS tokens FROM lines WHERE bare <> ''
), normed AS (
  SELECT doc_id, line_no, translate(array_to_string([CASE WHEN length(t) > 1 AND (t[1] = '''' OR t[1] = '"') THEN 'LIT'
    WHEN regexp_full_match(t, '\p{{Nd}}+(\.\p{{Nd}}+)?') THEN 'LIT'
    WHEN regexp_matches(t, '^\p{{Nd}}+\.') THEN 'LIT.' || {_name(_AFTER_NUMBER)} ELSE {_name("t")} END FOR t IN tokens], ''), '{T.WHITE_SPACE}', '') AS norm FROM cut
), per AS (SELECT doc_id, count(*) AS n_lines, string_agg(norm, chr(10) ORDER BY line_no) AS norms FROM normed GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, md5(coalesce(norms, '')) AS digest FROM documents d LEFT JOIN per USING (doc_id)""")
def q_normalise_lines(spark, sf_dir):
    """Digest of each document's normalised lines, whatever their characters; documents without lines have none."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    bare = F.filter(F.transform(T.lines_of(F.col("text")), T.stripped), lambda s: s != "")
    normed = F.transform("lines", T.normalised_tokens)
    return docs.select("doc_id", bare.alias("lines")).select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join(normed, "\n").cast("binary")).alias("digest"))


def _windows(spark, sf_dir):
    found = clones.code_lines(read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", skip=COMMENTS, normalise=clones.plain)
    return clones.windows(found, "doc_id")


_WINDOWS = (
    _LINES
    + r""", code AS (
  SELECT doc_id, line_no, norm, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS pos FROM (
    SELECT doc_id, line_no, regexp_replace(regexp_replace(lower(bare), '[1-9]', '0', 'g'), '[ \t]+', '', 'g') AS norm FROM lines
    WHERE bare <> '' AND NOT (starts_with(bare, 'The ') OR starts_with(bare, 'And '))) WHERE norm <> ''
), windows AS (
  SELECT doc_id, pos, start_line, end_line, sha256(joined) AS hash FROM (
    SELECT doc_id, pos, line_no AS start_line, max(line_no) OVER w AS end_line, count(*) OVER w AS n, string_agg(norm, chr(0)) OVER w AS joined
    FROM code WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)) WHERE n = 6
)"""
)


@query(f"WITH {_WINDOWS} SELECT doc_id, pos, start_line, end_line, hash FROM windows")
def q_window_hash(spark, sf_dir):
    """Hashes of all windows of six code lines."""
    return _windows(spark, sf_dir)


_PAIRS = _WINDOWS + ", once AS (SELECT DISTINCT doc_id, hash FROM windows), pairs AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM once x JOIN once y USING (hash) WHERE x.doc_id < y.doc_id)"


@query(f"WITH {_PAIRS} SELECT a, b FROM pairs")
def q_clone_candidates(spark, sf_dir):
    """Pairs of documents that share a window."""
    return clones.candidate_pairs(_windows(spark, sf_dir), "doc_id")


@query(f"""WITH {_WINDOWS}, met AS (
  SELECT x.doc_id AS a, y.doc_id AS b, x.pos AS a_pos, y.pos AS b_pos FROM windows x JOIN windows y USING (hash) WHERE x.doc_id < y.doc_id
), islands AS (SELECT *, b_pos - a_pos AS d, a_pos - row_number() OVER (PARTITION BY a, b, b_pos - a_pos ORDER BY a_pos) AS g FROM met)
SELECT a, b, min(a_pos) AS a_pos, min(b_pos) AS b_pos, count(*) + 5 AS length FROM islands GROUP BY a, b, d, g""")
def q_clone_runs(spark, sf_dir):
    """Maximal runs of matching lines between two documents."""
    return clones.runs(_windows(spark, sf_dir), "doc_id")


@query(f"""WITH {_WINDOWS}, met AS (
  SELECT x.doc_id AS a, x.pos AS a_pos, y.pos AS b_pos FROM windows x JOIN windows y USING (hash, doc_id) WHERE y.pos - x.pos >= 6
), islands AS (SELECT *, b_pos - a_pos AS gap, a_pos - row_number() OVER (PARTITION BY a, b_pos - a_pos ORDER BY a_pos) AS g FROM met
), spans AS (SELECT a, gap, min(a_pos) AS first, count(*) + 5 AS total FROM islands GROUP BY a, gap, g
), pieces AS (SELECT a, gap, total, first, unnest(range(0, total, gap)) AS off FROM spans)
SELECT a, first + off AS a_pos, first + off + gap AS b_pos, least(gap, total - off) AS length FROM pieces WHERE least(gap, total - off) >= 6""")
def q_clone_self_runs(spark, sf_dir):
    """Repeated stretches within one document."""
    return clones.self_runs(_windows(spark, sf_dir), "doc_id")


_COMPONENTS = _PAIRS.replace("pairs AS (", "star AS (SELECT hash, min(doc_id) AS v FROM once GROUP BY hash HAVING count(*) > 1), edges AS (SELECT DISTINCT doc_id AS u, v FROM once JOIN star USING (hash) WHERE doc_id <> v), both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges), pairs AS (") + """, reach(node, seen) AS (
  SELECT u, u FROM both_ways UNION SELECT r.node, b.v FROM reach r JOIN both_ways b ON b.u = r.seen
), comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)"""


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT node AS doc_id, component FROM comp")
def q_clone_components(spark, sf_dir):
    """Smallest document connected through shared windows."""
    return components(clones.star_edges(_windows(spark, sf_dir), "doc_id")).select(F.col("node").alias("doc_id"), "component")


@query(f"""WITH RECURSIVE {_COMPONENTS}, repeated AS (SELECT hash FROM windows GROUP BY hash HAVING count(DISTINCT doc_id) > 1
), shared AS (SELECT doc_id, count(DISTINCT hash) AS w FROM windows JOIN repeated USING (hash) GROUP BY doc_id
), grp AS (SELECT component AS root, count(*) AS n_members, max(w) AS n_windows FROM comp JOIN shared ON doc_id = node GROUP BY component
), ranked AS (SELECT row_number() OVER (ORDER BY n_windows DESC, n_members DESC, root) AS group_id, root, n_members, n_windows FROM grp)
SELECT group_id, root, node AS member, n_members, n_windows FROM ranked JOIN comp ON component = root""")
def q_clone_groups(spark, sf_dir):
    """Members of groups of connected documents, groups ranked."""
    return clones.clone_groups(_windows(spark, sf_dir), "doc_id")


@query(f"""WITH {_WINDOWS}, later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id, pos) AS k FROM windows) WHERE k > 1
), dup AS (SELECT DISTINCT doc_id, unnest(range(start_line, end_line + 1)) AS line_no FROM later
), n AS (SELECT (SELECT count(*) FROM dup) AS duplicate_lines, (SELECT count(*) FROM code) AS code_lines)
SELECT duplicate_lines, code_lines, round_even(100.0 * duplicate_lines / greatest(code_lines, 1), 1) AS pct,
  CASE WHEN 100.0 * duplicate_lines / greatest(code_lines, 1) > 30 THEN 'FAIL' WHEN 100.0 * duplicate_lines / greatest(code_lines, 1) > 10 OR duplicate_lines > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM n""")
def q_dup_pct(spark, sf_dir):
    """Share of lines that repeat an earlier window."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    code = stored(clones.code_lines(docs, "doc_id", skip=COMMENTS, normalise=clones.plain))
    duplicate = clones.duplicate_lines(clones.windows(code, "doc_id"), "doc_id").agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).select(F.lit("duplicate").alias("what"), "n")
    total = code.agg(F.coalesce(F.sum(F.size("lines").cast("long")), F.lit(0)).alias("n")).select(F.lit("code").alias("what"), "n")
    both = duplicate.union(total).agg(F.sum(F.when(F.col("what") == "duplicate", F.col("n"))).alias("duplicate_lines"), F.sum(F.when(F.col("what") == "code", F.col("n"))).alias("code_lines"))
    percent = 100.0 * F.col("duplicate_lines") / F.greatest("code_lines", F.lit(1))
    return both.select("duplicate_lines", "code_lines", F.bround(percent, 1).alias("pct"), policy.share_status(percent, F.col("duplicate_lines"), 10, 30).alias("status"))


@query()
def q_clone_exact(spark, sf_dir):
    """Aligned blocks between classes of documents with the same lines, by their least one, and who belongs to each."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return clones.clone_blocks(docs, "doc_id", skip=COMMENTS, normalise=clones.plain)


@query()
def q_clone_report(spark, sf_dir):
    """Ranked groups of matched intervals within and between documents."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return clones.clone_report(docs, "doc_id", skip=COMMENTS, normalise=clones.plain)
