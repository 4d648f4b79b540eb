"""Queries over the structure of pages and over texts in chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.operators import automaton, chunks, clones, nesting, structure
from sieveline.operators.storage import stored
from sieveline.plans.corpus import _LINES, _WINDOWS, COMMENTS
from sieveline.plans.registry import query, read
from sieveline.plans.relations import _TAGS

LISTS = ("ul", "table")

_PLACED = f"""cut AS (SELECT page_id, regexp_extract_all(html, '(?i)</?(?:{"|".join(structure.TAGS)})[ >]') AS t, string_split_regex(html, '(?i)</?(?:{"|".join(structure.TAGS)})[ >]') AS g FROM pages WHERE html IS NOT NULL
), each_tag AS (SELECT page_id, unnest(range(1, len(t) + 1)) AS pos, unnest(t) AS raw, unnest(g[1:len(t)]) AS gap FROM cut
), placed AS (SELECT page_id, pos, lower(regexp_replace(raw, '[<>/ ]', '', 'g')) AS tag, starts_with(raw, '</') AS closing, CAST(sum(length(gap) + length(raw)) OVER w AS BIGINT) AS "end", length(raw) AS width,
    CAST(sum(CASE WHEN starts_with(raw, '</') THEN -1 ELSE 1 END) OVER w AS BIGINT) AS depth FROM each_tag WINDOW w AS (PARTITION BY page_id ORDER BY pos)
), tags AS MATERIALIZED (SELECT *, "end" - width AS start, depth + CASE WHEN closing THEN 1 ELSE 0 END AS level FROM placed
), opened AS (SELECT page_id, level, pos AS open_pos, tag AS open_tag, "end" AS inner_start,
    (SELECT min(c.pos) FROM tags c WHERE c.page_id = o.page_id AND c.level = o.level AND c.closing AND c.pos > o.pos) AS close_pos FROM tags o WHERE NOT closing
), pairs AS MATERIALIZED (
  SELECT coalesce(o.page_id, c.page_id) AS page_id, coalesce(o.level, c.level) AS level, open_pos, open_tag, c.pos AS close_pos, c.tag AS close_tag, inner_start, CASE WHEN open_pos IS NOT NULL THEN c.start END AS inner_end
  FROM opened o FULL JOIN (SELECT * FROM tags WHERE closing) c ON c.page_id = o.page_id AND c.pos = o.close_pos)"""


def _tags(spark, sf_dir):
    return stored(nesting.placed_tags(read(spark, sf_dir, "pages", "page_id", "html"), "page_id", "html"))


@query(f"WITH {_PLACED} SELECT * FROM pairs")
def q_tag_pairs(spark, sf_dir):
    """Every opening tag with its closing tag and the characters between them; unmatched ones with nulls."""
    return nesting.matched(_tags(spark, sf_dir), "page_id")


@query(f"""WITH {_PLACED}, around AS (SELECT t.page_id, t.pos, max(p.open_pos) AS parent_pos, max(p.open_pos) FILTER (p.open_tag IN ('ul', 'table')) AS list_pos
  FROM tags t LEFT JOIN pairs p ON p.page_id = t.page_id AND p.open_pos < t.pos AND (p.close_pos IS NULL OR p.close_pos > t.pos) WHERE NOT t.closing GROUP BY t.page_id, t.pos)
SELECT t.page_id, t.pos, t.tag, t.level, a.parent_pos, u.tag AS parent_tag, a.list_pos FROM around a JOIN tags t USING (page_id, pos) LEFT JOIN tags u ON u.page_id = a.page_id AND u.pos = a.parent_pos""")
def q_tag_parents(spark, sf_dir):
    """Parent and nearest enclosing list or table of every opening tag."""
    tags = _tags(spark, sf_dir)
    pairs = nesting.matched(tags, "page_id")
    found = nesting.enclosing(tags, pairs, "page_id", F.col("tag").isin(*LISTS)).select(F.col("page_id").alias("__page"), F.col("pos").alias("__pos"), "list_pos")
    joined = nesting.parents(tags, "page_id").join(found, (F.col("page_id") == F.col("__page")) & (F.col("pos") == F.col("__pos")))
    return joined.select("page_id", "pos", "tag", "level", "parent_pos", "parent_tag", "list_pos")


@query(r"""WITH parts AS (SELECT page_id, html, unnest(range(len(t))) AS i, unnest(t) AS part FROM (
  SELECT page_id, html, regexp_extract_all(html, '(?s)<!--.*?(?:-->|\z)|<(?:[^>"'']|"[^"]*(?:"|\z)|''[^'']*(?:''|\z))*(?:>|\z)|[^<]+') AS t FROM pages)
), shown AS (SELECT page_id, html, i, CASE WHEN starts_with(part, '<!--') THEN regexp_replace(part, '[^\r\n]', ' ', 'g') WHEN starts_with(part, '<') THEN
  array_to_string([CASE WHEN p[1] IN ('"', '''') THEN regexp_replace(p, '[^\r\n]', ' ', 'g') ELSE p END FOR p IN regexp_extract_all(part, '(?s)"[^"]*(?:"|\z)|''[^'']*(?:''|\z)|[^"'']+')], '') ELSE part END AS part FROM parts
), whole AS (SELECT page_id, any_value(html) AS html, string_agg(part, '' ORDER BY i) AS rest FROM shown GROUP BY page_id)
SELECT page_id, length(rest) AS n_chars, length(rest) - length(replace(rest, chr(10), '')) AS n_breaks, length(html) - length(replace(html, ' ', '')) < length(rest) - length(replace(rest, ' ', '')) AS changed, md5(rest) AS digest FROM whole""")
def q_masked_pages(spark, sf_dir):
    """Pages with comments and quoted values as spaces, by an automaton over chunks; lines keep their numbers."""
    pages = read(spark, sf_dir, "pages", "page_id", "html")
    parts = automaton.masked(pages, "page_id", "html")
    rest = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))), lambda p: p["part"]), "").alias("rest")
    whole = parts.groupBy("page_id").agg(rest)
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    joined = whole.join(pages, "page_id")
    return joined.select(
        "page_id", F.length("rest").cast("long").alias("n_chars"), (F.length("rest") - F.length(F.replace("rest", F.lit("\n"), F.lit("")))).cast("long").alias("n_breaks"),
        (spaces(F.col("html")) < spaces(F.col("rest"))).alias("changed"), F.md5(F.col("rest").cast("binary")).alias("digest"),
    )


@query(f"""WITH {_TAGS}, depths AS (SELECT page_id, sum(step) OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM tags)
SELECT page_id, CAST(max(depth) AS BIGINT) AS max_depth, count(*) AS n_tags FROM depths GROUP BY page_id""")
def q_chunk_depth(spark, sf_dir):
    """Greatest nesting of each page, from its chunks of 4096 characters."""
    cut = chunks.chunked(read(spark, sf_dir, "pages", "page_id", "html"), "page_id", "html")
    return chunks.greatest_depths(cut, "page_id")


@query(f"""WITH {_LINES}, marks AS (SELECT *, CASE WHEN contains(bare, '.') THEN 0 WHEN starts_with(bare, 'In ') THEN 1 END AS mark FROM lines
), state AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM marks)
SELECT doc_id, line_no, CASE WHEN bare = '' THEN 'blank' WHEN inside = 1 OR starts_with(bare, 'In ') OR starts_with(bare, 'The ') OR starts_with(bare, 'And ') THEN 'comment' ELSE 'code' END AS kind, length(raw) AS n_chars FROM state""")
def q_chunk_kinds(spark, sf_dir):
    """Kind of every line with block comments, from chunks of the documents."""
    cut = chunks.chunked(read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    kinds = chunks.classified(chunks.lines(cut, "doc_id"), "doc_id", COMMENTS, ("In ", "."))
    return kinds.select("doc_id", "line_no", "kind", F.length("raw").cast("long").alias("n_chars"))


@query(f"WITH {_WINDOWS} SELECT doc_id, pos, start_line, end_line, hash FROM windows")
def q_chunk_windows(spark, sf_dir):
    """Hashes of all windows of six code lines, from chunks of the documents."""
    cut = chunks.chunked(read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    rows = clones.code_rows(chunks.lines(cut, "doc_id"), COMMENTS, clones.plain)
    return chunks.windows(rows, "doc_id", clones.WINDOW)
