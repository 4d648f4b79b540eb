r"""Line-first cleaning: lines are judged one by one, then the document by what is left.

A line with a word fails by the first rule that it breaks:

* ``repeated``: it equals an earlier line of its document;
* ``boilerplate``: it holds one of ``PHRASES``, in any case of A-Z;
* ``navigation``: words that are only a separator (``|``, ``>``, ...) number at least a
  quarter of its words;
* ``punctuation``: it has four words or more and no sentence mark, or three symbols or
  more that make up over a tenth of its characters, or two doubled exclamation or
  question marks or more, one for every four words.

Failing lines are taken out. A document that loses more than ``LOST`` of its word
characters is rejected, as is one that fails the base rules: fewer than 20 words, or
over 30 % of its words inside runs of eight words that occur twice or more.

Repeated runs are found exactly: words become numbers, and three rounds of ranking
pairs (of words, of pairs, of fours) give equal numbers to equal runs of eight. The work
is one narrow pass; a document's memory is its text, its lines and 4 bytes for each
word, with some multiples of 8 bytes while runs are ranked.

Edge cases: a null text has no words, lines or cleaned text (null stays null) and fails
the base rules; lines without a word are kept as they are and never judged; every row is
judged for itself, repeated ids included; an empty table gives no rows; columns of any
name pass through.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import positional, quoted, restored, small_batches, table

RUN = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
"""Percentage of words in repeated runs beyond which a document fails."""
LOST = 50
"""Percentage of word characters that cleaning may take away."""
PHRASES = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "use of cookies", "accept cookies", "enable javascript", "javascript is disabled",
    "lorem ipsum", "click here", "read more", "sign up for", "log in to", "subscribe to our", "follow us on", "share this", "back to top", "skip to content",
)
SEPARATORS = ("|", "||", ">", ">>", "»", "›", "·", "•", "/")
SYMBOLS = "#*$%&|<>"
MARKS = ".!?…:;。！？"
RULES = ("repeated", "boilerplate", "navigation", "punctuation")

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DOUBLED = re.compile("[!?]{2,}")
_MARK = re.compile(f"[{re.escape(MARKS)}]")
_PHRASE = re.compile("|".join(map(re.escape, PHRASES)))
_LOWER = {c: c + 32 for c in range(65, 91)}


def in_repeated_runs(codes: np.ndarray, run: int = RUN) -> int:
    """How many places lie in a run of ``run`` (a power of two) equal numbers that occurs twice or more."""
    n = len(codes)
    if n <= run:
        return 0
    ranks, step = codes.astype(np.int64), 1
    while step < run:
        pairs = ranks[:-step] * (int(ranks.max()) + 1) + ranks[step:]
        _, ranks, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if counts.max() == 1:
            return 0
        step *= 2
    twice = np.flatnonzero(counts[ranks] > 1)
    ends = np.zeros(n + 1, np.int64)
    np.add.at(ends, twice, 1)
    np.add.at(ends, twice + run, -1)
    return int((np.cumsum(ends[:n]) > 0).sum())


def n_symbols(text: str) -> int:
    return sum(text.count(c) for c in SYMBOLS)


def failing_rule(line: str, words: list[str]) -> str | None:
    """The rule, other than ``repeated``, that a line with words breaks first."""
    n, chars = len(words), sum(map(len, words))
    if _PHRASE.search(line.translate(_LOWER)):
        return "boilerplate"
    if 4 * sum(w in SEPARATORS for w in words) >= n:
        return "navigation"
    if n >= 4 and not _MARK.search(line):
        return "punctuation"
    symbols = n_symbols(line)
    if symbols >= 3 and 10 * symbols > chars:
        return "punctuation"
    doubled = len(_DOUBLED.findall(line))
    return "punctuation" if doubled >= 2 and 4 * doubled >= n else None


def judge(text: str | None, cleaned: bool = True) -> dict:
    """All measures of a text, its failed lines by rule, and, where asked for, what is left of it."""
    codes, known, seen = array("i"), {}, set()
    left, failed = [], dict.fromkeys(RULES, 0)
    word_chars = lost_chars = dup_lines = 0
    for line in () if text is None else text.split("\n"):
        words = _WORD.findall(line)
        if not words:
            if cleaned:
                left.append(line)
            continue
        codes.extend([known.setdefault(w, len(known)) for w in words])
        chars = sum(map(len, words))
        word_chars += chars
        again = line in seen
        seen.add(line)
        dup_lines += again
        rule = "repeated" if again else failing_rule(line, words)
        if rule:
            failed[rule] += 1
            lost_chars += chars
        elif cleaned:
            left.append(line)
    n = len(codes)
    repeat_words = in_repeated_runs(np.frombuffer(codes, np.int32)) if n else 0
    base_failed = n < LEAST_WORDS or 100 * repeat_words > MOST_REPEATED * n
    return {
        "n_words": n, "word_chars": word_chars, "n_symbols": n_symbols(text or ""), "n_dup_lines": dup_lines, "n_repeat_words": repeat_words, "base_failed": base_failed,
        "kept": not base_failed and 100 * lost_chars <= LOST * word_chars, "lost_chars": lost_chars, **{f"n_{rule}": k for rule, k in failed.items()}, "clean_text": None if text is None or not cleaned else "\n".join(left),
    }


MEASURES = {**{name: "long" for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}, "base_failed": "boolean", "kept": "boolean", "lost_chars": "long", **{f"n_{rule}": "long" for rule in RULES}}
_TYPES = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


def assess(docs: DataFrame, text: str = "text", keep: list[str] | None = None, cleaned: bool = True) -> DataFrame:
    """The ``keep`` columns (all by default), every measure and, unless ``cleaned`` is false, ``clean_text``. Narrow."""
    small_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    rows = docs.select(*positional(docs, keep), F.col(quoted(text)).alias("text"))
    more = MEASURES | ({"clean_text": "string"} if cleaned else {})
    names = [*rows.columns[:-1], *more]

    def run(batches):
        for batch in batches:
            found = [judge(t.as_py(), cleaned) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array([x[m] for x in found], _TYPES[kind]) for m, kind in more.items())], names)

    schema = ", ".join([*(f"{n} {t}" for n, t in rows.dtypes[:-1]), *(f"{n} {t}" for n, t in more.items())])
    return restored(rows.mapInArrow(run, schema), keep, *more)


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents that stay, with their cleaned text in place of the text; the columns of ``docs``."""
    columns = docs.columns
    judged = assess(docs.select(*positional(docs), F.col(quoted(text)).alias("t")), "t", [f"c{k}" for k in range(len(columns))])
    at = columns.index(text)
    return judged.where("kept").select(*[F.col("clean_text" if k == at else f"c{k}").alias(name) for k, name in enumerate(columns)])


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    judged = assess(table(spark, sf_dir, "documents", "doc_id", "text"), keep=["doc_id"], cleaned=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars", *[f"n_{rule}" for rule in RULES])


def _oracle() -> str:
    quote = lambda values: ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    phrase = " OR ".join(f"contains(low, {quote([p])})" for p in PHRASES)
    return rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
    l AS MATERIALIZED (SELECT r, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d WHERE text IS NOT NULL)),
    m AS MATERIALIZED (SELECT r, i, len(w) AS n, list_sum(list_transform(w, lambda x: length(x))) AS chars, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS again,
        translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, line,
        len(list_filter(w, lambda x: x IN ({quote(SEPARATORS)}))) AS seps, length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols, len(regexp_extract_all(line, '[!?]{{2,}}')) AS doubled
      FROM l WHERE len(w) > 0),
    rules AS MATERIALIZED (SELECT r, n, chars, again, CASE WHEN again THEN 'repeated' WHEN {phrase} THEN 'boilerplate' WHEN 4 * seps >= n THEN 'navigation'
        WHEN (n >= 4 AND NOT regexp_matches(line, '[{MARKS}]')) OR (symbols >= 3 AND 10 * symbols > chars) OR (doubled >= 2 AND 4 * doubled >= n) THEN 'punctuation' END AS rule FROM m),
    lines AS (SELECT r, sum(chars) AS word_chars, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(chars) FILTER (rule IS NOT NULL), 0) AS lost_chars,
        {", ".join(f"count(*) FILTER (rule = '{x}') AS n_{x}" for x in RULES)} FROM rules GROUP BY r),
    w AS MATERIALIZED (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d WHERE text IS NOT NULL)),
    g AS MATERIALIZED (SELECT r, p, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND {RUN - 1} FOLLOWING) AS gram, lead(p, {RUN - 1}) OVER (PARTITION BY r ORDER BY p) IS NOT NULL AS whole FROM w),
    twice AS MATERIALIZED (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, gram) AS k FROM g WHERE whole) WHERE k > 1),
    inside AS (SELECT r, count(*) AS n_repeat_words FROM (SELECT DISTINCT r, p + o AS q FROM twice, range({RUN}) s(o)) GROUP BY r),
    n AS (SELECT r, count(*) AS n_words FROM w GROUP BY r),
    a AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, coalesce(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), 0) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost_chars, 0)::BIGINT AS lost_chars, {", ".join(f"coalesce(n_{x}, 0) AS n_{x}" for x in RULES)}
      FROM d LEFT JOIN lines USING (r) LEFT JOIN inside USING (r) LEFT JOIN n USING (r)),
    b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM a)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost_chars <= {LOST} * word_chars AS kept, lost_chars, {", ".join(f"n_{x}" for x in RULES)} FROM b"""


ORACLE = _oracle()
