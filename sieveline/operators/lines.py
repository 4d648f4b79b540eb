"""Line tables and line statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions import text as T


def exploded(docs: DataFrame, key: str, text: str = "text", breaks: str = T.FILE_BREAK) -> DataFrame:
    """(key, line_no from 1, raw): one row for each line. Narrow."""
    numbered = docs.select(key, F.posexplode(T.lines_of(F.col(text), breaks)).alias("__at", "raw"))
    return numbered.select(key, (F.col("__at") + 1).cast("long").alias("line_no"), "raw")


def block_state(lines: DataFrame, key: str, opens: Column, closes: Column) -> DataFrame:
    """Adds ``in_block``: whether the line stands in a block that an earlier line opened.

    A closing line always leaves the state closed and an opening line that does not
    close leaves it open, whatever the state before, so the state is the last such
    line's.
    """
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(closes, F.lit(False)).when(opens, F.lit(True))
    return lines.withColumn("in_block", F.coalesce(F.last(mark, ignorenulls=True).over(before), F.lit(False)))


def classified(lines: DataFrame, key: str, comment_starts: tuple[str, ...], block: tuple[str, str] | None = None) -> DataFrame:
    """Adds ``kind``: blank, comment or code.

    ``block`` holds the marks of block comments. A block opens only at the start of
    a line, and its closing line is a comment as a whole. Blank lines stay blank
    inside a block.
    """
    bare = T.stripped(F.col("raw"))
    lines = lines.withColumn("__bare", bare)
    line = F.col("__bare")
    comment = T.starts_with_any(line, comment_starts)
    if block:
        opens, closes = F.startswith(line, F.lit(block[0])), F.contains(line, F.lit(block[1]))
        lines = block_state(lines, key, opens, closes)
        comment = F.col("in_block") | opens | comment
    out = lines.withColumn("kind", F.when(line == "", "blank").when(comment, "comment").otherwise("code"))
    return out.drop("__bare", "in_block")


def kind_counts(docs: DataFrame, key: str, comment_starts: tuple[str, ...], text: str = "text") -> DataFrame:
    """(key, code, comment, blank, total) by array functions: no explode, no shuffle."""
    bare = F.transform(T.lines_of(F.col(text)), T.stripped)
    counted = docs.select(key, bare.alias("__lines"))
    of = lambda test: F.size(F.filter("__lines", test)).cast("long")
    blank = of(lambda s: s == "")
    comment = of(lambda s: (s != "") & T.starts_with_any(s, comment_starts))
    total = F.size("__lines").cast("long")
    return counted.select(key, (total - blank - comment).alias("code"), comment.alias("comment"), blank.alias("blank"), total.alias("total"))


#: Language of a file by suffix, and how its comments look.
LANGUAGES = {
    ".cpp": "C++", ".c": "C++", ".h": "C++", ".hpp": "C++", ".cc": "C++", ".cxx": "C++", ".py": "Python",
    ".sh": "Shell", ".csh": "Shell", ".toml": "TOML", ".md": "Markdown", ".yml": "YAML", ".yaml": "YAML", ".json": "JSON",
}
HASH_SUFFIXES = (".py", ".sh", ".csh", ".toml", ".yml", ".yaml")
SLASH_SUFFIXES = (".cpp", ".c", ".h", ".hpp", ".cc", ".cxx")


def suffix_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def file_statistics(files: DataFrame) -> DataFrame:
    """(path, lang, code, comment, blank, total) of source files (path, content)."""
    suffix = suffix_of(F.col("path"))
    known = files.withColumn("__suffix", suffix).where(F.col("__suffix").isin(*LANGUAGES)).where(~T.ignored_path(F.col("path")))
    lines = known.select("path", "__suffix", F.posexplode_outer(T.lines_of(F.col("content"))).alias("__at", "raw"))
    lines = lines.select("path", "__suffix", (F.col("__at") + 1).cast("long").alias("line_no"), "raw", T.stripped(F.col("raw")).alias("__bare"))
    slashes, hashes = F.col("__suffix").isin(*SLASH_SUFFIXES), F.col("__suffix").isin(*HASH_SUFFIXES)
    opens = slashes & F.startswith("__bare", F.lit("/*"))
    closes = slashes & F.contains("__bare", F.lit("*/"))
    lines = block_state(lines, "path", opens, closes)
    comment = (slashes & (F.col("in_block") | opens | F.startswith("__bare", F.lit("//")))) | (hashes & F.startswith("__bare", F.lit("#")))
    kind = F.when(F.col("raw").isNull(), None).when(F.col("__bare") == "", "blank").when(comment, "comment").otherwise("code")
    counted = lines.withColumn("kind", kind).groupBy("path", "__suffix").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("code", "comment", "blank")], F.count("kind").alias("total"))
    language = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return counted.select("path", F.element_at(language, F.col("__suffix")).alias("lang"), "code", "comment", "blank", "total")


GATE_DIRS = ("src", "include", "lib", "app")


def gated(path: Column, gate: tuple[str, ...] = GATE_DIRS, exclude: tuple[str, ...] = ()) -> Column:
    """Whether the first part of a path is one of ``gate`` and none of ``exclude``."""
    return F.element_at(F.split(path, "/"), 1).isin(*[d for d in gate if d not in exclude])
