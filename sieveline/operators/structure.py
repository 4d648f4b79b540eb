"""Nesting depth, segments and heuristic complexity from token and line streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions import policy
from sieveline.functions import text as T
from sieveline.operators.lines import exploded
from sieveline.operators.scans import running, total

#: Elements of a page whose nesting is followed.
TAGS = ("html", "body", "div", "ul", "li", "p", "table", "tr", "td", "span", "article", "nav")


def tags(pages: DataFrame, key: str, text: str, names: tuple[str, ...] = TAGS) -> DataFrame:
    """(key, pos from 1, tag, step): opening tags step up, closing tags down. Narrow."""
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit(rf"(</?(?:{'|'.join(names)})[ >])"), F.lit(1))
    each = pages.select(key, F.posexplode(found).alias("__at", "tag"))
    return each.select(key, (F.col("__at") + 1).cast("long").alias("pos"), F.regexp_replace("tag", "[<>/ ]", "").alias("tag"), F.when(F.startswith("tag", F.lit("</")), -1).otherwise(1).cast("long").alias("step"))


def running_depth(stream: DataFrame, key: str, order: str = "pos", step: str = "step") -> DataFrame:
    """Adds ``depth``: sum of steps up to and with each row."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return stream.withColumn("depth", F.sum(step).over(upto))


def segments(stream: DataFrame, key: str, header: Column, order: str = "pos") -> DataFrame:
    """Adds ``segment``: number of header rows up to and with each row; 0 before the first."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return stream.withColumn("segment", F.sum(F.when(header, 1).otherwise(0).cast("long")).over(upto))


#: How a line of a C-like function header and of a branch is told.
HEADER_TYPES = ("int ", "void ", "bool ", "auto ", "double ")
BRANCHES = ("if (", "if(", "while (", "while(", "for (", "for(", "catch (", "case ", "&&", "||")


def contains_any(line: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(line, F.lit(part))
    return found


def counted(line: Column, char: str) -> Column:
    return (F.length(line) - F.length(F.replace(line, F.lit(char), F.lit("")))).cast("long")


def heuristic_functions(files: DataFrame, key: str = "path", text: str = "content", warn=15, fail=25, warn_nesting=4) -> DataFrame:
    """Functions of C-like sources with start_line, end_line, complexity and nesting.

    A header line opens a segment at depth 1 and counts nothing else; later lines add
    one branch at most. A segment ends where its depth falls to 0, at the line before
    the next header, or at the end.
    """
    lines = exploded(files, key, text).withColumn("bare", T.stripped(F.col("raw")))
    line = F.col("bare")
    header = F.contains(line, F.lit("(")) & F.contains(line, F.lit(")")) & F.contains(line, F.lit("{")) & ~T.starts_with_any(line, ("//", "#", "/*")) & contains_any(line, HEADER_TYPES)
    lines = segments(lines.withColumn("header", header), key, F.col("header"), "line_no").where(F.col("segment") > 0)
    opens, closes = F.when(F.col("header"), 1).otherwise(counted(line, "{")), F.when(F.col("header"), 0).otherwise(counted(line, "}"))
    upto = Window.partitionBy(key, "segment").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key, "segment").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumns({"__opens": opens, "__closes": closes, "__branch": F.when(F.col("header"), 0).otherwise(F.when(contains_any(line, BRANCHES), 1).otherwise(0))})
    lines = lines.withColumn("__depth", F.sum(F.col("__opens") - F.col("__closes")).over(upto))
    # The depth counts openings of a line before its closings.
    lines = lines.withColumn("__peak", F.coalesce(F.lag("__depth").over(Window.partitionBy(key, "segment").orderBy("line_no")), F.lit(0)) + F.col("__opens"))
    lines = lines.withColumn("__ended", F.coalesce(F.max(F.when(F.col("__depth") <= 0, 1).otherwise(0)).over(before), F.lit(0)))
    live = lines.where(F.col("__ended") == 0)
    out = live.groupBy(key, "segment").agg(
        F.min("line_no").alias("start_line"),
        F.max("line_no").alias("end_line"),
        F.max(F.when(F.col("header"), F.element_at(F.split(F.trim(F.substring_index("bare", "(", 1)), r"\s+"), -1))).alias("name"),
        (F.lit(1) + F.sum("__branch")).alias("complexity"),
        F.max("__peak").alias("nesting"),
    )
    return out.drop("segment").withColumn("status", policy.complexity_status(F.col("complexity"), F.col("nesting"), warn, fail, warn_nesting))


def first_after_terminator(events: DataFrame, key: str, terminator: Column, order: str) -> DataFrame:
    """The first row after a terminator in each group, by a running count and a partial least: no task holds a group."""
    columns = events.columns
    seen = running(events, [key], [order], __seen=total(F.when(terminator, 1).otherwise(0).cast("long"), before=True)).where(F.col("__seen") > 0)
    least = seen.groupBy(F.col(key).alias("__key")).agg(F.min_by(F.struct(*columns), F.struct(order, *[c for c in columns if c != order])).alias("__row"))
    return least.select("__row.*")
