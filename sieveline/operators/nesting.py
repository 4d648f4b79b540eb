"""Matching of opening and closing tags, and what encloses each, without a stack.

A running sum of steps gives every tag a level: an opening tag stands on the level that it
opens, a closing tag on the one that it closes. On one level of a text openings and
closings alternate, so a tag's partner is its neighbour there, and the parent of a tag is
the last opening on the level below. Neighbours and last openings are running values by
(text, level), so neither a text nor a level has to fit into a task.

Names are not compared: a closing tag closes what is open. A closing tag with nothing open
and an opening tag that nothing closes are unmatched; the latter encloses all that follows.

Edge cases: texts without tags give no rows; null texts likewise; offsets count characters
from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.operators.scans import latest, running, total
from sieveline.operators.structure import TAGS


def placed_tags(texts: DataFrame, key: str, text: str, names: tuple[str, ...] = TAGS) -> DataFrame:
    """(key, pos from 1, tag, step, level, start, end): tags in order, with their levels and the characters they take."""
    pattern = rf"(?i)(</?(?:{'|'.join(names)})[ >])"
    cut = texts.select(key, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)).alias("__tags"), F.transform(F.split(F.col(text), pattern, -1), F.length).alias("__gaps"))
    each = cut.select(key, "__gaps", F.posexplode("__tags").alias("__at", "__tag"))
    closing = F.startswith("__tag", F.lit("</"))
    each = each.select(
        key, (F.col("__at") + 1).cast("long").alias("pos"), F.lower(F.regexp_replace("__tag", "[<>/ ]", "")).alias("tag"), F.when(closing, -1).otherwise(1).cast("long").alias("step"),
        F.get("__gaps", F.col("__at")).cast("long").alias("__gap"), F.length("__tag").cast("long").alias("__width"),
    )
    summed = running(each, [key], ["pos"], __depth=total(F.col("step")), end=total(F.col("__gap") + F.col("__width")))
    level = F.col("__depth") + F.when(F.col("step") < 0, 1).otherwise(0)
    return summed.select(key, "pos", "tag", "step", level.alias("level"), (F.col("end") - F.col("__width")).alias("start"), "end")


def matched(tags: DataFrame, key: str) -> DataFrame:
    """(key, level, open_pos, open_tag, close_pos, close_tag, inner_start, inner_end): all pairs, and unmatched tags with nulls.

    ``inner`` is the text between both tags.
    """
    row = F.struct("pos", "tag", "step", "start", "end")
    before = running(tags, [key, "level"], ["pos"], __last=latest(row, before=True))
    closes = before.where("step < 0")
    opened = F.when(F.col("__last.step") > 0, F.col("__last"))
    none = lambda kind: F.lit(None).cast(kind)
    ended = closes.withColumn("__open", opened).select(
        key, "level", F.col("__open.pos").alias("open_pos"), F.col("__open.tag").alias("open_tag"), F.col("pos").alias("close_pos"), F.col("tag").alias("close_tag"),
        F.col("__open.end").alias("inner_start"), F.when(F.col("__open").isNotNull(), F.col("start")).alias("inner_end"),
    )
    ends = tags.groupBy(key, "level").agg(F.max_by(row, "pos").alias("__last")).where("__last.step > 0")
    left = ends.select(key, "level", F.col("__last.pos").alias("open_pos"), F.col("__last.tag").alias("open_tag"), none("long").alias("close_pos"), none("string").alias("close_tag"), F.col("__last.end").alias("inner_start"), none("long").alias("inner_end"))
    return ended.unionByName(left)


def last_on_level(marks: DataFrame, probes: DataFrame, key: str, value: str) -> DataFrame:
    """Adds ``value`` of the last mark (key, level, pos, value) before each probe (key, level, pos, ...) on its level."""
    columns = probes.columns
    stacked = marks.select(key, "level", "pos", F.col(value).alias("__value"), F.lit(0).alias("__probe"), F.lit(None).cast(probes.schema.simpleString()).alias("__row"))
    asked = probes.select(key, "level", "pos", F.lit(None).cast(dict(marks.dtypes)[value]).alias("__value"), F.lit(1).alias("__probe"), F.struct(*columns).alias("__row"))
    found = running(stacked.unionByName(asked), [key, "level"], ["pos", "__probe"], __found=latest(F.col("__value"), before=True))
    return found.where("__probe = 1").select("__row.*", F.col("__found").alias(value))


def enclosing(tags: DataFrame, pairs: DataFrame, key: str, wanted: Column) -> DataFrame:
    """Adds ``list_pos``: the opening of the innermost pair, among those with ``wanted`` (of ``tag``), that encloses each opening tag.

    The wanted pairs have levels of their own: up at an opening and down at its closing.
    """
    chosen = pairs.withColumn("tag", F.col("open_tag")).where(F.col("open_pos").isNotNull() & wanted)
    ups = chosen.select(key, F.col("open_pos").alias("pos"), F.lit(1).cast("long").alias("__turn"), F.col("open_pos").alias("list_pos"))
    downs = chosen.where("close_pos is not null").select(key, F.col("close_pos").alias("pos"), F.lit(-1).cast("long").alias("__turn"), F.lit(None).cast("long").alias("list_pos"))
    opens = tags.where("step > 0").drop("level")
    rows = opens.select(key, "pos", F.lit(0).cast("long").alias("__turn"), F.lit(None).cast("long").alias("list_pos"), F.struct(*opens.columns).alias("__row"))
    turns = ups.unionByName(downs).withColumn("__row", F.lit(None).cast(opens.schema.simpleString()))
    # A tag's own opening comes after it, so that a list does not enclose itself.
    levelled = running(rows.unionByName(turns).withColumn("__own", F.abs("__turn")), [key], ["pos", "__own"], level=total(F.col("__turn")))
    marks = levelled.where("__turn > 0").select(key, "level", "pos", "list_pos")
    probes = levelled.where("__turn = 0").select(key, "level", "pos", "__row")
    return last_on_level(marks, probes, key, "list_pos").select("__row.*", "list_pos")


def parents(tags: DataFrame, key: str) -> DataFrame:
    """Adds ``parent_pos`` and ``parent_tag`` to opening tags: the last opening on the level below."""
    marks = tags.where("step > 0").select(key, "level", "pos", F.struct("pos", "tag").alias("parent"))
    opens = tags.where("step > 0").select(key, (F.col("level") - 1).alias("level"), "pos", "tag", "step", "start", "end")
    found = last_on_level(marks, opens, key, "parent")
    return found.select(key, "pos", "tag", "step", (F.col("level") + 1).alias("level"), "start", "end", F.col("parent.pos").alias("parent_pos"), F.col("parent.tag").alias("parent_tag"))
