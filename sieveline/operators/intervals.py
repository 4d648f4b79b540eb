"""Range, as-of, prefix and set-comparison joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.scans import greatest, latest, running, total
from sieveline.operators.storage import stored


def covered_by_points(ranges: DataFrame, points: DataFrame, key: str, start: str, end: str, point: str, width: int = 65_536) -> DataFrame:
    """Adds ``covered`` and ``n_points`` to ranges: points of the same key in [start, end], all whole numbers.

    The points up to an end less those before a start. Points and ends are counted
    within stretches of ``width``, and stretches within keys, so a key of any size is
    dealt over many tasks and no pair of range and point is ever a row.
    """
    columns = ranges.columns
    named = stored(ranges.withColumn("__id", F.monotonically_increasing_id()))
    ends = F.explode(F.array(*[F.struct(F.col(c).cast("long").alias("at"), F.lit(order).alias("order"), F.lit(sign).alias("sign")) for c, order, sign in ((start, 0, -1), (end, 2, 1))])).alias("e")
    asked = named.select(F.col(key).alias("__key"), "__id", ends).select("__key", "__id", "e.*", F.lit(0).alias("n"))
    there = points.select(F.col(key).alias("__key"), F.lit(None).cast("long").alias("__id"), F.col(point).cast("long").alias("at"), F.lit(1).alias("order"), F.lit(0).alias("sign"), F.lit(1).alias("n"))
    stacked = asked.unionByName(there.where(F.col("at").isNotNull())).withColumn("__stretch", F.floor(F.col("at") / width))
    before = Window.partitionBy("__key").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stacked.groupBy("__key", "__stretch").agg(F.sum("n").alias("__sum"))
    stretches = stored(stretches.select("__key", "__stretch", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before")))
    within = Window.partitionBy("__key", "__stretch").orderBy("at", "order").rowsBetween(Window.unboundedPreceding, 0)
    counted = stacked.withColumn("__within", F.sum("n").over(within)).where(F.col("sign") != 0).join(stretches, ["__key", "__stretch"])
    found = counted.groupBy("__id").agg(F.sum(F.col("sign") * (F.col("__before") + F.col("__within"))).alias("__n"))
    joined = named.join(found, "__id", "left").withColumn("n_points", F.greatest(F.coalesce("__n", F.lit(0)), F.lit(0)).cast("long"))
    return joined.select(*columns, "n_points", (F.col("n_points") > 0).alias("covered"))


def as_of(probes: DataFrame, events: DataFrame, key: str, order: str, value: str, tie: str) -> DataFrame:
    """Adds ``as_of``: the value of the last event strictly before each probe.

    Both sides are stacked and dealt by ranges of (key, order), so a key of any size
    spans as many tasks as it needs; nothing is joined.
    """
    columns = probes.columns
    stacked = events.select(F.col(key).alias("__key"), F.col(order).alias("__at"), F.col(value).alias("__value"), F.lit(1).alias("__event"), F.col(tie).alias("__tie"), F.lit(None).cast(probes.schema.simpleString()).alias("__row"))
    asked = probes.select(F.col(key).alias("__key"), F.col(order).alias("__at"), F.lit(None).cast(dict(events.dtypes)[value]).alias("__value"), F.lit(0).alias("__event"), F.lit(None).cast(dict(events.dtypes)[tie]).alias("__tie"), F.struct(*columns).alias("__row"))
    # Probes sort before events of the same instant, so "strictly before" holds.
    found = running(stacked.unionByName(asked), ["__key"], ["__at", "__event", "__tie"], as_of=latest(F.col("__value"), before=True))
    return found.where(F.col("__event") == 0).select("__row.*", "as_of")


def kinds_since(events: DataFrame, key: str, order: list[str], resets: Column, kind: str) -> DataFrame:
    """Adds ``era`` (resets so far) and the distinct kinds of each era: what a reset forgets."""
    era = running(events, [key], order, era=total(F.when(resets, 1).otherwise(0).cast("long")))
    return era.groupBy(key, "era").agg(F.array_sort(F.collect_set(kind)).alias("kinds"), F.count("*").alias("n_events"))


def merged(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end, n): stretches of whole numbers that overlapping or touching intervals [start, end] of a key cover, and how many do.

    An interval opens a stretch where it starts beyond the greatest end so far, a running
    value that carries over any number of tasks. Intervals that end before they start, or
    have a null end, cover nothing.
    """
    used = rows.select(key, F.col(start).alias("__start"), F.col(end).alias("__end")).where("__start <= __end")
    reach = running(used, [key], ["__start", "__end"], __reach=greatest(F.col("__end"), before=True))
    opens = F.coalesce(F.col("__start") > F.col("__reach") + 1, F.lit(True))
    named = running(reach.withColumn("__opens", opens.cast("long")), [key], ["__start", "__end", "__reach"], __stretch=total(F.col("__opens")))
    return named.groupBy(key, "__stretch").agg(F.min("__start").alias(start), F.max("__end").alias(end), F.count("*").alias("n")).drop("__stretch")


def covered_length(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, length): how many whole numbers the intervals of a key cover; each adds what lies beyond the greatest end so far."""
    used = rows.select(key, F.col(start).alias("__start"), F.col(end).alias("__end")).where("__start <= __end")
    reach = running(used, [key], ["__start", "__end"], __reach=greatest(F.col("__end"), before=True))
    added = F.greatest(F.lit(0).cast("long"), F.col("__end") - F.greatest(F.col("__start") - 1, F.col("__reach")))
    return reach.groupBy(key).agg(F.sum(added).alias("length"))


def by_prefix(names: DataFrame, prefixes: DataFrame, name: str, prefix: str, sep: str = "/") -> DataFrame:
    """Names that equal a prefix or continue it after ``sep``, by an equi-join on every leading part.

    A name has as many leading parts as it has parts, so the join needs no comparison
    of all pairs.
    """
    parts = F.split(name, f"[{sep}]")
    leading = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), sep))
    exploded = names.withColumn("__prefix", F.explode(leading))
    return exploded.join(prefixes, F.col("__prefix") == F.col(prefix)).drop("__prefix")


def set_comparison(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """One row: sizes, both differences, and whether both sets are the same."""
    e = expected.select(key).distinct().withColumn("__e", F.lit(1))
    f = found.select(key).distinct().withColumn("__f", F.lit(1))
    both = e.join(f, key, "full")
    missing, extra = F.count_if(F.col("__f").isNull()), F.count_if(F.col("__e").isNull())
    return both.agg(F.count("__e").alias("n_expected"), F.count("__f").alias("n_found"), missing.alias("n_missing"), extra.alias("n_extra"), ((missing == 0) & (extra == 0)).alias("same"))


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first in a total order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__k", rank).where(F.col("__k") == 1).drop("__k")


EMPTY_AT_ONCE = 500


def containing(docs: DataFrame, needles: DataFrame, key: str, text: str, needle_key: str, needle: str) -> DataFrame:
    """(needle_key, key) of texts that contain a needle.

    A needle's inner words, those with a space on both sides, must be words of any
    text that contains it; the one in the fewest texts is an equi-join key, and
    candidates are then checked. A needle without an inner word is keyed by its
    rarest run of up to three characters instead. Nothing is compared with every text
    but the empty needle, which all contain.
    """
    source = needles.select(F.col(needle_key).alias("__name"), F.coalesce(F.col(needle), F.lit("")).alias("__needle"))
    inner = F.filter(F.slice(F.split("__needle", " "), 2, F.greatest(F.size(F.split("__needle", " ")) - 2, F.lit(0))), lambda w: w != "")
    width = F.least(F.length("__needle"), F.lit(3))
    grams = lambda whole, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(whole) - n + 1), lambda i: F.substring(whole, i, n)))
    by_word = F.size(inner) > 0
    keyed = stored(source.where("__needle <> ''").select("*", F.when(by_word, 0).otherwise(width).alias("__kind"), F.explode(F.when(by_word, F.array_distinct(inner)).otherwise(grams(F.col("__needle"), width))).alias("__part")))
    kinds = sorted(r[0] for r in keyed.select("__kind").distinct().collect())
    whole = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).where(F.col(text).isNotNull())
    parts = None
    for kind in kinds:
        cut = F.array_distinct(F.split("__text", " ")) if kind == 0 else F.when(F.length("__text") >= kind, grams(F.col("__text"), F.lit(kind)))
        each = whole.select("__key", F.lit(kind).alias("__kind"), F.explode(cut).alias("__part"))
        wanted = keyed.where(F.col("__kind") == kind).select("__kind", "__part").distinct()
        each = each.join(wanted, ["__kind", "__part"], "left_semi")
        parts = each if parts is None else parts.unionByName(each)
    out = None
    empty = [r[0] for r in source.where("__needle = ''").select("__name").collect()]  # each has a row for every text
    for at in range(0, len(empty), EMPTY_AT_ONCE):
        named = whole.select(F.explode(F.array(*map(F.lit, empty[at : at + EMPTY_AT_ONCE]))).alias("__name"), "__key")
        out = named if out is None else out.unionByName(named)
    if parts is not None:
        parts = stored(parts)
        often = parts.groupBy("__kind", "__part").agg(F.count("*").alias("__n"))
        rarest = keyed.join(often, ["__kind", "__part"], "left").groupBy("__name", "__needle", "__kind").agg(F.min_by("__part", F.struct(F.coalesce("__n", F.lit(0)), "__part")).alias("__part"))
        near = parts.join(stored(rarest), ["__kind", "__part"]).select("__key", "__name", "__needle")
        found = whole.join(near, "__key").where(F.contains("__text", F.col("__needle"))).select("__name", "__key")
        out = found if out is None else found.union(out)
    out = source.select("__name", F.lit(None).cast(dict(docs.dtypes)[key]).alias("__key")).limit(0) if out is None else out
    return out.distinct().select(F.col("__name").alias(needle_key), F.col("__key").alias(key))
