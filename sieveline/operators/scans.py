"""Running values along an order, for keys of any size.

A window by key puts all rows of a key into one task. Here rows are dealt by ranges of
(key, order), so a large key spans several ranges; running values are computed within a
range, and what earlier ranges of the same key add up to is carried in. Only the last
key of a range can go on in the next one, so there is at most one carried row for each
range, whatever the number of keys or rows.

Edge cases: null keys are one key and null orders come first; rows that are equal in the
whole order have no defined sequence, so the order given should be total; an empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.storage import stored


@dataclass(frozen=True)
class Running:
    """A value folded over the rows of a key so far, with or without the row itself."""

    how: str
    value: Column
    before: bool = False


def total(value: Column, before: bool = False) -> Running:
    """Sum so far, 0 where there is nothing."""
    return Running("sum", value, before)


def greatest(value: Column, before: bool = False) -> Running:
    """Greatest value so far, null where there is none."""
    return Running("max", value, before)


def latest(value: Column, before: bool = False) -> Running:
    """Last value so far that is not null."""
    return Running("last", value, before)


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    on = left["__part"] == right["__part"]
    for key in keys:
        on = on & left[f"`{key}`"].eqNullSafe(right[f"`{key}`"])
    return on


def running(rows: DataFrame, keys: list[str], order: list[str], **measures: Running) -> DataFrame:
    """Adds a column for each measure, folded along ``order`` within ``keys``."""
    names = rows.columns
    values = {f"__v{k}": m.value for k, m in enumerate(measures.values())}
    dealt = stored(rows.withColumns(values).repartitionByRange(*[F.col(f"`{c}`") for c in [*keys, *order]]).withColumn("__part", F.spark_partition_id()))
    place = F.struct(*[F.col(f"`{c}`") for c in order])

    # Of each range the first and the last key: the only ones that other ranges may hold too.
    key = F.struct(*[F.col(f"`{c}`") for c in keys])
    ends = dealt.groupBy("__part").agg(F.min(key).alias("a"), F.max(key).alias("b")).select("__part", F.explode(F.array_distinct(F.array("a", "b"))).alias("k")).select("__part", "k.*")
    at_ends = dealt.join(F.broadcast(ends), _same(dealt, ends, keys), "left_semi")
    folds = {"sum": lambda v: F.sum(v), "max": lambda v: F.max(v), "last": lambda v: F.max_by(v, F.when(v.isNotNull(), place))}
    summed = at_ends.groupBy("__part", *[F.col(f"`{c}`") for c in keys]).agg(*[folds[m.how](F.col(f"__v{k}")).alias(f"__s{k}") for k, m in enumerate(measures.values())])
    earlier = Window.partitionBy(*[F.col(f"`{c}`") for c in keys]).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    over = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    carried = summed.withColumn("__first", F.row_number().over(Window.partitionBy(*[F.col(f"`{c}`") for c in keys]).orderBy("__part")) == 1)
    carried = carried.select("__part", *[F.col(f"`{c}`") for c in keys], "__first", *[over[m.how](f"__s{k}").over(earlier).alias(f"__c{k}") for k, m in enumerate(measures.values())]).where(~F.col("__first"))

    within = Window.partitionBy("__part", *[F.col(f"`{c}`") for c in keys]).orderBy(*[F.col(f"`{c}`") for c in order])
    spans = {before: within.rowsBetween(Window.unboundedPreceding, -1 if before else 0) for before in (False, True)}
    local = dealt.withColumns({f"__l{k}": over[m.how](f"__v{k}").over(spans[m.before]) for k, m in enumerate(measures.values())})
    joined = local.join(F.broadcast(carried), _same(local, carried, keys), "left")
    zero = F.lit(0).cast("long")
    joins = {
        "sum": lambda local, carry: F.coalesce(local, zero) + F.coalesce(carry, zero),
        "max": lambda local, carry: F.greatest(local, carry),
        "last": lambda local, carry: F.coalesce(local, carry),
    }
    return joined.select(*[local[f"`{c}`"] for c in names], *[joins[m.how](F.col(f"__l{k}"), F.col(f"__c{k}")).alias(name) for k, (name, m) in enumerate(measures.items())])
