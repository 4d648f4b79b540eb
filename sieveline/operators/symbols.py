"""Symbol usage: private definitions that nothing refers to, over long tables of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_roots(modules: DataFrame) -> DataFrame:
    """Modules (module, file, root_rank) with one file each: that of the first source root."""
    rank = F.row_number().over(Window.partitionBy("module").orderBy("root_rank", "file"))
    return modules.withColumn("__k", rank).where(F.col("__k") == 1).drop("__k")


def referenced_keys(modules: DataFrame, imports: DataFrame, refs: DataFrame, qualified: DataFrame) -> DataFrame:
    """Distinct (file, name) of definitions that other modules refer to.

    ``imports`` has file, alias, module and name (empty for a plain import),
    ``refs`` file and name, ``qualified`` file and the dotted ref. An import counts
    only where its alias is used. ``from a import b`` means the module ``a.b`` where
    there is one, and then what is reached through it; else the name b of a.
    """
    used = imports.join(refs.select("file", F.col("name").alias("alias")).distinct(), ["file", "alias"], "left_semi")
    targets = modules.select(F.col("module").alias("__module"), F.col("file").alias("target"))
    named = used.where(F.col("name") != "")
    as_module = named.join(targets, F.concat_ws(".", "module", "name") == F.col("__module"), "left")
    parts = qualified.select("file", F.split("ref", r"\.").alias("parts"), F.split("ref", r"\.")[0].alias("alias"))
    reached = as_module.where(F.col("target").isNotNull()).drop("__module")
    through = reached.join(parts, ["file", "alias"]).where(F.size("parts") > 1).select(F.col("target").alias("file"), F.col("parts")[1].alias("name"))
    whole = reached.join(parts.select("file", "alias").distinct(), ["file", "alias"], "left_anti").select(F.col("target").alias("file"), "name")
    plain = as_module.where(F.col("target").isNull()).drop("__module", "target").join(targets, F.col("module") == F.col("__module")).select(F.col("target").alias("file"), "name")
    # ``import a.b`` is reached as a.b.name, ``import a.b as c`` as c.name.
    dotted = used.where(F.col("name") == "").withColumn("__parts", F.split("module", r"\."))
    prefix = F.when(F.col("__parts")[0] == F.col("alias"), F.col("__parts")).otherwise(F.array("alias"))
    dotted = dotted.withColumn("__prefix", prefix).join(parts, ["file", "alias"])
    deep = dotted.where((F.size("parts") > F.size("__prefix")) & (F.slice("parts", F.lit(1), F.size("__prefix")) == F.col("__prefix")))
    deep = deep.join(targets, F.col("module") == F.col("__module")).select(F.col("target").alias("file"), F.expr("parts[size(__prefix)]").alias("name"))
    return through.union(whole).union(plain).union(deep).distinct()


def is_dunder(name: Column) -> Column:
    return F.startswith(name, F.lit("__")) & F.endswith(name, F.lit("__"))


def is_private(name: Column) -> Column:
    """One underscore in front, not two."""
    return F.startswith(name, F.lit("_")) & ~F.startswith(name, F.lit("__"))


def private_usage(defs: DataFrame, refs: DataFrame, exports: DataFrame, keys: DataFrame) -> DataFrame:
    """Private module-level functions with status WARN where nothing refers to them.

    ``defs`` has file, name, line and decorated. Exported and decorated ones are left
    out.
    """
    private = defs.where(is_private(F.col("name")) & ~F.col("decorated"))
    private = private.join(exports.select("file", "name").distinct(), ["file", "name"], "left_anti")
    used = refs.select("file", "name").union(keys.select("file", "name")).distinct().withColumn("__used", F.lit(True))
    found = private.join(used, ["file", "name"], "left")
    return found.select("file", "name", "line", F.when(F.col("__used"), "PASS").otherwise("WARN").alias("status"))
