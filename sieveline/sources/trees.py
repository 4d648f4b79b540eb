"""Source trees: scans with suffix filters and pruning, languages, project types."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import text as T

PYTHON_SUFFIXES = (".py",)
NATIVE_SUFFIXES = (".cpp", ".cc", ".cxx", ".c")
#: Where sources are looked for unless a project says otherwise.
DEFAULT_ROOTS = ("src", "lib", "app", "packages", "python")


def source_files(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(path below root, content, valid) of files with a suffix, hidden directories left out.

    Bytes that are no UTF-8 become replacement characters and clear ``valid``.
    """
    glob = "*{" + ",".join(suffixes) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    below = F.regexp_replace("path", "^" + _root_pattern(root), "")
    out = files.select(F.regexp_replace(below, "^/+", "").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.is_valid_utf8(F.col("content").cast("string")).alias("valid"))
    return out.where(~T.ignored_path(F.col("path")))


def _root_pattern(root: str) -> str:
    """A regular expression for the root as Spark reports it, with or without a scheme."""
    return r"(?:file:)?/*" + re.escape(root.removeprefix("file:").strip("/"))


def source_roots(configured: tuple[str, ...] | None = None) -> tuple[str, ...]:
    """The roots to look in: the defaults, or all that are configured, of which each must be a name below the project."""
    for name in configured or ():
        parts = name.split("/") if isinstance(name, str) else []
        depth = 0
        for part in parts:
            depth += {"..": -1, ".": 0, "": 0}.get(part, 1)
            if depth < 0:
                break
        if not parts or not name or name.startswith("/") or depth < 0:
            raise ValueError(f"not a directory of the project: {name!r}")
    return DEFAULT_ROOTS if configured is None else tuple(configured)


def in_roots(files: DataFrame, roots: tuple[str, ...] = DEFAULT_ROOTS) -> DataFrame:
    """Files under one of the roots with ``root_rank``, the position of the first that has the file."""
    rank = F.lit(None).cast("int")
    for k, root in reversed(list(enumerate(roots, 1))):
        rank = F.when(F.startswith("path", F.lit(root.rstrip("/") + "/")), k).otherwise(rank)
    return files.withColumn("root_rank", rank).where(F.col("root_rank").isNotNull())


def by_path(files: DataFrame) -> DataFrame:
    """Sorted part by part, so a directory's files stand together."""
    return files.orderBy(F.split("path", "/"))


def is_test_path(path: Column) -> Column:
    """Names that test runners pick up."""
    return path.rlike(r"(^|/)(test_[^/]*\.py|[^/]*_test\.py)$") | (path.rlike(r"(^|/)tests/") & path.rlike(r"\.cpp$"))


#: Files that tell a project's type, and how a configuration states it.
NATIVE_FILES, PYTHON_FILES = ("CMakeLists.txt", "Makefile"), ("pyproject.toml", "setup.py")
STATED_TYPE = r"type\s*=\s*[\"']{}[\"']"


def project_type(files: DataFrame, keys: list[str] | None = None, configurations: tuple[str, ...] = ("dev.toml",), roots: tuple[str, ...] = DEFAULT_ROOTS) -> DataFrame:
    """python, cpp or hybrid of all files (path, content), or for each value of ``keys``.

    The first configuration that states a type decides; else the files that are there.
    """
    suffix = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    rooted = F.lit(False)
    for root in roots:
        rooted = rooted | F.startswith("path", F.lit(root + "/"))
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    python = any_of((suffix.isin(*PYTHON_SUFFIXES) & rooted) | F.col("path").isin(*PYTHON_FILES))
    native = any_of(((suffix == ".cpp") & rooted) | F.col("path").isin(*NATIVE_FILES))
    stated = F.lit(None).cast("string")
    for name in reversed(("hybrid", "cpp", "python")):
        stated = F.when(F.col("content").rlike(STATED_TYPE.format(name)), name).otherwise(stated)
    place = F.array_position(F.array(*map(F.lit, configurations)), F.col("path"))
    first = F.min(F.when((place > 0) & stated.isNotNull(), F.struct(place.alias("place"), stated.alias("stated"))))
    kind = F.coalesce(first["stated"], F.when(python & native, "hybrid").when(native, "cpp").otherwise("python"))
    return (files.groupBy(*keys) if keys else files).agg(kind.alias("project_type"))
