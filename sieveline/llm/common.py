"""Session, storage and null-handling helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = 4000
ARROW_BYTES = 5 << 20
"""Greatest rows and bytes of one Arrow batch of whole texts; a longer text is a batch alone."""

_TABLES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_LOCAL: dict[str, str] = {}
_FOLDERS: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named parquet table, pruned to ``columns`` when any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers.

    Spark reads these two settings when a plan runs, so they stay set. All
    operators set the same values: which plan was built last changes nothing.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, named in ``spark.checkpoint.dir``.

    Where that is unset a session on one machine gets a temporary folder; on a
    cluster this is an error, because executors would not see each other's files.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[[^-\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that they share")
        named = _LOCAL.setdefault(context.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="sieveline-")
        _LOCAL[context.applicationId] = named
    return named.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def new_path(spark: SparkSession, what: str) -> str:
    """A path in this application's part of the shared folder, which is deleted when the driver ends."""
    folder = f"{shared_dir(spark)}/sieveline-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        fs, hadoop_path = _file_system(spark, folder)
        fs.mkdirs(hadoop_path)
        fs.deleteOnExit(hadoop_path)
        _FOLDERS.add(folder)
    return f"{folder}/{what}-{uuid.uuid4().hex}"


def persist(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: lost executors cost no recomputation of Python
    stages, and readers get column pruning and size statistics.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _TABLES[out] = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete tables that `persist` wrote and that nothing will read again; others stay."""
    for df in tables:
        path = _TABLES.pop(df, None) if df is not None else None
        if path:
            fs, hadoop_path = _file_system(df.sparkSession, path)
            fs.delete(hadoop_path, True)


def quoted(name: str) -> str:
    """A column name as Spark parses it back, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def text_or_empty(column: str = "text") -> Column:
    """The text column with null read as empty."""
    return F.coalesce(F.col(quoted(column)), F.lit(""))


ROW_KEY = ["__file", "__row"]
"""Columns that tell rows apart even where ids are null or repeated."""


def positional(docs: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """``columns`` (all by default) as ``c0``, ``c1``, ...: no name of theirs can clash with an operator's own."""
    return [F.col(quoted(name)).alias(f"c{k}") for k, name in enumerate(docs.columns if columns is None else columns)]


def restored(df: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """The positional columns under their own names again, and ``more`` of ``df``."""
    return df.select(*[F.col(f"c{k}").alias(name) for k, name in enumerate(columns)], *more)


def with_row_key(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Positional columns and a key that names the same row on every read.

    Rows of parquet files have one already: file and position. Other inputs are
    written to the shared folder first.
    """
    columns = docs.columns if columns is None else columns
    file, row = F.xxhash64("_metadata.file_path").alias(ROW_KEY[0]), F.col("_metadata.row_index").alias(ROW_KEY[1])
    if "_metadata" not in [name.lower() for name in docs.columns]:
        try:
            keyed = docs.select(*positional(docs, columns), file, row)
            keyed.schema  # noqa: B018  analysis happens here
            return keyed
        except AnalysisException:
            pass
    stored = persist(docs.select(*positional(docs, columns)), "rows")
    return stored.select("*", file, row)
