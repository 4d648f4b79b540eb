"""Intermediate tables in the folder that the cluster names in ``spark.checkpoint.dir``, and ranks over them."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_FOLDERS: dict[str, str] = {}
_TABLES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """This application's part of the folder that the cluster names, deleted when the driver ends.

    Only a session on one machine may leave it unset, and gets a temporary one.
    """
    context = spark.sparkContext
    if context.applicationId in _FOLDERS:
        return _FOLDERS[context.applicationId]
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[[^-\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that they share")
        named = "file://" + tempfile.mkdtemp(prefix="sieveline-")
    folder = f"{named.rstrip('/')}/sieveline-core-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(context._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    _FOLDERS[context.applicationId] = folder
    return folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` written and read back: computed once however often it is used, with statistics."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _TABLES[out] = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete tables that `stored` wrote and that nothing will read again; others stay."""
    for df in tables:
        path = _TABLES.pop(df, None) if df is not None else None
        if path:
            hadoop_path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Adds ``name``: the row's place from 1 in a total order.

    Rows are dealt by ranges and counted there; only one row for each range meets in
    one task.
    """
    dealt = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    sizes = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__place", place).join(F.broadcast(sizes), "__part").withColumn(name, F.col("__before") + F.col("__place")).drop("__part", "__place", "__before")
