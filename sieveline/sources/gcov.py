"""Coverage reports as a Spark data source: ``spark.read.format("gcov").load(folder)``.

Rows are (path, line_no, number, hit, missed, source): a line of a report that counts
executions, its place in the file, its source line, whether it ran, and the name in the
last ``Source:`` line above it, as a file may hold many reports one after the other. Reports are planned into
partitions by size, and filters on ``path`` are decided while planning, so reports that
they leave out are never opened. Folders may be anywhere that Arrow's file systems reach.

Edge cases: hidden files and those beginning with an underscore are no reports; lines that
are none of gcov's, branches and lines that no count belongs to give no rows; an empty
folder gives none; ``source`` is null above the first ``Source:`` line of a file; text that is no UTF-8 is replaced.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

SCHEMA = "path string, line_no long, number long, hit boolean, missed boolean, source string"
SCHEMA_NAMES = [field.split()[0] for field in SCHEMA.split(", ")]
PARTITION_BYTES = 64 << 20
LINES = 10_000
_COUNTED = re.compile(r"\s*([^\s:-][^:]*):\s*(\d+)\s*:")
_SOURCE = re.compile(r"\s*-:\s*0:Source:(.*)")
_TIMES = re.compile(r"(\d+)\**")

#: How a filter on ``path`` is decided.
TESTS = {
    EqualTo: lambda path, value: path == value,
    In: lambda path, values: path in values,
    StringStartsWith: str.startswith,
    StringEndsWith: str.endswith,
    StringContains: str.__contains__,
}


class Reports(InputPartition):
    """Paths of the reports that one task reads."""

    def __init__(self, paths: list[str]):
        super().__init__(tuple(paths))
        self.paths = paths


def parsed(line: str) -> tuple[int, bool, bool] | None:
    """(number, hit, missed) of a line that counts executions."""
    found = None if line.startswith("branch") else _COUNTED.match(line)
    if not found:
        return None
    times = _TIMES.fullmatch(found[1].strip())
    missed = found[1].startswith("#")
    return int(found[2]), bool(times and int(times[1]) > 0), missed


class GcovReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.tests: list[tuple[type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in TESTS and tuple(f.attribute) == ("path",) and f.value is not None:
                self.tests.append((type(f), f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.folder)
        out, held, size = [], [], 0
        for info in sorted(store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)), key=lambda i: i.path):
            hidden = any(part[:1] in "._" for part in info.path[len(root) :].strip("/").split("/"))
            if info.type != fs.FileType.File or hidden or not all(TESTS[kind](info.path, value) for kind, value in self.tests):
                continue
            if held and size + info.size > self.most:
                out.append(Reports(held))
                held, size = [], 0
            held.append(info.path)
            size += info.size
        return [*out, *([Reports(held)] if held else [])] or [Reports([])]

    def read(self, partition: Reports) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.folder)
        for path in partition.paths:
            rows: list[tuple] = []
            source = None
            with store.open_input_stream(path) as raw:
                for n, line in enumerate(io.TextIOWrapper(io.BufferedReader(raw), "utf-8", "replace"), 1):
                    found = parsed(line)
                    if found:
                        rows.append((n, *found, source))
                    elif named := _SOURCE.match(line):
                        source = named[1].rstrip()
                    if len(rows) == LINES:
                        yield batch(path, rows)
                        rows = []
            if rows:
                yield batch(path, rows)


def batch(path: str, rows: list[tuple]) -> pa.RecordBatch:
    line_no, number, hit, missed, source = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(line_no, pa.int64()), pa.array(number, pa.int64()), pa.array(hit, pa.bool_()), pa.array(missed, pa.bool_()), pa.array(source, pa.string())], SCHEMA_NAMES)


class GcovSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gcov"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GcovReader:
        return GcovReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known and let filters reach it, without which Spark refuses a reader that takes them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GcovSource)
