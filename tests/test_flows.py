"""Reports in ordered files and tool output over streams."""

import json
from pathlib import Path

from conftest import SF
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThan, StringEndsWith

from sieveline.operators import checks, sharded
from sieveline.operators.storage import shared_folder
from sieveline.plans import flows, reporting
from sieveline.sources import gcov, logs
from sieveline.streaming import runs


def joined(spark, path):
    files = {}
    for r in spark.read.text(path).select("_metadata.file_name", "value").collect():
        files.setdefault(r[0], []).append(r[1])
    return "".join(text for name in sorted(files) for text in files[name]), len(files)


def test_joined_files_are_the_report(spark, tmp_path):
    findings = reporting._findings(spark, SF)
    suite = reporting._checks(findings)
    sharded.write(sharded.fragments(suite, findings, "chk", ["target"]), f"{tmp_path}/report", 7)
    text, n_files = joined(spark, f"{tmp_path}/report")
    assert text == checks.suite_json(suite, findings, "chk").first()["json"]
    assert n_files > 1
    rows = sharded.manifest(spark, f"{tmp_path}/report").collect()
    assert sum(r["n_chars"] for r in rows) == len(text) and len(rows) == n_files


def test_reports_of_little(spark, tmp_path):
    kinds = "chk string, status string, required boolean, evidence string"
    findings = spark.createDataFrame([("b", 2, 'FA"IL\n'), ("b", 1, None), ("zz", 1, "PASS")], "chk string, target long, status string")
    for name, rows in (("none", []), ("some", [("a", "PASS", True, "MEASURED"), ("b", "FAIL", False, "MEASURED")])):
        sharded.write(sharded.fragments(spark.createDataFrame(rows, kinds), findings, "chk", ["target"]), f"{tmp_path}/{name}", 3)
        found = json.loads(joined(spark, f"{tmp_path}/{name}")[0])
        assert [c["chk"] for c in found["results"]] == [r[0] for r in rows]
    assert found["results"][0]["targets"] == [] and found["results"][1]["targets"] == [{"target": 1}, {"target": 2, "status": 'FA"IL\n'}]


LINES = ["plain", "   | before", "warning: one", "  more", "odd", "\tagain", "a.c:3: error: bad", "   | after", "", "warning: two", "warning: three", " of it"]


def test_streamed_runs_equal_the_batch(spark, tmp_path):
    logs_df = spark.createDataFrame([(k, "\n".join(LINES[k:])) for k in range(6)], "run long, log string")
    rows = [(k, n + 1, raw) for k in range(6) for n, raw in enumerate(LINES[k:])]
    schema = "run long, line_no long, raw string"
    for at in ([r for r in rows if r[1] <= 3], [r for r in rows if 3 < r[1] <= 8], [r for r in rows if r[1] > 8] + [(k, None, None) for k in range(5)]):
        spark.createDataFrame(at, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = runs.judged(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination()
        assert query.exception() is None
    out = spark.read.parquet(f"{tmp_path}/out")
    got = out.where("part <> 'block'").select("run", "line_no", "part").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, logs.diagnostics(logs_df, "run").select("run", "line_no", "part").collect()))
    blocks = out.where("part = 'block'").select("run", "block", "message").collect()
    want = logs.warning_blocks(logs_df, "run")
    # Run 5 has not ended, so its last block is still open.
    last = want.groupBy("run").agg(F.max("block").alias("b")).where("run = 5").first()["b"]
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, want.where(~((F.col("run") == 5) & (F.col("block") == last))).collect()))


REPORTS = {"src/a.gcov": "        -:    0:Source:a.c\n        3:    1:x\n    #####:    2:y\nbranch  0 taken 1\n       2*:    3:z\n    =====:    4:e\n        0:    5:n\n", "src/b.gcov": "    #####:   10:q\n" * 7, "src/_skip.gcov": "        1:    1:x\n", ".hid/c.gcov": "        1:    1:x\n", "lib/d.gcov": "", "lib/e.gcov": "odd\n\xff:\n"}


def test_gcov_source(spark, tmp_path):
    for name, text in REPORTS.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text, encoding="latin-1")
    gcov.register(spark)
    rows = spark.read.format("gcov").load(f"file://{tmp_path}")
    got = sorted((r["path"].removeprefix(f"{tmp_path}/"), r["number"], r["hit"], r["missed"]) for r in rows.collect())
    assert got == [("src/a.gcov", 1, True, False), ("src/a.gcov", 2, False, True), ("src/a.gcov", 3, True, False), ("src/a.gcov", 4, False, False), ("src/a.gcov", 5, False, False)] + [("src/b.gcov", 10, False, True)] * 7
    assert spark.read.format("gcov").load(f"file://{tmp_path}/none").collect() == []


def test_gcov_many_reports_in_a_file(spark, tmp_path):
    (tmp_path / "all.gcov").write_text("        1:    9:x\n        -:    0:Source:a b.c\n        1:    1:x\n        -:    0:Graph:a.gcno\n    #####:    2:y\n        -:    0:Source:b.c\n        -:    1:z\n        4:    2:y\n")
    gcov.register(spark)
    rows = spark.read.format("gcov").load(f"file://{tmp_path}").collect()
    assert [(r["source"], r["number"], r["missed"]) for r in rows] == [(None, 9, False), ("a b.c", 1, False), ("a b.c", 2, True), ("b.c", 2, False)]


def test_gcov_query_writes_few_files(spark):
    before = set(Path(shared_folder(spark).removeprefix("file://")).glob("gcov-*"))
    assert flows.q_gcov_source(spark, SF).count() > 4
    (made,) = set(Path(shared_folder(spark).removeprefix("file://")).glob("gcov-*")) - before
    assert len(list(made.rglob("part-*"))) <= 4


def test_gcov_filters_leave_files_closed(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.gcov").write_text("        1:    1:x\n" * 3)
    reader = gcov.GcovReader({"path": f"file://{tmp_path}", "partitionBytes": "40"})
    assert [len(p.paths) for p in reader.partitions()] == [1, 1, 1]
    rest = GreaterThan(("number",), 3)
    assert list(reader.pushFilters([StringEndsWith(("path",), "b.gcov"), rest])) == [rest]
    assert [p.paths for p in reader.partitions()] == [[f"{tmp_path}/b.gcov"]]
    (tmp_path / "a.gcov").chmod(0)
    gcov.register(spark)
    rows = spark.read.format("gcov").load(f"file://{tmp_path}").where("path LIKE '%b.gcov'")
    assert rows.count() == 3
