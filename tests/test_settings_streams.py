import pytest
from pyspark.sql import functions as F

from sieveline.functions import settings
from sieveline.streaming import live


def test_settings_are_closed_and_checked():
    good = {"engines": {"line": {"warn_limit": 5}, "dup": {"fail_pct": 50.0}}, "project": {"source_dirs": ["src", "a/../b"]}, "type": "cpp", "build": {"python": {"entrypoint": "a:b"}}}
    assert settings.validated(good, {"engines": {"line": {"warn_limit": 7}}})["engines"]["line"]["warn_limit"] == 7
    bad = {
        "x": ({"x": 1}, "x is an unknown"), "table": ({"engines": {"line": 3}}, "engines.line must be a table"), "engine": ({"engines": {"new": {"enabled": True}}}, "engines.new is an unknown"), "key": ({"engines": {"dead": {"size": 1}}}, "engines.dead.size is an unknown"),
        "order": ({"engines": {"line": {"warn_limit": 2000}}}, "less than or equal to engines.line.fail_limit"), "nan": ({"engines": {"dup": {"fail_pct": float("nan")}}}, "must be finite"), "switch": ({"engines": {"dup": {"min_window": True}}}, "must be an integer"),
        "least": ({"engines": {"test": {"min_tem_score": -1}}}, "greater than or equal to 0"), "most": ({"engines": {"test": {"min_tem_score": 5.5}}}, "less than or equal to 5"), "mode": ({"engines": {"line": {"mode": "soft"}}}, "must be one of"),
        "out": ({"project": {"source_dirs": ["../x"]}}, "inside"), "empty": ({"project": {"name": " "}}, "non-empty"), "list": ({"engines": {"toolchain": {"tools": ["a", ""]}}}, "non-empty strings"), "type": ({"type": "java"}, "must be one of"),
    }
    for config, said in bad.values():
        with pytest.raises(ValueError, match=said):
            settings.validated(config)
    assert settings.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": 4}) == {"a": {"b": 3, "c": 2}, "d": 4}


def run(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "# a\n\nx\ny"), (2, "x\n" * 9)], "k long, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k long, text string").parquet(f"{tmp_path}/in")
    rows = run(live.line_statistics(stream, "k", ("#",), 1, 5), "line_statistics", "append").orderBy("k").collect()
    assert [(r["code"], r["comment"], r["blank"], r["status"]) for r in rows] == [(2, 1, 1, "WARN"), (9, 0, 0, "FAIL")]
    found = spark.createDataFrame([("2024-01-01 00:01:00", "PASS"), ("2024-01-01 00:02:00", "WARN"), ("2024-01-01 00:11:00", "FAIL")], "ts string, status string").withColumn("ts", F.to_timestamp("ts"))
    found.write.parquet(f"{tmp_path}/findings")
    stream = spark.readStream.schema(found.schema).parquet(f"{tmp_path}/findings")
    rows = run(live.windowed_status(stream), "windowed_status", "complete").orderBy("start").collect()
    assert [(r["n_pass"], r["suite_status"]) for r in rows] == [(1, "WARN"), (0, "FAIL")]
