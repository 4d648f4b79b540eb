import duckdb
import numpy as np
import pytest
from conftest import SF

import __spark_entry__ as entry
import corpus_pipeline
from sieveline.llm import registry


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sql = con.sql(registry.ORACLES[name])
    columns = list(sql.columns)
    got = sorted(repr([r[c] for c in columns]) for r in registry.QUERIES[name](spark, SF).collect())
    assert got == sorted(repr(list(r)) for r in sql.fetchall())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if k < 3:
            assert docs.columns == columns
            assert docs.exceptAll(before).count() == 0
        counts.append(docs.count())
        if name == "exact_duplicates":
            best = {}
            for r in before.collect():
                best[r["text"]] = max(r["doc_id"], best.get(r["text"], -1))
            assert {r["doc_id"] for r in docs.collect()} == set(best.values())
    kept = {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/2").collect()}
    assert {r["doc_id"] for r in docs.collect()} == kept
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == kept


def test_odd_documents_pass_through(spark):
    clashing = ["__file", "__row", "__lang", "__text", "__share", "node", "group", "c0", "c1", "id", "fp", "h1", "d0", "own", "first", "chunk", "ids", "piece0", "_metadata", "a`b.c"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n.replace('`', '``')}` long" for n in clashing)
    rows = [(1, "der hund und die katze", "de", "s", 1, 0), (1, "der hund und die katze", "de", "s", 1, 0), (2, None, None, None, None, None), (None, "the dog and the cat", "en", None, 0, 0), (3, "", "en", "s", 0, 0), (4, "the dog and the cat " * 3000, "en", "s", 0, 0)]
    for some in (rows, []):
        docs = spark.createDataFrame([r[:5] + (7,) * len(clashing) for r in some], schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = docs.columns
            docs = stage(spark, docs, SF)
            assert k == 3 or docs.columns == columns
        ids = [r["doc_id"] for r in docs.select("doc_id").distinct().collect()]
        assert sorted(ids, key=str) == ([1, 4, None] if some else [])


def test_packed_rows_fit(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in held.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0] + [n for _, n in pieces])[:-1].tolist()
        assert sum(n for _, n in pieces) <= 2048
