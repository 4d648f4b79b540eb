"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are additive. A batch of changes
is a table of signed rows: an insert counts +1, a delete -1, and a revised count
is the old row with -1 and the new row with +1. Committing a batch stores only
its own sums, so no total is ever recomputed from documents and nothing that was
committed is rewritten.

A batch is committed by one rename of its finished folder to its name, which
fails where the name is taken. A folder holds a mark of who wrote it, and a
committer counts itself first only if its own mark stands under the name. So of
several committers of one batch exactly one is told that it was first, and a batch
that is sent again, or whose driver died at any point, counts exactly once. Readers
see committed folders only. `compact` lists the folders once and publishes the sum
of just those together with their names, also by one rename, and only then deletes
them; a batch that is committed meanwhile is neither summed nor deleted. Readers
leave out what the newest sum covers, so a driver may die between any two steps.

Tokens are counted by public vocabularies, through the same encoder as the codec;
words and bytes are versions of their own. Texts are encoded where they are read,
and only numbers go on from there.

Edge cases: a null source or language is a group of its own; a null count counts
a document and no tokens; null text has no tokens; texts of any length are counted
in bounded pieces; repeated rows count repeatedly; a group whose documents have all
been deleted is left out; an empty batch can be committed and changes nothing;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.llm.bpe import VOCABULARY, encoder
from sieveline.llm.common import ARROW_BYTES, new_path, persist, positional, quoted, small_batches, table

GROUP = ["source", "lang", "tokenizer"]
SCHEMA = T.StructType([*[T.StructField(c, T.StringType()) for c in GROUP], T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("batches", T.ArrayType(T.StringType()))])


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Rows (source, lang, tokenizer, n_tokens) as inserts (+1) or deletes (-1)."""
    return rows.select(*GROUP, F.col("n_tokens").cast("long").alias("n_tokens"), F.lit(sign).alias("sign"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """A revision: what was counted before goes, what counts now comes."""
    return signed(old, -1).unionByName(signed(new, 1))


class Rollup:
    """Totals under a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        root = self._path(self.path)
        self._fs = root.getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), conf)
        # No options: a rename that fails where the target exists.
        self._plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._fs.mkdirs(self._path(f"{self.path}/batches"))

    def _names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/batches")))

    def _read(self, names: list[str]) -> DataFrame:
        paths = [f"{self.path}/batches/{name}" for name in names]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    @staticmethod
    def _named(df: DataFrame) -> set[str]:
        return {r["b"] for r in df.select(F.explode("batches").alias("b")).distinct().collect()}

    def _live(self) -> tuple[list[str], list[str]]:
        """One listing: the folders that count (the newest sum, and the batches that it does not cover), and all."""
        there = self._names()
        newest = [name for name in there if name.startswith("sum-")][-1:]
        covered = {f"batch-{b}" for b in self._named(self._read(newest))} if newest else set()
        return newest + [name for name in there if name.startswith("batch-") and name not in covered], there

    def batches(self) -> set[str]:
        """Names of all committed batches; their number grows with commits, not with documents."""
        return self._named(self._read(self._live()[0]))

    def _publish(self, sums: DataFrame, name: str) -> bool:
        """Whether this call, and no other, put a folder under ``name``."""
        mark = uuid.uuid4().hex
        staged = f"{self.path}/staged/{mark}"
        target = f"{self.path}/batches/{name}"
        sums.write.parquet(staged)
        self._fs.create(self._path(f"{staged}/_by-{mark}"), False).close()
        try:
            self._context.rename(self._path(staged), self._path(target), self._plain)
        except Py4JJavaError:
            if not self._fs.exists(self._path(target)):
                raise
        # Where a file system checks and renames in two steps, a late folder may land inside the first.
        first = self._fs.exists(self._path(f"{target}/_by-{mark}"))
        for late in () if first else (staged, f"{target}/{mark}"):
            self._fs.delete(self._path(late), True)
        return first

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add the signed ``changes`` under the name ``batch``; False if it had been committed."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        if batch in self.batches():
            return False
        sums = changes.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("n_docs"), F.coalesce(F.sum(F.col("sign") * F.col("n_tokens")), F.lit(0)).cast("long").alias("n_tokens"))
        named = F.array(F.lit(batch)).cast("array<string>").alias("batches")
        # A batch without rows still leaves its name behind.
        marker = self.spark.range(1).select(*[F.lit(None).cast("string").alias(c) for c in GROUP], F.lit(0).cast("long").alias("n_docs"), F.lit(0).cast("long").alias("n_tokens"), named)
        return self._publish(sums.select("*", named).unionByName(marker), f"batch-{batch}")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of all committed batches."""
        sums = self._read(self._live()[0]).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def compact(self) -> None:
        """Replace the stored batches by one sum that holds their names."""
        live, there = self._live()
        if not live:
            return
        stored = self._read(live)
        named = F.array(*map(F.lit, sorted(self._named(stored)))).cast("array<string>").alias("batches")
        sums = stored.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).select("*", named)
        number = 1 + max((int(name.split("-")[1]) for name in there if name.startswith("sum-")), default=0)
        if self._publish(sums, f"sum-{number:012d}"):
            for name in there:
                self._fs.delete(self._path(f"{self.path}/batches/{name}"), True)


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.size(F.regexp_extract_all(text, F.lit(r"([^ \t-\r]+)"), F.lit(1))).cast("long")


def byte_count(text: Column) -> Column:
    """Bytes in UTF-8."""
    return F.octet_length(text).cast("long")


@dataclass(frozen=True)
class Subwords:
    """Ids of a public vocabulary, and with ``end`` one more for the end of each document."""

    vocabulary: str = VOCABULARY
    end: bool = False


#: Tokenizer versions and how each counts; more of them only add rows.
TOKENIZERS: dict[str, Subwords | Callable[[Column], Column]] = {
    "words/1": word_count,
    "bytes/1": byte_count,
    "word_bpe_49k/1": Subwords(),
    "word_bpe_49k/2": Subwords(end=True),
}


def measured(docs: DataFrame, keep: list[str], texts: list[str], tokenizers: dict | None = None) -> DataFrame:
    """Positional ``keep`` of every row, and for the k-th text a struct ``n{k}`` of its count by each tokenizer.

    Narrow, one scan: texts that share words share the work of encoding them.
    """
    small_batches(docs.sparkSession)
    tokenizers = TOKENIZERS if tokenizers is None else tokenizers
    native = {name: count for name, count in tokenizers.items() if not isinstance(count, Subwords)}
    vocabularies = sorted({count.vocabulary for count in tokenizers.values() if isinstance(count, Subwords)})
    plain = [F.coalesce(F.col(quoted(text)), F.lit("")) for text in texts]
    rows = docs.select(*positional(docs, keep), *[native[name](text).alias(f"m{k}_{j}") for k, text in enumerate(plain) for j, name in enumerate(native)], *[text.alias(f"t{k}") for k, text in enumerate(plain)])
    kept = len(rows.columns) - len(texts)
    names = [*rows.columns[:kept], *[f"s{k}_{j}" for k in range(len(texts)) for j in range(len(vocabularies))]]
    schema = ", ".join([*[f"{n} {t}" for n, t in rows.dtypes[:kept]], *[f"{n} long" for n in names[kept:]]])

    def counts(codec, batch) -> list[np.ndarray]:
        columns = batch.columns[kept:]
        if batch.nbytes > 2 * ARROW_BYTES:
            return [np.array([sum(map(len, codec.pieces(text.as_py()))) for text in column], np.int64) for column in columns]
        ends = codec.encode_batch(pa.concat_arrays(columns))[1]
        return np.split(np.diff(ends), len(columns))

    def run(batches):
        for batch in batches:
            found = [counts(encoder(vocabulary, "library"), batch) for vocabulary in vocabularies]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *[pa.array(by[k].astype(np.int64)) for k in range(len(texts)) for by in found]], names)

    done = rows.mapInArrow(run, schema) if vocabularies else rows
    places = {name: j for j, name in enumerate(native)}

    def count(name: str, k: int) -> Column:
        kind = tokenizers[name]
        if not isinstance(kind, Subwords):
            return F.col(f"m{k}_{places[name]}")
        return F.col(f"s{k}_{vocabularies.index(kind.vocabulary)}") + F.lit(int(kind.end))

    return done.select(*[f"c{k}" for k in range(len(keep))], *[F.struct(*[count(name, k).alias(name) for name in tokenizers]).alias(f"n{k}") for k in range(len(texts))])


def as_rows(counts: DataFrame, source: str, lang: str, struct: str, tokenizers: list[str]) -> DataFrame:
    """(source, lang, tokenizer, n_tokens) of the named versions, of a column that `measured` made."""
    each = [F.struct(F.lit(name).alias("tokenizer"), F.col(struct)[name].alias("n_tokens")) for name in tokenizers]
    return counts.select(F.col(source).alias("source"), F.col(lang).alias("lang"), F.explode(F.array(*each)).alias("c")).select("source", "lang", "c.tokenizer", "c.n_tokens")


def counted(docs: DataFrame, tokenizers: dict | None = None, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(source, lang, tokenizer, n_tokens) of every document and tokenizer."""
    tokenizers = TOKENIZERS if tokenizers is None else tokenizers
    return as_rows(measured(docs, [source_col, lang_col], [text_col], tokenizers), "c0", "c1", "n0", list(tokenizers))


def edited(text: Column) -> Column:
    """Text without the digits 0-9, each run of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[0-9]+", ""), r"[ \t-\r]+", " "))


FIRST = ["words/1", "bytes/1", "word_bpe_49k/1"]


def maintained(spark: SparkSession, sf_dir: str, tokenizers: list[str]) -> DataFrame:
    """Totals after a load, a revision, an upgrade, a takedown, and a second delivery of the revision.

    The load inserts every document. The revision recounts every document as
    `edited`. The upgrade moves the subword counts of German documents to the second
    version, which counts an end. The takedown deletes documents labelled toxic, as
    they count by then. ``tokenizers`` are the versions that the load counts.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    toxic = table(spark, sf_dir, "labels", "doc_id", "toxic").where("toxic = 1").select("doc_id").distinct()
    after = docs.withColumn("after", edited(F.col("text")))
    versions = {name: count for name, count in TOKENIZERS.items() if name in tokenizers or name.replace("/2", "/1") in tokenizers}
    counts = persist(measured(after, ["doc_id", "source", "lang"], ["text", "after"], versions), "document-counts")
    rows = lambda df, text, names: as_rows(df, "c1", "c2", text, names)
    moves = [name for name in tokenizers if name.replace("/1", "/2") in versions]
    moved = F.coalesce(F.col("c2") == "de", F.lit(False))
    new = [name.replace("/1", "/2") for name in moves]
    gone = counts.join(toxic, counts["c0"] == toxic["doc_id"], "left_semi")
    rollup = Rollup(spark, new_path(spark, "token-counts"))
    revision = revised(rows(counts, "n0", tokenizers), rows(counts, "n1", tokenizers))
    rollup.commit("load", signed(rows(counts, "n0", tokenizers), 1))
    rollup.commit("revision", revision)
    if moves:
        rollup.commit("upgrade", revised(rows(counts.where(moved), "n1", moves), rows(counts.where(moved), "n1", new)))
    stay = [name for name in tokenizers if name not in moves]
    parts = [rows(gone, "n1", stay)] + ([rows(gone.where(~moved), "n1", moves), rows(gone.where(moved), "n1", new)] if moves else [])
    for part in parts[1:]:
        parts[0] = parts[0].unionByName(part)
    rollup.commit("takedown", signed(parts[0], -1))
    rollup.commit("revision", revision)
    return rollup.totals()


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of words, bytes and subword ids after a series of changes."""
    return maintained(spark, sf_dir, FIRST)


def rollup_words_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same series for the versions that SQL can count."""
    return maintained(spark, sf_dir, FIRST[:2])


ORACLE = r"""
WITH d AS (
  SELECT source, lang, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[0-9]+', '', 'g'), '[ \t-\r]+', ' ', 'g')) AS text FROM documents
  WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND toxic = 1)
), c AS (
  SELECT source, lang, 'words/1' AS tokenizer, CAST(len(regexp_extract_all(text, '[^ \t-\r]+')) AS BIGINT) AS n FROM d
  UNION ALL
  SELECT source, lang, 'bytes/1', CAST(strlen(text) AS BIGINT) FROM d
)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM c GROUP BY ALL
"""
