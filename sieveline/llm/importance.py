r"""Importance resampling towards a target: documents drawn by bucketed n-gram weights with Gumbel noise.

Features are runs of one to three consecutive words. They meet in a dictionary of
distinct strings: strings are counted, each distinct string is hashed once, its count
is added to its bucket, and a bucket's gain, the logarithm of its share in the target
over its share in the corpus, goes back through the dictionary to the per-document
feature counts. The sum of gains is a document's weight; weight plus Gumbel noise from
its id ranks it, and the highest are drawn, which samples without replacement in
proportion to the exponential of the weights.

A dictionary of all strings has an entry for nearly every run of three words and joins
each document's features to it: 65 million feature rows and over 0.6 GB of disk for 0.17
GB of text, before anything is shuffled. So the dictionary is held for a chunk of
documents (an Arrow batch of at most 5 MB): its strings are counted there, each distinct
one is hashed once, and what Spark adds up over all chunks are the buckets, 10,000 sums
for each task. A second pass builds the chunks' dictionaries again and joins the gains
back through them. No string is shuffled. A string is distinct by the codes of its words,
and its hash goes on from that of the string without its last word.

`weights_by_dictionary` is the form with one dictionary of the whole corpus, a table with
ordinary aggregations and a join on the string; both give the same weights.

Edge cases: a null text has no words; a text without words has no features and weight
0; a null id is hashed as an empty one and comes last among equals; rows repeated under
one id are ranked one by one; an empty target or corpus gives gains from the smoothing
alone; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import persist, quoted, release, small_batches, table
from sieveline.operators.storage import numbered

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
DRAWN = 5
"""Percentage of the documents with enough words that is drawn."""
SEED = "42"
SCALE = 1000
ROWS = 1 << 16
"""Feature rows in one Arrow batch."""

_LOWER = {c: c + 32 for c in range(65, 91)}
_LOWER_BYTES = bytes(_LOWER.get(c, c) for c in range(256))
_BYTES = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    return [] if text is None else _WORD.findall(text.translate(_LOWER))


def features(found: list[str]):
    """All runs of one to ``LONGEST`` words, joined by a space."""
    for n in range(1, LONGEST + 1):
        yield from map(" ".join, zip(*(found[k:] for k in range(n))))


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, doc_id, text): ``row`` tells rows apart even where ids repeat."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(quoted(key)).alias("doc_id"), F.col(quoted(text)).alias("text"))


def feature_counts(docs: DataFrame) -> DataFrame:
    """(row, feature, n) from (row, text): how often a document has a feature. Narrow."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = Counter(features(words(text.as_py())))
                names, often = list(counts), list(counts.values())
                for at in range(0, len(names), ROWS):
                    n = len(names[at : at + ROWS])
                    yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array(names[at : at + ROWS], pa.string()), pa.array(often[at : at + ROWS], pa.int64())], ["row", "feature", "n"])

    return docs.select("row", "text").mapInArrow(run, "row long, feature string, n long")


def dictionary(counts: DataFrame) -> DataFrame:
    """(feature, n, bucket): each distinct string once, with its count and its hash."""
    total = counts.groupBy("feature").agg(F.sum("n").alias("n"))
    return total.withColumn("bucket", (F.crc32(F.encode("feature", "UTF-8")) % BUCKETS).cast("int"))


def bucket_counts(features: DataFrame) -> dict[int, int]:
    """Count by bucket: at most ``BUCKETS`` numbers."""
    return {r["bucket"]: r["n"] for r in features.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(corpus: dict[int, int], target: dict[int, int]) -> list[int]:
    """Gain of each bucket, in thousandths, floored."""
    of, to = sum(corpus.values()), sum(target.values())
    return [math.floor(SCALE * math.log((target.get(b, 0) + 1) * (of + BUCKETS) / ((corpus.get(b, 0) + 1) * (to + BUCKETS)))) for b in range(BUCKETS)]


def weights_by_dictionary(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row, through one dictionary of the whole corpus.

    Documents, their counts and the dictionary are tables; a string that most documents
    have is a heavy key of the join, which adaptive execution splits.
    """
    rows = persist(keyed(docs, key, text), "documents")
    counts = persist(feature_counts(rows), "feature-counts")
    known = persist(dictionary(counts), "dictionary")
    there = dictionary(feature_counts(keyed(target, target.columns[0], text)))
    gain = F.lit(gains(bucket_counts(known), bucket_counts(there)))
    joined = counts.join(known.select("feature", F.get(gain, F.col("bucket")).alias("gain")), "feature")
    summed = joined.groupBy("row").agg(F.sum(F.col("n") * F.col("gain")).alias("weight"), F.sum("n").alias("n_features"))
    n_words = F.when(F.col("n_features") < 3, F.signum("n_features")).otherwise(F.col("n_features") / 3 + 1).cast("long")
    # n words make 3n - 3 features, but one word makes one.
    none = F.lit(0).cast("long")
    full = rows.select("row", "doc_id").join(summed, "row", "left").select("doc_id", F.coalesce("n_features", none).alias("n_features"), F.coalesce("weight", none).alias("weight"))
    return full.select("doc_id", n_words.alias("n_words"), "n_features", "weight")


class Chunk:
    """The dictionary of some documents: distinct features with counts and hashes, and features by code.

    Each list has an array for each length of features; ``codes`` are by the word that a
    feature starts with, -1 where none does, and ``ends`` says where documents' words end.
    """

    def __init__(self, texts: list[str | None]):
        found = [_BYTES.findall(text.encode().translate(_LOWER_BYTES)) if text else [] for text in texts]
        self.n_words = np.array([len(w) for w in found], np.int64)
        self.ends = np.cumsum(self.n_words)
        coded = pa.array([w for ws in found for w in ws], pa.binary()).dictionary_encode()
        known = coded.dictionary.to_pylist()
        spaced = [b" " + w for w in known]
        code = coded.indices.to_numpy().astype(np.int64)
        self.codes, self.counts, self.hashes = [code], [np.bincount(code, minlength=len(known))], [np.fromiter(map(crc32, known), np.int64, len(known))]
        last = np.repeat(self.ends, self.n_words)  # where the document of each word ends
        for n in range(2, LONGEST + 1):
            # Starts of runs of n words: those of n - 1 that have a word of the same document after them.
            starts = np.arange(max(0, len(code) - n + 1))
            starts = starts[starts + n <= last[: len(starts)]]
            before = self.codes[-1][starts]
            key, run_code, counts = np.unique(before * max(1, len(known)) + code[starts + n - 1], return_inverse=True, return_counts=True)
            prefix, word = np.divmod(key, max(1, len(known)))
            hashed = map(crc32, map(spaced.__getitem__, word.tolist()), self.hashes[-1][prefix].tolist())
            spread = np.full(len(code), -1, np.int64)  # by the word that a feature starts with
            spread[starts] = run_code
            self.codes.append(spread)
            self.counts.append(counts)
            self.hashes.append(np.fromiter(hashed, np.int64, len(key)))

    def buckets(self) -> np.ndarray:
        """Features by bucket."""
        return sum(np.bincount(h % BUCKETS, weights=c, minlength=BUCKETS).astype(np.int64) for h, c in zip(self.hashes, self.counts))

    def sums(self, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of features and sum of gains of each document."""
        per_word, n_features = np.zeros(len(self.codes[0]), np.int64), np.zeros(len(self.codes[0]), np.int64)
        for code, hashed in zip(self.codes, self.hashes):
            there = code >= 0
            per_word[there] += gain[hashed % BUCKETS][code[there]]
            n_features += there
        upto = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], self.ends])])
        return upto(n_features), upto(per_word)


def counted_buckets(texts: DataFrame, text: str = "text") -> dict[int, int]:
    """Features of all texts by bucket. A task sends at most ``BUCKETS`` sums."""
    small_batches(texts.sparkSession)

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += Chunk(batch.column(0).to_pylist()).buckets()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    return bucket_counts(texts.select(F.col(quoted(text)).alias("text")).mapInArrow(run, "bucket int, n long"))


def weights(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row, through the dictionaries of chunks. Narrow after the bucket sums."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(np.array(gains(counted_buckets(docs, text), counted_buckets(target, text)), np.int64))
    rows = docs.select(F.col(quoted(key)).alias("doc_id"), F.col(quoted(text)).alias("text"))

    def run(batches):
        for batch in batches:
            chunk = Chunk(batch.column(1).to_pylist())
            n_features, weight = chunk.sums(shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chunk.n_words), pa.array(n_features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, f"doc_id {rows.dtypes[0][1]}, n_words long, n_features long, weight long")


def noise(key: Column, seed: str = SEED) -> Column:
    """Gumbel noise from the id, in thousandths, floored."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def drawn(weighted: DataFrame, percent: int = DRAWN, least: int = LEAST_WORDS) -> DataFrame:
    """Adds ``score`` and ``rank``: from 1 for the drawn, in the order of scores, else null.

    Rows are dealt by ranges of (enough words, score, id) and numbered there, so no
    task ranks all of them.
    """
    scored = persist(weighted.withColumn("score", F.col("weight") + noise(F.col("doc_id"))).withColumn("enough", F.col("n_words") >= least), "scores")
    most = scored.where("enough").count() * percent // 100
    ranked = numbered(scored, [F.desc("enough"), F.desc("score"), F.asc_nulls_last("doc_id")], "place")
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("place") <= most, F.col("place").cast("long")).alias("rank"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and draw of all documents towards the texts of ``benchmark``."""
    docs, target = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    return drawn(weights(docs, target)).select("doc_id", "n_features", "weight", "score", "rank")
