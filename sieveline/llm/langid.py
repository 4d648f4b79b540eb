"""Language identification by multilingual mixture inference.

A model holds, for each language, the distribution of character trigrams over a
fixed number of hash buckets, counted over all training rows. A document is a
mixture of languages; expectation-maximisation estimates the proportions that
make its trigrams most likely. The set of languages is chosen by penalised
likelihood: languages enter in the order of their share under the full mixture
for as long as the likelihood gains more than ``penalty * log(trigrams)``. The
predicted language has the largest share in the chosen set; the score is that
share.

Training moves only counts: each task sums trigrams by language and emits one
row for each language and bucket it has seen. The driver and each worker hold
languages x buckets numbers whatever the input size; ``max_languages`` bounds
the first factor, and more labels than that raise an error.

Edge cases: null texts and texts without a letter are ``und`` with score 0, as
is everything when there is nothing to learn from; rows without a label are not
learned from; a null id counts as the empty string for the fold; texts shorter
than a trigram are padded by spaces; very long texts are counted in slices, and
a document never needs more memory than the buckets; repeated rows are learned
from repeatedly; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import persist, positional, quoted, release, restored, small_batches, table

BUCKET_BITS = 15
SLICE = 1 << 20
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@dataclass(frozen=True)
class Settings:
    bits: int = BUCKET_BITS
    smoothing: float = 0.5
    penalty: float = 3.0
    iterations: int = 30
    tolerance: float = 1e-3
    max_languages: int = 512


def trigrams(text: str, bits: int) -> np.ndarray:
    """Bucket of every trigram of code points of a lower-cased stretch."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    mixed = points[:-2] * _MIX[0] + points[1:-1] * _MIX[1] + points[2:] * _MIX[2]
    return mixed >> np.uint32(32 - bits)


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """Stretches of the text between spaces that together have each of its trigrams once."""
    for at in range(0, max(1, len(text)), size):
        yield " " * (at == 0) + text[max(at - 1, 0) : at + size + 1] + " " * (at + size >= len(text))


def training_counts(docs: DataFrame, lang_col: str, text_col: str, bits: int) -> DataFrame:
    """(lang, bucket, n) over all rows with a text and a label. Partial sums leave each task."""
    small_batches(docs.sparkSession)
    labelled = docs.select(F.col(quoted(lang_col)).cast("string").alias("lang"), F.col(quoted(text_col)).alias("text")).dropna()

    def run(batches):
        held: dict[str, np.ndarray] = {}

        def emit():
            for lang, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "bucket", "n"])
            held.clear()

        for batch in batches:
            by: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                by.setdefault(lang, []).extend(trigrams(part, bits) for part in slices(text.as_py()))
            for lang, grams in by.items():
                found = np.bincount(np.concatenate(grams), minlength=1 << bits)
                held[lang] = held[lang] + found if lang in held else found
            if len(held) > 64:
                yield from emit()
        yield from emit()

    return labelled.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Trigram distributions of the learned languages."""

    def __init__(self, languages: list[str], counts: np.ndarray, settings: Settings):
        self.languages, self.settings = languages, settings
        total = counts.sum(axis=1, keepdims=True)
        self.p = ((counts + settings.smoothing) / (total + settings.smoothing * counts.shape[1])).astype(np.float32)

    def _mixture(self, p: np.ndarray, weights: np.ndarray | None, n: int) -> tuple[np.ndarray, float]:
        """Proportions by expectation-maximisation and their log-likelihood."""
        share = np.full(len(p), 1 / len(p), np.float32)
        for _ in range(self.settings.iterations if len(p) > 1 else 0):
            each = 1 / (share @ p)
            new = share * (p @ (each if weights is None else each * weights)) / n
            moved = float(np.abs(new - share).max())
            share = new
            if moved < self.settings.tolerance:
                break
        likelihood = np.log(share @ p)
        return share, float(likelihood.sum(dtype=np.float64) if weights is None else likelihood @ weights)

    def mixture(self, text: str) -> dict[str, float]:
        """The chosen languages and their shares, largest first."""
        buckets = 1 << self.settings.bits
        grams = None
        weights = None
        if len(text) <= buckets:
            grams = trigrams(f" {text} ", self.settings.bits)
            n = len(grams)
        else:
            counts = sum(np.bincount(trigrams(part, self.settings.bits), minlength=buckets) for part in slices(text))
            grams = np.flatnonzero(counts)
            weights = counts[grams].astype(np.float32)
            n = int(counts.sum())
        p = self.p[:, grams]
        price = self.settings.penalty * np.log(max(n, 2))
        share, _ = self._mixture(p, weights, n)
        order = np.argsort(-share, kind="stable")
        chosen, shares, best = order[:1], np.ones(1, np.float32), self._mixture(p[order[:1]], weights, n)[1]
        for size in range(2, len(order) + 1):
            inside, likelihood = self._mixture(p[order[:size]], weights, n)
            if likelihood - price <= best:
                break
            chosen, shares, best = order[:size], inside, likelihood - price
        ranked = np.argsort(-shares, kind="stable")
        return {self.languages[chosen[k]]: float(shares[k]) for k in ranked}

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or not _LETTER.search(text):
            return UNKNOWN, 0.0
        lang, share = next(iter(self.mixture(text).items()))
        return lang, min(1.0, max(0.0, share))


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", settings: Settings | None = None) -> Model:
    """Learn from every row of ``docs`` that has a text and a label."""
    settings = settings or Settings()
    counts = persist(training_counts(docs, lang_col, text_col, settings.bits), "trigrams")
    languages = [r["lang"] for r in counts.select("lang").distinct().orderBy("lang").limit(settings.max_languages + 1).collect()]
    if len(languages) > settings.max_languages:
        raise ValueError(f"more than {settings.max_languages} languages")
    matrix = np.zeros((len(languages), 1 << settings.bits), np.int64)
    place = {lang: k for k, lang in enumerate(languages)}
    for row in counts.toLocalIterator():
        matrix[place[row["lang"]], row["bucket"]] = row["n"]
    release(counts)
    return Model(languages, matrix, settings)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """The ``keep`` columns (all by default) with the predicted language and score. Narrow."""
    keep = docs.columns if keep is None else keep
    return restored(_predicted(docs, model, text_col, keep), keep, F.col("lang").alias(lang_as), F.col("share").alias(score_as))


def _predicted(docs: DataFrame, model: Model, text_col: str, keep: list[str]) -> DataFrame:
    """Positional ``keep`` columns, lang and share."""
    spark = docs.sparkSession
    small_batches(spark)
    width = len(keep)
    rows = docs.select(*positional(docs, keep), F.col(quoted(text_col)).alias("text"))
    names = [*rows.columns[:-1], "lang", "share"]
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes[:-1]) + ", lang string, share double"
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(width)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names)

    return rows.mapInArrow(run, schema)


def fold(id_col: str):
    """crc32 of the id's text modulo 5; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least_share: float = 1 / 3) -> DataFrame:
    """Rows of ``docs`` in which one language has at least ``least_share``; undetermined rows go."""
    columns = docs.columns
    found = _predicted(docs, model, text_col, columns)
    return restored(found.where((F.col("lang") != UNKNOWN) & (F.col("share") >= least_share)), columns)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four of five folds."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = train(docs.where(fold("doc_id") != 0))
    keyed = docs.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "text")
    return predict(keyed, model, keep=["doc_id", "held_out"])
