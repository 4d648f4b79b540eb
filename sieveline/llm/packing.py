"""Vector best-fit packing of token sequences.

A sequence has three capacities: tokens, documents, and attention cost (the sum
of squared piece lengths). Pieces are taken longest first. Each goes to the open
sequence that every capacity allows and that scores best: by the least weighted
norm of the capacities left after placing it, or by the greatest weighted dot
product of the piece with the capacities left. If none allows it, a new sequence
opens.

The attention cost of a sequence of at most ``tokens`` tokens never exceeds
``tokens`` squared, nor its documents ``tokens``; a caller that sets the other two
capacities lower makes them bind. With the defaults they only weigh, lightly, in
the choice between sequences that all have room: nothing but tokens may cost a
sequence where as few as possible are wanted.

Texts never move: they are encoded where they are read, and only one short row
for each piece (id, start, length, checksum) is dealt evenly into blocks of a
fixed number of pieces. Blocks pack independently, so memory is bounded and no
key can be hot. Sequences that a block leaves under-filled are opened again and
packed together in a second round over all blocks.

Edge cases: null text is empty and holds the end id alone; repeated rows and null
ids are packed like any other row; a longer document is cut into pieces of the
full length with the rest last; an empty table gives no rows; columns other than
the id and text are not read.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.bpe import VOCABULARY, encoder
from sieveline.llm.common import persist, positional, quoted, small_batches, table, text_or_empty

END_ID = 0


@dataclass(frozen=True)
class Limits:
    """Capacities of one sequence, weights of the three dimensions and the rule."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)
    rule: str = "norm"
    block: int = 16_384
    refill_below: float = 0.98


def vector_best_fit(lengths: np.ndarray, limits: Limits) -> np.ndarray:
    """The sequence (0, 1, ...) of each piece. ``lengths`` is at most ``limits.tokens`` each."""
    caps = np.array([limits.tokens, limits.documents, limits.attention], float)
    weights = np.array(limits.weights, float)
    sizes = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], axis=1) / caps
    if (sizes > 1).any():
        raise ValueError("a piece exceeds a capacity of an empty sequence")
    chosen = np.zeros(len(lengths), np.int64)
    left = np.empty((len(lengths), 3))
    name = np.empty(len(lengths), np.int64)
    n_open = made = 0
    widest = 0.0
    least = sizes.min(axis=0) if len(sizes) else caps
    slack = 1e-12
    for count, i in enumerate(np.argsort(-lengths, kind="stable")):
        size = sizes[i]
        at = -1
        if n_open and size[0] <= widest + slack:
            rest = left[:n_open] - size
            fits = (rest >= -slack).all(axis=1)
            if limits.rule == "norm":
                score = np.where(fits, -((rest * rest) @ weights), -np.inf)
            else:
                score = np.where(fits, left[:n_open] @ (weights * size), -np.inf)
            best = int(score.argmax())
            at = best if fits[best] else -1
        if at < 0:
            at = n_open
            left[at], name[at] = 1.0, made
            n_open += 1
            made += 1
        left[at] -= size
        chosen[i] = name[at]
        if (left[at] < least - slack).any():
            n_open -= 1
            left[at], name[at] = left[n_open], name[n_open]
        if size[0] <= 0.5 and count % 64 == 0 or n_open <= 1:
            widest = left[:n_open, 0].max() if n_open else 0.0
        else:
            widest = max(widest, left[at, 0] if at < n_open else 0.0)
    return chosen


def evenly(parts: Iterable[np.ndarray], size: int) -> Iterator[np.ndarray]:
    """Pieces of ``size`` numbers, the last perhaps shorter, of numbers that come in parts of any length."""
    held = np.empty(0, "<u4")
    for part in parts:
        held = np.concatenate([held, part]).astype("<u4") if len(held) else np.asarray(part, "<u4")
        full = len(held) - len(held) % size
        for at in range(0, full, size):
            yield held[at : at + size]
        held = held[full:]
    if len(held):
        yield held


def cut(docs: DataFrame, limits: Limits, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32. Narrow, no shuffle."""
    small_batches(docs.sparkSession)
    size = limits.tokens
    texts = docs.select(*positional(docs, [id_col]), text_or_empty(text_col).alias("text"))

    def run(batches):
        codec, tail = encoder(vocabulary, "library"), np.array([end_id], "<u4")
        for batch in batches:
            rows, piece, length, crc = [], [], [], []
            for k, ids in enumerate(codec.each_in_pieces(batch.column(1))):
                for number, part in enumerate(evenly(itertools.chain(ids, [tail]), size)):
                    rows.append(k)
                    piece.append(number)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
            numbers = np.array(piece, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers), pa.array(numbers.astype(np.int64) * size), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["c0", "piece", "start", "length", "ids_crc32"],
            )

    cut_up = texts.mapInArrow(run, f"c0 {texts.dtypes[0][1]}, piece int, start long, length long, ids_crc32 long")
    return cut_up.withColumnRenamed("c0", id_col)


def pack_round(pieces: DataFrame, blocks: int, limits: Limits, series: int) -> DataFrame:
    """Pack evenly dealt blocks; adds sequence_id, offset and the sequence's fill.

    ``series`` keeps the numbers of different rounds apart.
    """
    names = pieces.columns
    schema = ", ".join(f"{quoted(n)} {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long, __fill double"

    def run(batches):
        task = TaskContext.get().partitionId()
        made = 0
        held, n = [], 0

        def packed():
            nonlocal made, held, n
            whole = pa.Table.from_batches(held).combine_chunks()
            lengths = whole.column(names.index("length")).to_numpy().astype(np.int64)
            bins = vector_best_fit(lengths, limits)
            order = np.lexsort((-lengths, bins))
            ends = np.cumsum(lengths[order])
            first = np.r_[True, np.diff(bins[order]) != 0]
            base = (ends - lengths[order])[first][np.cumsum(first) - 1]
            offset = np.empty(len(lengths), np.int64)
            offset[order] = ends - lengths[order] - base
            fill = np.bincount(bins, lengths)[bins] / limits.tokens
            number = bins + made + (task << 31) + (series << 58)
            made += int(bins.max()) + 1
            held, n = [], 0
            for name, values in (("sequence_id", number), ("offset", offset), ("__fill", fill)):
                whole = whole.append_column(name, pa.array(values))
            return whole.to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
                if n >= limits.block:
                    yield from packed()
        if n:
            yield from packed()

    return pieces.repartition(blocks).mapInArrow(run, schema)


def pack_pieces(pieces: DataFrame, limits: Limits) -> DataFrame:
    """Pack written pieces in two rounds; adds sequence_id and offset."""
    columns = [quoted(c) for c in pieces.columns]
    blocks = max(1, -(-pieces.count() // limits.block))
    once = persist(pack_round(pieces, blocks, limits, 0), "pack")
    if blocks == 1:
        return once.drop("__fill")
    loose = once.where(F.col("__fill") < limits.refill_below).select(*columns)
    again = max(1, -(-loose.count() // limits.block))
    return once.where(F.col("__fill") >= limits.refill_below).unionByName(pack_round(loose, again, limits, 1)).drop("__fill")


def pack_documents(docs: DataFrame, limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Encode, cut and pack every document; one row for each piece."""
    limits = limits or Limits()
    return pack_pieces(persist(cut(docs, limits, id_col, text_col, vocabulary, end_id), "pieces"), limits)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every document into sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
