"""Language-model scores by masked pseudo-likelihood.

A small network predicts every token from the two tokens on either side: one
table per position adds up to a hidden layer, and the token is found by a walk
down a binary tree, each turn a logistic unit on the hidden layer, so the
probabilities of all tokens sum to one and a token costs as many turns as its
frequency has bits. The score of a document is the sum of the log-probabilities of
all its tokens, each masked in turn.

Tokens are lower-cased words. Counts of all words of the corpus decide which have
an id of their own: those that occur twice or more, at most ``Shape.words`` of them,
the most frequent. The rest share ids by their shape (first and last characters,
length), and a word among them gets an equal part of its id's probability, as many
as the corpus has such words: no two words are taken for one. The counts also make
the tree, and set its turns so that training starts at the words' frequencies.

Texts become ids once, in a table that training and scoring read. Training covers
every document: each task runs gradient descent in numpy over the documents it
reads and sends the rows of the parameters that it moved, each weighted by how
often; a row's weighted average over all tasks is the model, so a word that few
tasks have seen is not diluted by the others. Sums are of scaled integers, added as
they stream by, so their order does not matter and no task holds more than its
share of one set of parameters. What is gathered grows with the corpus: the counts
with its words, the parameters by up to one set for each task. What the driver
holds and workers receive is one set, at most 5.3 million numbers.

Edge cases: null, empty and blank texts have no tokens, log-probability 0 and no
mean; contexts beyond either end of a document are a padding token; very long
texts are trained on and scored in slices with overlapping contexts; repeated
rows are trained on repeatedly; an empty table gives no rows, and a corpus
without a token the untrained model; columns other than the id and text are not
read, whatever their names.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import persist, positional, release, restored, small_batches, table, text_or_empty

PAD = 2
"""Padding tokens before, between and after documents: the reach of a context."""
HELD_WORDS = 500_000
"""Counts that a task holds before it sends their sums."""


@dataclass(frozen=True)
class Shape:
    """Sizes of the network, and how it is trained. ``words + buckets`` is at most 65,535."""

    words: int = 61_440
    buckets: int = 4_095
    least: int = 2
    hidden: int = 7
    rate: float = 0.15
    batch: int = 1024
    rounds: int = 1
    seed: int = 7
    limit: float = 3.0


def split_words(texts: pa.Array):
    """Lower-cased words between ASCII white space: where each text begins, and the words by dictionary."""
    split = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    first = split.offsets.to_numpy().astype(np.int64)
    words = split.flatten().dictionary_encode()
    return first - first[0], words


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all documents; partial sums leave each task."""
    small_batches(docs.sparkSession)

    def run(batches):
        held: list[pa.Table] = []

        def summed():
            table = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            held.clear()
            return table.select(["word", "n_sum"]).rename_columns(["word", "n"]).combine_chunks().to_batches()

        for batch in batches:
            _, words = split_words(batch.column(0))
            counts = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            full = pa.table([words.dictionary, pa.array(counts.astype(np.int64))], ["word", "n"])
            held.append(full.filter(pc.not_equal(full["word"], "")))
            if sum(len(t) for t in held) > HELD_WORDS:
                yield from summed()
        if held:
            yield from summed()

    return docs.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def bucket_of(word: str, buckets: int) -> int:
    """The shared id of words of one shape: the first character, the last three, the length up to twelve."""
    return zlib.crc32(f"{word[0]}|{word[-3:]}|{min(len(word), 12)}".encode()) % buckets


def buckets_of(words: pa.Array, buckets: int) -> np.ndarray:
    """The same of many words, shape by shape."""
    size = pa.array(np.minimum(pc.utf8_length(words).to_numpy(zero_copy_only=False), 12)).cast(pa.string())
    shapes = pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, 1), pc.utf8_slice_codeunits(words, -3), size, "|").dictionary_encode()
    found = np.array([zlib.crc32(shape.encode()) % buckets for shape in shapes.dictionary.to_pylist()], np.int64)
    return found[shapes.indices.to_numpy()]


def bucket_column(word: Column, buckets: int) -> Column:
    """The same of a column."""
    shape = F.concat_ws("|", F.substring(word, 1, 1), F.when(F.length(word) > 3, F.substring(word, -3, 3)).otherwise(word), F.least(F.length(word), F.lit(12)).cast("string"))
    return (F.crc32(shape.cast("binary")) % buckets).cast("int")


@dataclass
class Tree:
    """For each leaf the turns from it to the root: ``size`` of them from ``start`` on."""

    start: np.ndarray
    size: np.ndarray
    nodes: np.ndarray
    turns: np.ndarray
    bias: np.ndarray

    def turns_of(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of all turns of ``leaves``, how many each leaf has, and where each leaf's begin."""
        size = self.size[leaves]
        ends = np.cumsum(size)
        first = ends - size
        flat = np.repeat(self.start[leaves] - first, size) + np.arange(ends[-1] if len(ends) else 0)
        return flat, size, first


def huffman(counts: np.ndarray) -> Tree:
    """The tree of least expected depth; ``bias`` gives its turns the counts' own odds."""
    n = len(counts)
    heap = [(int(c), k) for k, c in enumerate(np.maximum(counts, 1).tolist())]
    heapq.heapify(heap)
    parent, right = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, bool)
    bias = np.zeros(n - 1, np.float32)
    for node in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = node
        right[j] = True
        bias[node - n] = np.log(b / a)
        heapq.heappush(heap, (a + b, node))
    at, leaf, nodes, turns = np.arange(n), [], [], []
    while len(alive := np.flatnonzero(at < 2 * n - 2)):
        leaf.append(alive)
        nodes.append(parent[at[alive]] - n)
        turns.append(np.where(right[at[alive]], 1, -1))
        at[alive] = parent[at[alive]]
    order = np.argsort(np.concatenate(leaf), kind="stable")
    size = np.bincount(np.concatenate(leaf), minlength=n)
    return Tree(np.cumsum(size) - size, size, np.concatenate(nodes)[order].astype(np.uint16), np.concatenate(turns)[order].astype(np.float32), bias)


@dataclass
class Words:
    """Words to token ids, the tree over them, and the logarithm of how many words share each."""

    frequent: list[str]
    buckets: int
    tree: Tree
    shared: np.ndarray
    @property
    def tokens(self) -> int:
        return len(self.frequent) + self.buckets

    def ids_of(self, words: pa.Array) -> np.ndarray:
        """Ids of words; any id for the empty one."""
        found = pc.index_in(words, pa.array(self.frequent, pa.string()))
        ids = pc.fill_null(found, 0).to_numpy().astype(np.int64)
        rest = np.flatnonzero(found.is_null())
        ids[rest] = len(self.frequent) + buckets_of(words.take(pa.array(rest)), self.buckets)
        return ids.astype(np.uint16)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text begins and the last ends."""
        first, words = split_words(texts)
        ids = self.ids_of(words.dictionary)
        blank = words.dictionary.index("").as_py()
        where = words.indices.to_numpy()
        if blank < 0:
            return ids[where], first
        real = where != blank
        return ids[where[real]], np.r_[0, np.cumsum(real)][first]


def learn_words(docs: DataFrame, text_col: str = "text", shape: Shape = Shape()) -> Words:
    """Count all words of ``docs``, choose those with an id of their own, and build the tree."""
    counts = persist(word_counts(docs, text_col), "word-counts")
    top = counts.where(F.col("n") >= shape.least).orderBy(F.desc("n"), "word").limit(shape.words).collect()
    rest = counts
    if top:
        last = top[-1]
        rest = counts.where((F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & (F.col("word") > last["word"])))
    seen, kinds = np.zeros(shape.buckets, np.int64), np.zeros(shape.buckets, np.int64)
    for row in rest.groupBy(bucket_column(F.col("word"), shape.buckets).alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():
        seen[row["b"]], kinds[row["b"]] = row["n"], row["kinds"]
    release(counts)
    tree = huffman(np.r_[np.array([r["n"] for r in top], np.int64), seen])
    shared = np.r_[np.zeros(len(top)), np.log(np.maximum(kinds, 1))].astype(np.float32)
    return Words([r["word"] for r in top], shape.buckets, tree, shared)


class Network:
    """Parameters, probabilities and gradients of the window network."""

    def __init__(self, tokens: int, tree: Tree, shape: Shape = Shape(), values: list[np.ndarray] | None = None):
        self.tokens, self.tree, self.shape = tokens, tree, shape
        d = shape.hidden
        if values is None:
            context = np.random.default_rng(shape.seed).normal(0, 0.1, (tokens + 1, 4 * d)).astype(np.float32)
            node = np.zeros((tokens - 1, d + 1), np.float32)
            node[:, d] = np.clip(tree.bias, -2 * shape.limit, 2 * shape.limit)
            values = [context, node, np.zeros((1, d), np.float32)]
        self.values = [np.array(v, np.float32) for v in values]

    def hidden(self, stream: np.ndarray) -> np.ndarray:
        """Hidden layer of every position but the ``PAD`` ones at both ends."""
        context, _, bias = self.values
        d, n = self.shape.hidden, len(stream) - 2 * PAD
        around = _rows(context, stream)
        total = around[0:n, 0:d] + around[1 : n + 1, d : 2 * d]
        total += around[3 : n + 3, 2 * d : 3 * d]
        total += around[4 : n + 4, 3 * d :]
        total += bias
        return np.tanh(total, out=total)

    def _walk(self, stream: np.ndarray):
        """Positions with a token and their hidden layers, all turns and what they add up to.

        Dimensions are rows here: numpy is several times as fast along long ones.
        """
        hidden, targets = self.hidden(stream), stream[PAD:-PAD]
        at = np.flatnonzero(targets != self.tokens)
        flat, size, first = self.tree.turns_of(targets[at])
        nodes, turns = _rows(self.tree.nodes, flat), _rows(self.tree.turns, flat)
        # The last column of a node is its bias, that of the hidden layer a one.
        hidden = np.concatenate([_rows(hidden, at).T, np.ones((1, len(at)), np.float32)])
        node = np.ascontiguousarray(_rows(self.values[1], nodes).T)
        found = (np.repeat(hidden, size, axis=1) * node).sum(axis=0)
        found *= turns
        return at, hidden, size, first, nodes, turns, node, found

    def log_probabilities(self, stream: np.ndarray, shared: np.ndarray | None = None) -> np.ndarray:
        """Of every position but the ends; 0 where the token is padding. ``shared`` is taken off each token's."""
        at, _, _, first, _, _, _, found = self._walk(stream)
        out = np.zeros(len(stream) - 2 * PAD, np.float32)
        if len(at):
            out[at] = -np.add.reduceat(np.log1p(np.exp(-found)), first)
            if shared is not None:
                out[at] -= shared[stream[PAD:-PAD][at]]
        return out

    def sums(self, stream: np.ndarray) -> tuple[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Number of tokens, and for each table the rows that occur, how often, and their summed gradients."""
        at, hidden, size, first, nodes, turns, node, found = self._walk(stream)
        n, d = len(at), self.shape.hidden
        if not n:
            return 0, []
        error = turns / (1 + np.exp(found))
        node = node[:d]
        node *= error
        back = np.add.reduceat(node, first, axis=1)
        back *= 1 - hidden[:d] * hidden[:d]
        by_node = np.argsort(nodes, kind="stable")
        some = _rows(nodes, by_node)
        start = np.flatnonzero(np.r_[True, some[1:] != some[:-1]])
        owner = np.repeat(np.arange(n), size)
        moved = np.take(hidden, _rows(owner, by_node), axis=1, mode="clip")
        moved *= _rows(error, by_node)
        node_part = some[start].astype(np.int64), np.diff(np.r_[start, len(some)]), np.add.reduceat(moved, start, axis=1).T.copy()
        # Errors at their positions, with room for contexts that reach beyond the targets.
        placed = np.zeros((d, len(stream) + 2 * PAD), np.float32)
        placed[:, 2 * PAD + at] = back
        by_word = np.argsort(stream, kind="stable")
        words = stream[by_word]
        start = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
        around = np.concatenate([np.add.reduceat(np.take(placed, by_word + PAD + shift, axis=1, mode="clip"), start, axis=1) for shift in (2, 1, -1, -2)])
        context_part = words[start].astype(np.int64), np.diff(np.r_[start, len(words)]), around.T.copy()
        return n, [context_part, node_part, (np.zeros(1, np.int64), np.array([n]), back.sum(axis=1)[None, :])]


def _rows(table: np.ndarray, which: np.ndarray) -> np.ndarray:
    """``table[which]``, several times as fast; ``which`` is within bounds."""
    return np.take(table, which, axis=0, mode="clip")


def windows(stream: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Slices of a padded stream that predict each position once."""
    for at in range(PAD, len(stream) - PAD, size):
        yield stream[at - PAD : min(at + size, len(stream) - PAD) + PAD]


class Trainer:
    """Adaptive gradient ascent over a stream of documents; counts how often each row of a table moved."""

    def __init__(self, net: Network):
        self.net = net
        self.squares = [np.full(v.shape, 1e-8, np.float32) for v in net.values]
        self.moves = [np.zeros(len(v), np.int64) for v in net.values]

    def learn(self, stream: np.ndarray) -> None:
        """Steps over slices of a padded stream."""
        shape = self.net.shape
        for piece in windows(stream, shape.batch):
            n, parts = self.net.sums(piece)
            # Rows that do not occur have no gradient and stay as they are.
            for values, squares, moves, (rows, often, grad) in zip(self.net.values, self.squares, self.moves, parts):
                grad /= n
                total = _rows(squares, rows)
                total += grad * grad
                squares[rows] = total
                grad *= shape.rate
                grad /= np.sqrt(total, out=total)
                grad += _rows(values, rows)
                values[rows] = np.clip(grad, -2 * shape.limit, 2 * shape.limit, out=grad)
                moves[rows] += often


def padded(ids: np.ndarray, ends: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts' ids with padding before, between and after them, and where each text begins."""
    counts = np.diff(ends)
    starts = ends[:-1] + PAD * (np.arange(len(counts)) + 1)
    out = np.full(int(ends[-1]) + PAD * (len(counts) + 1), pad, np.uint16)
    out[np.repeat(starts - ends[:-1], counts) + np.arange(len(ids))] = ids
    return out, starts


def token_ids(docs: DataFrame, keep: list[str], words: Words, text_col: str = "text") -> DataFrame:
    """Positional ``keep`` of every row, and its tokens as two bytes each. Narrow."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(words)
    texts = docs.select(*positional(docs, keep), text_or_empty(text_col).alias("text"))
    width = len(keep)
    names = [*texts.columns[:width], "ids"]
    schema = ", ".join([*[f"{n} {t}" for n, t in texts.dtypes[:width]], "ids binary"])

    def run(batches):
        for batch in batches:
            ids, ends = shared.value.encode(batch.column(width))
            data = pa.py_buffer(ids.astype("<u2").tobytes())
            if 2 * ends[-1] < 1 << 31:
                packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((2 * ends).astype(np.int32).tobytes()), data])
            else:
                packed = pa.array([ids[a:b].astype("<u2").tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], packed], names)

    return texts.mapInArrow(run, schema)


def _ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows in one array, and where each begins and the last ends."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 2
    ends = np.r_[0, np.cumsum(sizes)]
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    data = column.buffers()[2]
    ids = np.frombuffer(data, "<u2", int(ends[-1]), int(offsets[0])) if ends[-1] else np.empty(0, np.uint16)
    return ids, ends


@dataclass
class Scorer:
    """A vocabulary and a trained network."""

    words: Words
    net: Network

    def score(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens and summed log-probability of each text."""
        stream, starts = padded(ids, ends, self.words.tokens)
        counts = np.diff(ends)
        found = [self.net.log_probabilities(piece, self.words.shared) for piece in windows(stream, self.net.shape.batch)]
        total = np.r_[np.zeros(PAD + 1), np.cumsum(np.concatenate(found), dtype=np.float64)] if found else np.zeros(PAD + 1)
        return counts, np.where(counts > 0, total[np.minimum(starts + counts, len(total) - 1)] - total[np.minimum(starts, len(total) - 1)], 0.0)


_SCALE = 1 << 12
_ROWS = 256
"""Rows of a table in one record of what a task sends."""


def _sent(trainer: Trainer) -> Iterator[pa.RecordBatch]:
    """The rows that a task moved, by blocks of a table: block, places, weights, scaled values."""
    for number, (values, moves) in enumerate(zip(trainer.net.values, trainer.moves)):
        rows = np.flatnonzero(moves)
        cuts = np.flatnonzero(np.diff(rows // _ROWS, prepend=-1)) if len(rows) else []
        for some in np.split(rows, cuts)[1:] if len(rows) else []:
            scaled = np.rint(values[some] * _SCALE).astype("<i2")
            record = [[number << 24 | int(some[0]) // _ROWS], [(some % _ROWS).astype("<u2").tobytes()], [moves[some].astype("<i8").tobytes()], [scaled.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(record, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["block", "places", "weights", "scaled"])


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted averages of all blocks that arrive, added as they stream by: block, places, values."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for block, places, weights, scaled in zip(*(column.to_pylist() for column in batch.columns)):
            places, weights = np.frombuffer(places, "<u2"), np.frombuffer(weights, "<i8")
            values = np.frombuffer(scaled, "<i2").reshape(len(places), -1).astype(np.int64)
            if block not in held:
                held[block] = np.zeros(_ROWS, np.int64), np.zeros((_ROWS, values.shape[1]), np.int64)
            held[block][0][places] += weights
            held[block][1][places] += weights[:, None] * values
    for block, (weights, sums) in held.items():
        places = np.flatnonzero(weights)
        values = (sums[places] / (weights[places, None] * float(_SCALE))).astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([places.astype("<u2").tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], ["block", "places", "values"])


def fit(tokens: DataFrame, words: Words, shape: Shape = Shape()) -> Network:
    """The network trained on every row of ``tokens`` (ids): in each round, averages of what the tasks learned."""
    spark = tokens.sparkSession
    small_batches(spark)
    net = Network(words.tokens, words.tree, shape)
    for _ in range(shape.rounds):
        start = spark.sparkContext.broadcast(net)

        def run(batches, start=start, pad=words.tokens):
            trainer = None
            for batch in batches:
                if trainer is None:
                    known = start.value
                    trainer = Trainer(Network(known.tokens, known.tree, known.shape, known.values))
                trainer.learn(padded(*_ids_of(batch.column(0)), pad)[0])
            if trainer:
                yield from _sent(trainer)

        sent = tokens.select("ids").mapInArrow(run, "block int, places binary, weights binary, scaled binary")
        averages = sent.repartition("block").mapInArrow(_averaged, "block int, places binary, values binary")
        net = Network(words.tokens, words.tree, shape, net.values)
        for block, places, values in zip(*(c.to_pylist() for c in averages.toArrow().columns)):
            rows = (block & 0xFFFFFF) * _ROWS + np.frombuffer(places, "<u2")
            net.values[block >> 24][rows] = np.frombuffer(values, "<f4").reshape(len(rows), -1)
    return net


def scored(tokens: DataFrame, scorer: Scorer, keep: int) -> DataFrame:
    """The first ``keep`` columns of ``tokens`` (..., ids), n_tokens, log_prob and mean_log_prob. Narrow."""
    small_batches(tokens.sparkSession)
    shared = tokens.sparkSession.sparkContext.broadcast(scorer)
    names = [*tokens.columns[:keep], "n_tokens", "log_prob", "mean_log_prob"]
    schema = ", ".join([*[f"{n} {t}" for n, t in tokens.dtypes[:keep]], "n_tokens long, log_prob double, mean_log_prob double"])

    def run(batches):
        for batch in batches:
            counts, found = shared.value.score(*_ids_of(batch.column(keep)))
            mean = pa.array(found / np.maximum(counts, 1), mask=counts == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(counts.astype(np.int64)), pa.array(found), mean], names)

    return tokens.mapInArrow(run, schema)


def train(docs: DataFrame, text_col: str = "text", shape: Shape = Shape()) -> Scorer:
    """Vocabulary and network from every document of ``docs``."""
    words = learn_words(docs, text_col, shape)
    tokens = persist(token_ids(docs, [], words, text_col), "token-ids")
    net = fit(tokens, words, shape)
    release(tokens)
    return Scorer(words, net)


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, log_prob, mean_log_prob) of every row. Narrow."""
    found = scored(token_ids(docs, [id_col], scorer.words, text_col), scorer, 1)
    return restored(found, [id_col], "n_tokens", "log_prob", "mean_log_prob")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on all documents and score each of them."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    words = learn_words(docs)
    tokens = persist(token_ids(docs, ["doc_id"], words), "token-ids")
    found = scored(tokens, Scorer(words, fit(tokens, words)), 1)
    return restored(found, ["doc_id"], "n_tokens", "log_prob", "mean_log_prob")
