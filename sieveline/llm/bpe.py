"""BPE encoding and decoding as bounded-lookahead streaming transducers.

A merge list decides each token from a bounded stretch of text. `lookahead`
computes that bound from the list itself. `Transducer` reads symbols one at a
time, holds a window of constant size, and emits a token as soon as no further
input can change it. `Decoder` turns ids back into text through an incremental
UTF-8 state machine, so it never holds more than one token and three pending
bytes.

Text is cut at ASCII white space first: no pattern of the vocabulary crosses it,
so each run of other characters encodes alone. Every batch is reduced to its
distinct runs, these to their distinct words, and workers remember the ids of
words in dictionaries of bounded size. Texts longer than ``PIECE`` characters pass
in pieces cut at white space, a run longer than that word by word, and a long word
symbol by symbol; their ids and their decoded text leave in pieces too, so beyond
the text itself memory does not grow with its length. (Only a run of characters
that normalisation may change has to pass whole.)

Edge cases: null and empty texts have no tokens (zero-length ids, the SHA-256
of the empty string); very long runs pass through the constant window; repeated
rows give repeated results; an empty table gives an empty result; columns other
than the id and text are not read.
"""

from __future__ import annotations

import bisect
import codecs
import functools
import hashlib
import itertools
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from sieveline.llm.common import ARROW_BYTES, positional, small_batches, table, text_or_empty

VOCABULARY = "word_bpe_49k.json"
CACHE_WORDS = {"library": 120_000, "transducer": 350_000}
"""Words in each of a worker's two generations of remembered words, about 50 and 140 MB
together; a word that is not remembered costs this module's own engine more."""

PIECE = 1 << 20
"""Characters of a text that are encoded at once."""
IDS = 65_536
"""Ids of a long word that leave at once."""
WHITE = " \t\n\r\x0b\x0c"

_ODD = regex.compile(r"[\x1c-\x1f\x85\xa0\u0180-\U0010ffff]|<\|")
"""What the quick path leaves out: separators and spaces on which libraries
disagree, characters that normalisation may change, and openings of special
tokens. Up to U+017F every other character is already composed and lower-cases
alike in all Unicode versions."""


def vocabulary_path(name: str) -> str:
    """A bare file name is looked up among the installed public vocabularies."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the rest follow from U+0100 on
    in ascending order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens, split pattern and, unless left out, merge ranks of a tokenizers JSON file."""

    def __init__(self, path: str, merges: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path = path
        self.ids: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*self.ids.values(), *self.special.values()]) + 1
        self.tokens: list[str] = [""] * self.size
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = token
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"] if merges else []):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        alphabet = byte_alphabet()
        self.inner = [self.ids[c] for c in alphabet]
        self.last = [self.ids[c + self.suffix] for c in alphabet]
        self.split = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.byte_of = {c: b for b, c in enumerate(alphabet)}
        lengths = self._lengths()
        self.longest = max(lengths.values(), default=1)
        self.lookahead = lookahead(self.ranks, lengths)

    def _lengths(self) -> dict[int, int]:
        """Symbols in each mergeable token."""
        lengths = dict.fromkeys([*self.inner, *self.last], 1)
        for (left, right), (_, made) in self.ranks.items():
            lengths[made] = lengths[left] + lengths[right]
        return lengths


def lookahead(ranks: dict[tuple[int, int], tuple[int, int]], lengths: dict[int, int]) -> int:
    """Symbols beyond a token that can still change it.

    Whether the merge (x, y) takes place depends on y being formed and not being
    broken from its right: a merge (x', y') of better rank may take x', a
    constituent on the right edge of y, before the constituent is consumed inside
    y. That merge depends on y' in the same way. Ranks fall along such a chain, so
    one pass in rank order gives the reach of every merge; the largest reach plus
    one longest token is sufficient.
    """
    made_by: dict[int, tuple[int, int, int]] = {}
    # For a left part: ranks in order, with the greatest reach up to each.
    by_left: dict[int, tuple[list[int], list[int]]] = {}
    greatest = 0
    for (left, right), (rank, made) in sorted(ranks.items(), key=lambda item: item[1][0]):
        beyond, edge, limit = 0, right, rank
        while True:
            found = by_left.get(edge)
            if found and (k := bisect.bisect_left(found[0], limit)):
                beyond = max(beyond, found[1][k - 1])
            if edge not in made_by:
                break
            limit, _, edge = made_by[edge]
        reach = lengths[right] + beyond
        greatest = max(greatest, reach)
        known, best = by_left.setdefault(left, ([], []))
        known.append(rank)
        best.append(max(reach, best[-1] if best else 0))
        made_by.setdefault(made, (rank, left, right))
    return greatest + max(lengths.values(), default=1)


_NEVER = (1 << 62, -1)


def merge(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply the merge list to a short run of symbols: best rank first, leftmost of equals."""
    symbols, get = list(symbols), ranks.get
    pairs = [get(pair, _NEVER) for pair in zip(symbols, symbols[1:])]
    while pairs and (best := min(pairs)) is not _NEVER:
        i = pairs.index(best)
        made = best[1]
        symbols[i : i + 2] = [made]
        del pairs[i]
        if i:
            pairs[i - 1] = get((symbols[i - 1], made), _NEVER)
        if i < len(pairs):
            pairs[i] = get((made, symbols[i + 1]), _NEVER)
    return symbols


class Transducer:
    """Streaming encoder of one word: feed symbols, get tokens that are final.

    The window holds at most twice the lookahead. When it is full its run is
    merged and every token that ends at least one lookahead before the window's
    end is emitted; the rest stays as symbols.
    """

    def __init__(self, vocabulary: Vocabulary, window: int | None = None):
        self.v = vocabulary
        self.lengths = vocabulary._lengths()
        self.ahead = vocabulary.lookahead
        self.window = max(window or 0, 2 * (self.ahead + vocabulary.longest))

    def __call__(self, symbols: Iterable[int]) -> Iterator[int]:
        held: list[int] = []
        for symbol in symbols:
            held.append(symbol)
            if len(held) >= self.window:
                stable = len(held) - self.ahead
                end = 0
                for token in merge(held, self.v.ranks):
                    if end + self.lengths[token] > stable:
                        break
                    end += self.lengths[token]
                    yield token
                held = held[end:]
        yield from merge(held, self.v.ranks)


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[start : start + size]`` that ``which`` names, one after another, and their ends from 0 on."""
    counts = size[which]
    ends = np.r_[0, np.cumsum(counts)]
    kind = np.int32 if max(ends[-1], len(flat)) < 1 << 31 else np.int64
    return flat[np.repeat((start[which] - ends[:-1]).astype(kind), counts) + np.arange(ends[-1], dtype=kind)], ends


class Encoder:
    """Texts to ids. ``engine`` names what encodes a word that is not remembered:
    ``transducer`` is this module's own, ``library`` the tokenizers model. Both give
    the same ids. Words age in two generations, so frequent ones stay remembered.
    """

    def __init__(self, name: str = VOCABULARY, engine: str = "transducer", limit: int | None = None):
        from tokenizers import Tokenizer

        path = vocabulary_path(name)
        self.library = Tokenizer.from_file(path)
        self.limit = limit or CACHE_WORDS[engine]
        own = engine != "library"
        self.v = Vocabulary(path, merges=own)
        self.transducer = Transducer(self.v) if own else None
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.alphabet = byte_alphabet()
        self.compute = self._by_library if engine == "library" else self._by_transducer
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.v.special, key=len, reverse=True))) + ")") if self.v.special else None
        self.words_or_ends = regex.compile(f"{self.v.split.pattern}|\n")

    def _by_library(self, word: str) -> list[int]:
        spelled = word if word.isascii() and word.isalpha() else "".join([self.alphabet[b] for b in word.encode()])
        return [token.id for token in self.library.model.tokenize(spelled)]

    def _symbols(self, word: str) -> Iterator[int]:
        """The symbols of a word, of which only a stretch is in bytes at a time."""
        for at in range(0, len(word) - 1, IDS):
            yield from map(self.v.inner.__getitem__, word[at : min(at + IDS, len(word) - 1)].encode())
        end = word[-1].encode()
        yield from map(self.v.inner.__getitem__, end[:-1])
        yield self.v.last[end[-1]]

    def _by_transducer(self, word: str) -> list[int]:
        return list(self.transducer(self._symbols(word)))

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is not None:
            return ids
        ids = self.older.get(word)
        if ids is None:
            ids = array("I", self.compute(word)).tobytes()
            if len(word) > 200:
                return ids
        if len(self.words) >= self.limit:
            self.older, self.words = self.words, {}
        self.words[word] = ids
        return ids

    def _odd_run(self, run: str) -> bytes:
        """Ids of any run: special tokens first, then the vocabulary's own normaliser and pattern."""
        ids = []
        for part in self.specials.split(run) if self.specials else [run]:
            if self.specials and part in self.v.special:
                ids.append(self.v.special[part].to_bytes(4, "little"))
            elif part:
                for word, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    ids.append(self._word(bytes(self.v.byte_of[c] for c in word).decode()))
        return b"".join(ids)

    def _runs(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the runs in one array, with each run's start and size in it."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), "\n")[0].as_py() + "\n"
        odd = []
        if not len(distinct):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if _ODD.search(joined):
            runs = distinct.to_pylist()
            odd = [k for k, run in enumerate(runs) if _ODD.search(run)]
            apart = [self._odd_run(runs[k]) for k in odd]
            for k in odd:
                runs[k] = ""
            joined = "\n".join(runs) + "\n"
        words = pa.array(self.words_or_ends.findall(joined.lower()), pa.string()).dictionary_encode()
        known = [b"" if word == "\n" else self._word(word) for word in words.dictionary.to_pylist()]
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat, ends = gather(np.frombuffer(b"".join(known), "<u4"), np.cumsum(size) - size, size, which := words.indices.to_numpy())
        stop = ends[1:][which == words.dictionary.index("\n").as_py()]
        start = np.r_[0, stop[:-1]]
        size = stop - start
        if odd:
            size[odd] = np.fromiter(map(len, apart), np.int64, len(apart)) // 4
            start[odd] = len(flat) + np.cumsum(size[odd]) - size[odd]
            flat = np.concatenate([flat, np.frombuffer(b"".join(apart), "<u4")])
        return flat, start, size

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text begins and the last ends."""
        split = pc.ascii_split_whitespace(texts)
        first = split.offsets.to_numpy().astype(np.int64)
        runs = split.flatten().dictionary_encode()
        ids, ends = gather(*self._runs(runs.dictionary), runs.indices.to_numpy())
        del split, runs
        pa.default_memory_pool().release_unused()
        return ids, ends[first - first[0]]

    def encode(self, text: str) -> np.ndarray:
        """Ids of one whole text."""
        return self.encode_batch(pa.array([text], pa.string()))[0]

    def _long_run(self, run: str) -> Iterator[np.ndarray]:
        """Ids of a run without white space, in pieces."""
        if _ODD.search(run):
            yield np.frombuffer(self._odd_run(run), "<u4")
            return
        held: list[bytes] = []
        size = 0
        for match in self.v.split.finditer(run.lower()):
            word = match.group()
            if self.transducer and len(word) > IDS:
                yield np.frombuffer(b"".join(held), "<u4")
                held, size, ids = [], 0, self.transducer(self._symbols(word))
                while some := array("I", itertools.islice(ids, IDS)):
                    yield np.frombuffer(some.tobytes(), "<u4")
                continue
            held.append(self._word(word))
            size += len(held[-1])
            if size >= 4 * IDS:
                yield np.frombuffer(b"".join(held), "<u4")
                held, size = [], 0
        yield np.frombuffer(b"".join(held), "<u4")

    def pieces(self, text: str, limit: int = PIECE) -> Iterator[np.ndarray]:
        """Ids of a text of any length, in pieces; only a stretch of it is encoded at a time."""
        at = 0
        while at < len(text):
            end = min(at + limit, len(text))
            if end < len(text):
                gap = max(text.rfind(c, at, end) for c in WHITE)
                if gap <= at:
                    gap = min((g for c in WHITE if (g := text.find(c, end)) >= 0), default=len(text))
                    stretch, at = text[at:gap], gap
                    yield from self._long_run(stretch.strip(WHITE))
                    continue
                end = gap
            yield self.encode(text[at:end])
            at = end

    def each_in_pieces(self, texts: pa.Array) -> Iterator[Iterable[np.ndarray]]:
        """The ids of each text, in pieces; of a batch that a long text fills, a stretch at a time."""
        if texts.nbytes > 2 * ARROW_BYTES:
            for text in texts:
                yield self.pieces(text.as_py())
            return
        flat, at = self.encode_batch(texts)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            yield [flat[a:b]]


class Decoder:
    """Ids to text: a token's bytes pass one by one through a UTF-8 state machine.

    ``spaced`` joins the tokens' own spelling by single spaces, which is what the
    library does for a vocabulary without a decoder; otherwise byte stand-ins are
    turned back into the bytes they stand for and tokens follow each other directly.
    """

    def __init__(self, vocabulary: Vocabulary, spaced: bool = True):
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        if spaced:
            self.parts = [token.encode() for token in vocabulary.tokens]
            self.gap = b" "
        else:
            self.parts = [bytes(map(vocabulary.byte_of.__getitem__, t)) if all(c in vocabulary.byte_of for c in t) else t.encode() for t in vocabulary.tokens]
            self.gap = b""

    def decode(self, pieces: Iterable[np.ndarray], step: int = 65_536) -> Iterator[str]:
        """Text of ids that come in pieces, in parts of at most ``step`` tokens each."""
        self.machine.reset()
        gap = b""
        for ids in pieces:
            for at in range(0, len(ids), step):
                part = self.gap.join([self.parts[i] for i in ids[at : at + step].tolist()])
                yield self.machine.decode(gap + part)
                gap = self.gap
        yield self.machine.decode(b"", final=True)


@functools.lru_cache(maxsize=4)
def encoder(name: str, engine: str) -> Encoder:
    """One encoder, with what it remembers, for each worker process."""
    return Encoder(name, engine)


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, digests: bool = False) -> DataFrame:
    """Token ids and decoded text of every row, or with ``digests`` their SHA-256.

    Narrow: no shuffle, one pass over the texts.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(*positional(docs, [id_col]), text_or_empty(text_col).alias("text"))
    names = ["c0", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    schema = f"c0 {rows.dtypes[0][1]}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def run(batches):
        codec = encoder(vocabulary, "transducer")
        decoder = Decoder(codec.v)
        decimal = [str(i) for i in range(codec.v.size)]

        for batch in batches:
            counts, first, second = [], [], []
            for pieces in codec.each_in_pieces(batch.column(1)):
                n, ids, digest = 0, hashlib.sha256(), hashlib.sha256()
                kept: list[np.ndarray] = []

                def passing():
                    nonlocal n
                    for piece in pieces:
                        if digests and len(piece):
                            ids.update((" " * bool(n) + " ".join([decimal[i] for i in piece.tolist()])).encode())
                        elif not digests:
                            kept.append(piece.astype(np.int32))
                        n += len(piece)
                        yield piece

                parts = []
                for part in decoder.decode(passing()):
                    if digests:
                        digest.update(part.encode())
                    else:
                        parts.append(part)
                counts.append(n)
                first.append(ids.hexdigest() if digests else np.concatenate([np.empty(0, np.int32), *kept]))
                second.append(digest.hexdigest() if digests else "".join(parts))
            kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(first, kinds[0]), pa.array(second, kinds[1])], names)

    return rows.mapInArrow(run, schema).withColumnRenamed("c0", id_col)


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of ``documents``."""
    return encode_decode(table(spark, sf_dir, "documents", "doc_id", "text"), digests=True)
