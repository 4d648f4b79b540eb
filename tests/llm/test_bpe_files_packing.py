import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.llm import bpe, packing, token_files

ODD = ["a", "the", "Ing", "é", "É", "ß", "日本", "<|endoftext|>", " ", "\x1c", "'s", "'ll", "12", "٣", "🎉", "é", "Σ", "İ", "!!", "\t", "\x85", "\xa0", "Ⅻ", "한글", "‍", "<|start", "oftext|>", " ", "\x00", "ſ", "ŉ"]
DOCS = [(1, "Hello World's été 12"), (2, None), (3, ""), (4, " \n\t "), (5, "x" * 5000), (6, "Word word, WORD! " * 900), (6, "Word word, WORD! " * 900), (None, "<|endoftext|>a"), (7, "日本語 é İ")]


@pytest.fixture(scope="module")
def codec():
    return bpe.Encoder()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in DOCS], "doc_id long, text string, n_tokens int, start int")


def library_ids(codec, text):
    return codec.library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=30).map("".join) | st.text(max_size=40))
def test_same_ids_and_text_as_the_library(text):
    codec = bpe.encoder(bpe.VOCABULARY, "transducer")
    ids = codec.encode(text)
    assert ids.tolist() == library_ids(codec, text)
    assert "".join(bpe.Decoder(codec.v).decode([ids], step=3)) == codec.library.decode(ids.tolist(), skip_special_tokens=False)


def test_engines_agree_and_forget(codec):
    small = bpe.Encoder(engine="library", limit=3)
    text = " ".join(f"word{k}ing" for k in range(50)) * 2
    assert small.encode(text).tolist() == codec.encode(text).tolist() == library_ids(codec, text)


def test_transducer_emits_within_its_window(codec):
    pick = random.Random(3)
    tokens = [t for t in codec.v.ids if not t.endswith("</w>")]
    t = bpe.Transducer(codec.v)
    for _ in range(30):
        symbols = [codec.v.ids[c] for c in "".join(pick.choice(tokens) for _ in range(250))]
        assert list(t(symbols)) == bpe.merge(symbols, codec.v.ranks)
    read = 0

    def feed():
        nonlocal read
        for _ in range(10_000):
            read += 1
            yield codec.v.inner[97]

    first = next(iter(t(feed())))
    assert first is not None and read <= t.window


def test_lookahead_of_a_small_list():
    # a+b first, then b+c: whether "bc" forms after "a" depends on one symbol to its left only.
    ranks = {(0, 1): (0, 3), (1, 2): (1, 4)}
    assert bpe.lookahead(ranks, {0: 1, 1: 1, 2: 1, 3: 2, 4: 2}) == 3
    assert bpe.lookahead({}, {0: 1}) == 1


def test_byte_decoder(codec):
    d = bpe.Decoder(codec.v, spaced=False)
    assert "".join(d.decode([np.array([codec.v.inner[b]]) for b in "é".encode()])) == "é"
    assert "".join(d.decode([np.array([codec.v.inner[0xC3]])])) == "�"


def test_encode_decode_frame(spark, docs, codec):
    rows = bpe.encode_decode(docs).collect()
    assert sorted((r["n_tokens"], r["decoded"]) for r in rows) == sorted((len(library_ids(codec, t)), codec.library.decode(library_ids(codec, t), skip_special_tokens=False)) for _, t in DOCS)
    assert bpe.encode_decode(docs.limit(0)).count() == 0


@pytest.mark.parametrize("engine", ["transducer", "library"])
def test_pieces_of_long_texts(engine, monkeypatch):
    codec = bpe.encoder(bpe.VOCABULARY, engine)
    monkeypatch.setattr(bpe, "IDS", 50)
    pick = random.Random(6)
    letters = "abcdefghijklmnop"
    words = ["".join(pick.choices(letters, k=pick.choice((3, 8, 30)))) for _ in range(200)]
    texts = ["", " ", " \n" * 90, " ".join(words), "".join(words), "-".join(words), "x" * 3000 + " y", " " + "Don'T" * 400, "é" * 900 + "日本" * 60, "".join(pick.choices(letters, k=9000))]
    for text in texts:
        for limit in (17, 100, 1 << 20):
            got = list(codec.pieces(text, limit))
            assert np.concatenate([np.empty(0, np.uint32), *got]).tolist() == library_ids(codec, text), (text[:20], limit)
    got = list(codec.pieces(" ".join(words), 100))
    assert max(map(len, got)) <= 100 and len(got) > 10


def test_a_long_text_leaves_the_worker_in_pieces(spark, codec, monkeypatch):
    text = "The quick brown fox, jumps over 12 lazy dogs! " * 300_000
    rows = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.encode_decode(rows, digests=True).collect()}
    ids = library_ids(codec, text[: 46 * 1000])
    assert got[1]["n_tokens"] == len(ids) * 300
    digest = hashlib.sha256(" ".join(map(str, ids * 300)).encode()).hexdigest()
    assert got[1]["ids_sha256"] == digest and got[2]["n_tokens"] == len(library_ids(codec, "short"))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.data())
def test_bit_packing(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=40)), "<u4")
    packed = token_files.pack(ids, bits)
    a = data.draw(st.integers(0, len(ids)))
    assert token_files.unpack(packed, bits, a, len(ids) - a).tolist() == ids[a:].tolist()
    assert len(packed) == -(-len(ids) * bits // 8)


def test_bits():
    assert [token_files.bits_for(n) for n in (0, 1, 2, 3, 256, 257, 49_408)] == [1, 1, 1, 2, 8, 9, 16]


def test_files_round_trip(spark, docs, codec, tmp_path):
    path = f"file://{tmp_path}/files"
    token_files.write_files(docs, path, block_tokens=100)
    rows = token_files.with_global_starts(token_files.read_files(spark, path)).orderBy("start").collect()
    want, at = [], 0
    for doc_id, text in sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = np.array(library_ids(codec, text) + [2], "<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows] == want
    # Random access through the index of one file, in memory and by ranges.
    place = next(p for p in sorted((tmp_path / "files").glob("part-*")) if p.stat().st_size)
    file, remote = token_files.TokenFile(place.read_bytes()), token_files.RemoteFile(spark, f"file://{place}")
    assert len(file) == len(remote) and file.index.tolist() == remote.index.tolist()
    for k in range(len(file)):
        block = file.block(k)
        assert block.ids(0).tolist() == block.ids()[: len(block.ids(0))].tolist()
        assert remote.block(k).ids().tolist() == block.ids().tolist() and remote.block(k).doc_ids == block.doc_ids
    broken = bytearray(place.read_bytes())
    broken[60] ^= 1
    with pytest.raises(ValueError):
        token_files.TokenFile(bytes(broken)).block(0)


def test_files_roll_by_size(spark, tmp_path):
    docs = spark.createDataFrame([(k % 40, f"word{k} and some more of it " * 20) for k in range(400)], "doc_id long, text string")
    path = f"file://{tmp_path}/part-7/files"
    token_files.write_files(docs, path, file_bytes=20_000)
    sizes = [p.stat().st_size for p in (tmp_path / "part-7/files").glob("part-*")]
    assert len(sizes) > 5 and max(sizes) < 20_000
    rows = token_files.with_global_starts(token_files.read_files(spark, path)).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted(k % 40 for k in range(400))
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()


def test_empty_table_of_files(spark, docs, tmp_path):
    token_files.write_files(docs.limit(0), f"file://{tmp_path}/none")
    assert token_files.with_global_starts(token_files.read_files(spark, f"file://{tmp_path}/none")).count() == 0


def best_fit_by_hand(lengths, limits):
    caps = (limits.tokens, limits.documents, limits.attention)
    bins, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = (lengths[i] / caps[0], 1 / caps[1], lengths[i] ** 2 / caps[2])
        best = None
        for k, left in enumerate(bins):
            rest = [a - b for a, b in zip(left, size)]
            if min(rest) >= -1e-12:
                score = -sum(w * r * r for w, r in zip(limits.weights, rest)) if limits.rule == "norm" else sum(w * s * a for w, s, a in zip(limits.weights, size, left))
                if best is None or score > best[0] + 1e-15:
                    best = (score, k)
        if best is None:
            bins.append([1.0, 1.0, 1.0])
            best = (0, len(bins) - 1)
        bins[best[1]] = [a - b for a, b in zip(bins[best[1]], size)]
        out[i] = best[1]
    return out, len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_vector_best_fit_keeps_every_capacity(rule):
    pick = np.random.default_rng(1)
    limits = packing.Limits(tokens=64, documents=5, attention=1500, rule=rule, weights=(1.0, 0.5, 0.5))
    lengths = pick.integers(1, 38, 400)
    bins = packing.vector_best_fit(lengths, limits)
    for b in range(bins.max() + 1):
        inside = lengths[bins == b]
        assert inside.sum() <= 64 and len(inside) <= 5 and (inside**2).sum() <= 1500 and len(inside)
    _, n = best_fit_by_hand(lengths.tolist(), limits)
    assert abs(n - (bins.max() + 1)) <= 1
    with pytest.raises(ValueError):
        packing.vector_best_fit(np.array([60]), limits)


def test_packing_frame(spark, docs, codec):
    rows = packing.pack_documents(docs, packing.Limits(block=4)).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in pieces.values():
        held.sort()
        assert [o for o, _ in held] == np.cumsum([0] + [n for _, n in held[:-1]]).tolist()
        assert sum(n for _, n in held) <= 2048
    want = []
    for doc_id, text in DOCS:
        ids = np.array(library_ids(codec, text) + [0], "<u4")
        want += [(str(doc_id), k, k * 2048, min(2048, len(ids) - k * 2048), zlib.crc32(ids[k * 2048 : (k + 1) * 2048].tobytes())) for k in range(-(-len(ids) // 2048))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    assert packing.pack_documents(docs.limit(0)).count() == 0
    assert rows[0].asDict().keys() >= {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_second_round_fills_up(spark):
    pieces = spark.createDataFrame([(k, 700) for k in range(90)], "doc_id long, length long")
    got = packing.pack_pieces(pieces, packing.Limits(block=10)).agg(F.countDistinct("sequence_id"), F.count("*")).first()
    assert got[1] == 90 and got[0] <= 50


def test_long_texts_are_encoded_a_stretch_at_a_time(monkeypatch):
    codec = bpe.encoder(bpe.VOCABULARY, "library")
    texts = pa.array(["some words of a text " * 40, "", "x" * 300 + " tail", "ends"])
    whole = [codec.encode(t).tolist() for t in texts.to_pylist()]
    in_one = [np.concatenate([np.empty(0, "<u4"), *ids]).tolist() for ids in codec.each_in_pieces(texts)]
    monkeypatch.setattr(bpe, "ARROW_BYTES", 100)
    monkeypatch.setattr(bpe.Encoder.pieces, "__defaults__", (64,))
    cut = [[p.tolist() for p in ids] for ids in codec.each_in_pieces(texts)]
    assert in_one == whole == [sum(parts, []) for parts in cut]
    assert len(cut[0]) > 10


def test_even_pieces_of_parts_of_any_length():
    for sizes in ([], [0], [5], [8], [3, 5, 0, 1], [1] * 17, [20, 4]):
        parts = [np.arange(n, dtype="<u4") for n in sizes]
        flat = np.concatenate([np.empty(0, "<u4"), *parts])
        got = list(packing.evenly(parts, 8))
        assert [p.tolist() for p in got] == [flat[at : at + 8].tolist() for at in range(0, len(flat), 8)]
        assert all(p.dtype == np.dtype("<u4") for p in got)
