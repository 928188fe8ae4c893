"""Token-ID files and packing: ids against the tokenizer, round trips, exact fills."""

import random
import zlib
from array import array
from collections import Counter

import llm_data
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spectrabatch.llm import id_files, packing
from spectrabatch.llm.tokens import Encoder
from spectrabatch.session import scratch_dir, ship_package

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def ids_of(path, text):
    return Encoder(path).tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_give_the_tokenizers_ids(path):
    rng = random.Random(1)
    odd = ["", "\n", "a\n\nb  c   \td", "It's 'tis DON'T 'S", "<|endoftext|> x", "é K İstanbul ΣΑΣ", "日本語", "12½ ²³ µ", "a\x85b\xa0c  \xa0 d", "\x1c\x1d x", "\x00", "ªº", "😀👍🏽", "x" * 5000, "&&&***  \n"]
    odd += ["".join(chr(rng.randrange(256)) for _ in range(50)) for _ in range(200)]
    encode = Encoder(path)
    assert [t for t in odd if encode(t) != encode.whole(t)] == []


@pytest.mark.parametrize("path, added", [(BYTE, {50256}), (WORD, {49406, 49407})])
def test_added_tokens_have_the_ids_of_an_unaltered_tokenizer(path, added):
    plain, encode = Tokenizer.from_file(path), Encoder(path)
    odd = ["end <|endoftext|> start", "<|endoftext|>", "a<|endoftext|><|endoftext|>b é", "<|startoftext|>word <|endoftext|>", "日本 <|endoftext|> <|startoftext|>", "<|ENDOFTEXT|> <|endoftext|", "none"]
    got = [list(array("I", encode(t))) for t in odd]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in odd]
    assert added <= {i for ids in got for i in ids}


@pytest.mark.parametrize("width", [1, 3, 8, 13, 16, 17, 25, 32])
def test_bits_round_trip(width):
    rng = np.random.default_rng(width)
    for count in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 1 << width, count, dtype=np.uint64)
        data = id_files.pack(ids, width)
        assert len(data) == id_files.packed_size(count, width)
        assert (id_files.unpack(data, count, width) == ids).all()
    with pytest.raises(ValueError):
        id_files.pack(np.array([1 << width], dtype=np.uint64), width)


def test_width_is_least():
    assert [id_files.width_of(v) for v in (1, 2, 3, 256, 257, 50_257)] == [1, 1, 2, 8, 9, 16]


def test_files_hold_all_documents_in_order(spark):
    ship_package(spark)
    path = scratch_dir(spark, "test-ids")
    docs = llm_data.documents(spark)
    id_files.write_ids(docs, path, BYTE, block_ids=64, file_chars=5000)
    found = id_files.read_positions(spark, path).collect()
    assert len({r["shard"] for r in found}) > 2
    expected, start = [], 0
    for doc, text, *_ in sorted(llm_data.rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = ids_of(BYTE, text)
        expected.append((doc, start, len(ids), zlib.crc32(array("I", ids).tobytes())))
        start += len(ids)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in found if r["doc_id"] is not None)
    assert got == sorted(e for e in expected if e[0] is not None)
    assert sorted(r["start"] for r in found) == [e[1] for e in expected]


def test_any_id_is_reached_at_random(spark):
    ship_package(spark)
    path = scratch_dir(spark, "test-ids")
    id_files.write_ids(llm_data.documents(spark), path, BYTE, block_ids=50)
    held = id_files.IdFile(bytes(spark.read.format("binaryFile").load(path).filter("length > 0").first()["content"]))
    everything = np.concatenate([ids for _, _, ids in held.documents()])
    assert len(everything) == held.n_ids
    for start, stop in ((0, 1), (49, 51), (0, held.n_ids), (held.n_ids - 3, held.n_ids), (7, 7), (120, 333)):
        assert (held.ids(start, stop) == everything[start:stop]).all()


def test_no_documents_no_rows(spark):
    ship_package(spark)
    path = scratch_dir(spark, "test-ids")
    id_files.write_ids(llm_data.empty(spark), path, BYTE)
    assert id_files.read_positions(spark, path).count() == 0
    assert packing.pack_documents(llm_data.empty(spark), WORD).count() == 0


def test_least_squares_meet_the_conditions():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.random((12, 20)), rng.random(12) * 3 - 1
        x = packing.nnls(a, b)
        gradient = a.T @ (b - a @ x)
        assert (x >= 0).all() and gradient.max() < 1e-6 and abs(gradient[x > 0]).max(initial=0) < 1e-6


def test_plan_stays_within_the_histogram():
    rng = random.Random(2)
    histogram = [0] + [rng.randrange(200) for _ in range(31)]
    used = Counter()
    for way, times in packing.plan(histogram):
        assert sum(way) == 32 and 2 <= len(way) <= 3
        for q in way:
            used[q] += times
    assert all(used[q] <= histogram[q] for q in range(32))
    in_pairs = 32 * (sum(min(histogram[q], histogram[32 - q]) for q in range(1, 16)) + histogram[16] // 2)
    assert sum(q * n for q, n in used.items()) > in_pairs


@pytest.mark.parametrize("window, unit", [(4096, 64), (256, 16)])
def test_pieces_cover_every_id_once_without_padding(spark, window, unit):
    ship_package(spark)
    data = llm_data.rows(count=80)
    found = packing.pack_documents(llm_data.documents(spark, data), WORD, window, unit).toPandas()
    expected = Counter((r[0], len(ids_of(WORD, r[1]))) for r in data)
    ids = {r[0]: ids_of(WORD, r[1]) for r in data if r[0] is not None}
    assert found["length"].sum() == sum(n * k for (_, n), k in expected.items())
    for doc, pieces in found.dropna(subset=["doc_id"]).groupby("doc_id"):
        spans = Counter(zip(pieces["start"], pieces["length"], pieces["ids_crc32"]))
        covered = sorted((s, s + k) for (s, k, _), n in spans.items() for _ in range(n))
        if sum(k for (d, _), k in expected.items() if d == doc) == 1:
            assert covered[0][0] == 0 and covered[-1][1] == len(ids[doc]) and all(a[1] == b[0] for a, b in zip(covered, covered[1:]))
        for s, k, crc in spans:
            assert zlib.crc32(array("I", ids[doc][s : s + k]).tobytes()) == crc
    for _, pieces in found.sort_values("offset").groupby("sequence_id"):
        ends = pieces["length"].cumsum()
        assert (pieces["offset"] == ends - pieces["length"]).all()
        total = int(ends.iloc[-1])
        assert total <= window and total & (total - 1) == 0
