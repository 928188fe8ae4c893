"""Prefix counts against the library, prefix by prefix."""

import random

import llm_data
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spectrabatch.llm import token_counts
from spectrabatch.llm.token_counts import PrefixCounter, chars_within, pack, prefix_index, tokens_of, tokens_within, unpack
from spectrabatch.session import ship_package

WORD = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter(WORD)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


def every_prefix(library, text):
    return [len(library.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)]


def test_every_prefix_as_the_library_counts_it(counter, library):
    rng = random.Random(3)
    odd = ["", "a", "it's they're we'll 'r 're' !!'re", "don't<|endoftext|>x", "!!<|endoftext|><|startoftext|>é", "<|endof<|endoftext|>text|>", "日本語テキスト😀👍🏽 ok", "x" * 60, "12½ ²³", "  a \n b ", "😂" * 9]
    for _ in range(600):
        letters = rng.choice(["abcdefghijklmnopqrst", "aeinrst '", "thean", "ab'lre !?", "hanowe", "".join(map(chr, range(32, 256))), "日本語éüß aΣ😀"])
        odd.append("".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))))
    assert [t for t in odd if unpack(pack(counter.steps(t))).tolist() != every_prefix(library, t)] == []


def test_words_that_change_length_count_whole(counter, library):
    rng = random.Random(4)
    for text in ["cafés ok", "İstanbul x", "é", "각 x", *("".join(rng.choice("aéİ本 ") for _ in range(12)) for _ in range(100))]:
        found, expected = unpack(pack(counter.steps(text))).tolist(), every_prefix(library, text)
        assert found[-1] == expected[-1]
        spaces = [p for p in range(1, len(text) + 1) if text[p - 1] == " "]
        assert [found[p] for p in spaces] == [expected[p] for p in spaces]


def test_long_words_are_linear_and_wide_changes_are_kept(counter, library):
    for text in ["x" * 300_000, "ab" * 100_000, "é😂" * 50_000, "1" * 200_000]:
        assert unpack(pack(counter.steps(text)))[-1] == len(library.encode(text, add_special_tokens=False).ids)
    wide = np.array([0, 300, -299], np.int32)
    assert unpack(pack(wide)).tolist() == [0, 0, 300, 1]


def test_answers_without_encoding(spark, library):
    ship_package(spark)
    index = prefix_index(llm_data.documents(spark), WORD)
    found = index.select("doc_id", "n_bytes", "n_chars", tokens_of("steps").alias("n"), *[tokens_within("steps", F.lit(k)).alias(f"w{k}") for k in (0, 7, 10**6)], *[chars_within("steps", F.lit(k)).alias(f"c{k}") for k in (-1, 0, 5, 10**6)]).collect()
    texts = {}
    for doc, text, *_ in llm_data.rows():
        texts.setdefault(doc, []).append(text or "")
    assert sorted(len(t) for ts in texts.values() for t in ts) == sorted(r["n_chars"] for r in found)
    for row in found:
        if len(set(texts[row["doc_id"]])) > 1 or len(texts[row["doc_id"]][0]) > 4000:
            continue
        text = texts[row["doc_id"]][0]
        counts = every_prefix(library, text)
        assert (row["n_bytes"], row["n"], row["w0"], row["w7"], row["w1000000"]) == (len(text.encode()), counts[-1], 0, counts[min(7, len(text))], counts[-1])
        assert row["c-1"] is None and row["c1000000"] == len(text)
        for budget in (0, 5):
            assert row[f"c{budget}"] == max(p for p, n in enumerate(counts) if n <= budget)


def test_query_counts_every_row(spark, library):
    ship_package(spark)
    found = token_counts.token_counts(llm_data.documents(spark), WORD, 60).collect()
    expected = [(r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in llm_data.rows()]
    assert sorted(map(str, [(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in found])) == sorted(map(str, expected))
    assert all(r["over_limit"] == (r["n_tokens"] > 60) for r in found) and {r["over_limit"] for r in found} == {True, False}
    assert token_counts.token_counts(llm_data.empty(spark), WORD, 60).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))
