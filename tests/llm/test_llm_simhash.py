"""SimHash and its components against brute force."""

import random
import re

import llm_data
import pytest
import xxhash

from spectrabatch.llm import simhash
from spectrabatch.session import ship_package


def slow_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints, distance=2):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_bit_by_bit():
    texts = [r[1] for r in llm_data.rows()] + ["A b\x0bC\x0cd", "one two", "Ünï Ü", "a\x1cb c d"]
    assert [simhash.fingerprint(t) for t in texts] == [slow_print(t) for t in texts]


@pytest.mark.parametrize("key_limit", [0, 1, 8, 1000])
def test_components_of_dense_and_sparse_prints(spark, key_limit):
    """Chains, stars and families; ``key_limit`` 0 sends all through the neighbours, 1000 all through the pairs."""
    ship_package(spark)
    rng = random.Random(7)
    prints = {0, 1, 3, 7, 15, (1 << 64) - 1}
    for _ in range(12):
        a = rng.getrandbits(64)
        prints.add(a)
        for _ in range(rng.randrange(25)):
            a ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                a ^= 1 << rng.randrange(64)
            prints.add(a)
    prints = sorted(prints)
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.near_pairs(frame, key_limit=key_limit)).collect()}
    groups = {}
    for p, g in zip(prints, slow_groups(prints)):
        groups.setdefault(g, []).append(signed(p))
    expected = {p: min(g) for g in groups.values() for p in g if len(g) > 1}
    assert found == expected


def test_documents_get_the_smallest_reachable_id(spark):
    ship_package(spark)
    data = llm_data.rows()
    found = simhash.near_duplicates(llm_data.documents(spark)).collect()
    prints = [slow_print(r[1]) for r in data]
    groups = slow_groups(prints)
    least = {g: min((r[0] for r, k in zip(data, groups) if k == g and r[0] is not None), default=None) for g in groups}
    order = lambda rows: sorted(rows, key=str)
    assert order((r["doc_id"], r["fp"], r["component_id"]) for r in found) == order((r[0], signed(p), least[g]) for r, p, g in zip(data, prints, groups))


def test_one_document_of_each_component_stays(spark):
    ship_package(spark)
    docs = llm_data.documents(spark)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    data = llm_data.rows()
    groups = slow_groups([slow_print(r[1]) for r in data])
    kept_ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda i: (i is None, i or 0))
    least = sorted({min((r[0] for r, k in zip(data, groups) if k == g and r[0] is not None), default=None) for g in set(groups)}, key=lambda i: (i is None, i or 0))
    assert kept_ids == least


def test_one_row_stays_where_doc_ids_do_not_tell_rows_apart(spark):
    ship_package(spark)
    first, second, third = (llm_data.prose(random.Random(i), 60) for i in (11, 12, 13))
    texts = [(5, first), (5, first + " "), (5, second), (9, first), (None, third), (None, third + " "), (None, third), (None, second)]
    docs = llm_data.documents(spark, [(i, t, "en", f"s{n}", len(t)) for n, (i, t) in enumerate(texts)])
    kept = sorted(((r["doc_id"], r["text"].strip()) for r in simhash.keep_first(docs).collect()), key=str)
    assert kept == sorted([(5, first), (5, second), (None, third)], key=str)


def test_empty_table(spark):
    ship_package(spark)
    assert simhash.near_duplicates(llm_data.empty(spark)).count() == 0
    assert simhash.keep_first(llm_data.empty(spark)).count() == 0
