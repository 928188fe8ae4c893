"""Personal data, Merkle trees, quality, host reputation and mixing on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import llm_data
import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrabatch.llm import host_reputation, merkle, mixing, pii, quality
from spectrabatch.llm.common import first_by_hash
from spectrabatch.session import ship_package

# --- personal data ---

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain_base(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if passes(k, m[0])]


def personal(rng, i):
    card = [rng.randrange(10) for _ in range(15)]
    card = next("".join(map(str, [*card, d])) for d in range(10) if passes("card", "".join(map(str, [*card, d]))))
    spoiled = card[:-1] + str((int(card[-1]) + 3) % 10)
    return f"{llm_data.prose(rng, 12)} write to ana.{i}@mail{i % 9}.example.com or call +1 ({100 + i % 800}) 555-{1000 + i} from 10.{i % 256}.3.4 with {card} not {spoiled} é"


def test_detectors_equal_the_patterns():
    rng = random.Random(2)
    texts = ["".join(rng.choice("0123456789 .-+()@a@b.[at]é") for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += ["a@b@c.d@e.f", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.1", "+1 (017) 555-7713", "4111 1111-1111 1111", "0000000000000"]
    assert [t for t in texts if pii.base_spans(t) != plain_base(t)] == []


@pytest.mark.parametrize("run", ["a", "1", "+1", "1 ", "a@", "1.", "+1(", "a@b.", "("])
def test_long_runs_are_linear(run):
    text = run * (200_000 // len(run))
    pii.base_spans(text), pii.candidates(text)


def test_number_parts_of_any_length_are_read():
    zeros = "0" * 5000
    assert pii.base_spans(f"a {zeros}.1.1.1 b") == [("ip", 2, 5008)]
    assert pii.base_spans(f"a {zeros}255.{zeros}.1.1 b {zeros}256.1.1.1") == [("ip", 2, 2 + 5003 + 1 + 5000 + 4)]
    assert pii.base_spans("9" * 1_000_000 + ".1.1.1") == []


def test_trees_learn_and_the_threshold_holds():
    rng = random.Random(4)
    model = pii.train([personal(rng, i) for i in range(300)])
    assert model and model.threshold <= 1
    held = [personal(rng, 1000 + i) for i in range(100)]
    x, y, _ = pii.examples(held, seed=9)
    chosen = model.trees.probability(x) >= model.threshold
    assert y[chosen].mean() > 0.95 and chosen[y == 1].mean() > 0.8
    base, every = pii.find("reach bob.smith [at] mail3.example.com now", model)
    assert base == [] and ("email", 6, 38) in every
    assert pii.find("In 2021-03-04 they sold 1234 of 98765 parts", model) == ([], [])


def test_all_documents_are_scanned_and_base_spans_stay(spark):
    ship_package(spark)
    rng = random.Random(4)
    data = [*llm_data.rows(), *[(500 + i, personal(rng, i), None, None, None) for i in range(60)]]
    docs = llm_data.documents(spark, data)
    found = pii.scan(docs, pii.fit(docs)).collect()
    digest = lambda spans: hashlib.sha256(pii.joined(spans).encode()).hexdigest()
    got = sorted(((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in found), key=str)
    assert got == sorted(((r[0], *(sum(s[0] == k for s in plain_base(r[1] or "")) for k in PATTERNS), digest(plain_base(r[1] or ""))) for r in data), key=str)
    texts = {r[0]: r[1] or "" for r in data}
    assert all(set(pii.joined(plain_base(texts[r["doc_id"]])).split(",")) <= set(r["spans"].split(",")) for r in found if r["n_ip"])
    empty = llm_data.empty(spark)
    assert pii.fit(empty) is None and pii.scan(empty, None).count() == 0


@pytest.mark.parametrize("count", [100, 2500, 9000])
def test_a_bounded_draw_takes_the_first_by_hash(spark, count):
    rows = spark.range(5000).select("id", F.xxhash64("id").alias("h"))
    expected = sorted((r["h"] & (1 << 64) - 1) >> 1 for r in rows.collect())[:count]
    assert sorted((r["h"] & (1 << 64) - 1) >> 1 for r in first_by_hash(rows, "h", count, "id").collect()) == expected


def test_copies_do_not_fill_the_sample(spark):
    ship_package(spark)
    rng = random.Random(8)
    data = [(i, personal(rng, 7) if i == 0 else None, None, None, None) for i in range(1)] * 900
    data += [(1000 + i, personal(rng, i), None, None, None) for i in range(120)]
    assert pii.fit(llm_data.documents(spark, data), sample=200) is not None


# --- Merkle trees ---


def test_equal_texts_equal_roots_and_edits_are_located():
    rng = random.Random(3)
    text = llm_data.prose(rng, 600)
    lines = text.split("\n")
    assert "".join(merkle.leaves(text.replace("\n", " "))) == text.replace("\n", " ")
    changed = "\n".join([*lines[:20], "something else entirely here", *lines[21:]])
    a, b = merkle.fingerprint(text), merkle.fingerprint(changed)
    assert merkle.fingerprint(text + "") == a != b and merkle.differing(a, a) == []
    assert len(merkle.differing(a, b)) == 1 and 0.9 < merkle.likeness(a, b) < 1
    assert merkle.likeness(a, merkle.fingerprint("")) == 0 and merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("")) == 1
    assert merkle.fingerprint("a\n") != merkle.fingerprint("a") != merkle.fingerprint("a ")


@pytest.mark.parametrize("part_chars", [2000, 10**9])
def test_every_document_meets_its_next(spark, part_chars):
    ship_package(spark)
    data = llm_data.rows()
    found = merkle.compare_next(llm_data.documents(spark), part_chars).collect()
    ordered = sorted(((r[0], r[1] or "") for r in data), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected = []
    for (doc, text), (_, after) in zip(ordered, [*ordered[1:], ordered[0]]):
        changed = merkle.edited(text, after)
        prints = [merkle.fingerprint(t) for t in (text, changed, after)]
        expected.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), prints[0], prints[1], merkle.likeness(prints[0], prints[1]), merkle.likeness(prints[0], prints[2])))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


def test_edit_takes_the_last_half():
    assert merkle.edited("abcde", "XYZ") == "abcXY" and merkle.edited("abcdef", "X") == "abcX" and merkle.edited("", "X") == "" and merkle.edited("a", "X") == "a"


def test_merkle_of_nothing(spark):
    assert merkle.compare_next(llm_data.empty(spark)).count() == 0


# --- quality ---


def test_junk_is_told_from_prose(spark):
    ship_package(spark)
    rng = random.Random(6)
    junk = [lambda w: " ".join(x for x in w for _ in range(9)), lambda w: "!! ".join(w).upper(), lambda w: " | ".join(w), lambda w: "&&& ".join(w)]
    data = [(i, llm_data.prose(rng, 60) if i % 2 else junk[i % 8 // 2](llm_data.prose(rng, 40).split()), "en", "s", 1) for i in range(400)]
    labels = spark.createDataFrame([*[(i, i % 2, 0) for i in range(400)], (5, 1, 0), (None, 0, 0), (9999, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    docs = llm_data.documents(spark, [*data, (7000, None, None, None, None), (7001, "", None, None, None), (None, "word", None, None, None), data[3]])
    found = quality.classify(docs, labels).collect()
    assert len(found) == 404
    held = [r for r in found if r["held_out"] and r["doc_id"] < 400]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert len(held) > 50 and sum(r["predicted"] == r["doc_id"] % 2 for r in held) / len(held) > 0.97
    assert {r["score"] for r in found if r["doc_id"] in (7000, 7001)} == {0.5}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 190 <= kept.count() <= 210


def test_held_out_labels_do_not_matter(spark):
    ship_package(spark)
    docs = llm_data.documents(spark)
    label = lambda flip: spark.createDataFrame([(r[0], (r[0] // 3 + (flip and zlib.crc32(str(r[0]).encode()) % 4 == 2)) % 2, 0) for r in llm_data.rows()[:40]], "doc_id long, quality int, toxic int")
    one, two = (sorted((str(r["doc_id"]), r["score"]) for r in quality.classify(docs, label(f)).collect()) for f in (0, 1))
    assert one == two


def test_quality_without_labels_or_documents(spark):
    ship_package(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.classify(llm_data.documents(spark), none).collect()} == {0.5}
    assert quality.classify(llm_data.empty(spark), none).count() == 0


# --- host reputation ---

URLS = [
    ("HTTP://WWW.Example.COM/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("x://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
    ("http://a.com/", "a.com", "/", "com/", "allow"),
    ("http://a.com", "a.com", "", None, None),
    ("http://xcom/fr/", "xcom", "/fr/", None, None),
    ("http://net/es/1", "net", "/es/1", "net/es/", "block"),
    ("http://a.net?/es/", "a.net", "", None, None),
    ("http://É.NET:80/fr/\n#x", "É.net:80", "/fr/\n", None, None),
    ("u://a://b/c", "a:", "//b/c", None, None),
    ("no scheme", "", "", None, None),
    (None, "", "", None, None),
    ("://", "", "", None, None),
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "<p>", "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, html string, rule string, host string")
    found = {r["page_id"]: tuple(r)[1:] for r in host_reputation.judge(pages).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert found[i][:3] == (host, path, rule) and found[i][3] == (verdict or found[i][3]) and found[i][3] in ("allow", "block")


def test_reputation_shrinks_towards_the_parent(spark):
    hosts = {"a.bad.x": (40, 38), "b.bad.x": (30, 29), "c.good.x": (40, 1), "d.good.x": (30, 2), "e.good.y": (20, 1)}
    labelled = spark.createDataFrame([(h, int(i < bad)) for h, (n, bad) in hosts.items() for i in range(n)], "host string, bad long")
    asked = spark.createDataFrame([(h,) for h in (*hosts, "new.bad.x", "new.good.x", "new.other.z")], "host string")
    rate = {r["host"]: (r["rate"], r["lower"]) for r in host_reputation.reputations(labelled, asked).collect()}
    overall = 71 / 160
    assert rate["c.good.x"][0] < 0.1 < overall < 0.8 < rate["a.bad.x"][0] < 1
    assert rate["new.bad.x"][0] > rate["new.other.z"][0] > rate["new.good.x"][0] and abs(rate["new.other.z"][0] - overall) < 1e-9
    assert rate["a.bad.x"][1] > 0.5 > rate["c.good.x"][1] and all(low <= mean for mean, low in rate.values())


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert host_reputation.judge(empty).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/x", "")], "page_id long, url string, html string")
    assert [r["verdict"] for r in host_reputation.judge(one).collect()] == ["allow"]


# --- mixing ---


def test_targets_share_everything_under_the_limit():
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.choice([0, rng.randrange(1, 10), rng.randrange(1, 1000)]) for _ in range(rng.randrange(1, 12))]
        found = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
        assert abs(sum(found) - sum(sizes)) < 1e-6 and all(t <= 3 * s + 1e-9 for t, s in zip(found, sizes))
        free = {round(t / (5, 2, 1)[i % 3], 6) for i, (t, s) in enumerate(zip(found, sizes)) if t < 3 * s - 1e-9}
        assert len(free) <= 1


def test_tree_deals_every_quota_exactly_and_blocks_are_permuted():
    quotas = (700, 0, 33, 5)
    tree = mixing.Tree(quotas, 13, 4)
    source = np.repeat(np.arange(4), quotas)
    rank = np.concatenate([np.arange(q) for q in quotas])
    shard = tree.shard_of(source, rank)
    again = np.concatenate([tree.shard_of(source[i : i + 1], rank[i : i + 1]) for i in range(0, len(rank), 50)])
    assert (again == shard[::50]).all() and set(shard) == set(range(13))
    per_shard = np.bincount(shard)
    assert per_shard.sum() == sum(quotas) and per_shard.max() - per_shard.min() <= 4
    for q in (1, 2, 3, 5, 33, 700, 1024, 1025):
        places = mixing.permuted(np.arange(q), np.full(q, q), np.full(q, 3), 9)
        assert sorted(places) == list(range(q))
    assert (mixing.permuted(np.arange(700), np.full(700, 700), np.zeros(700, int), 9) != np.arange(700)).mean() > 0.9


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("block_words, shard_blocks", [(65_536, 256), (50, 3)])
def test_words_taken_meet_the_targets(spark, block_words, shard_blocks):
    ship_package(spark)
    data = llm_data.rows()
    docs = llm_data.documents(spark)
    mixed = mixing.mix(docs, block_words=block_words, shard_blocks=shard_blocks)
    found = mixing.taken_words(mixed).collect()
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((r[0], words(r[1])) for r in data)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in found)
    sizes = Counter()
    for r in data:
        sizes[r[3]] += words(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, mixing.targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])))
    by_target = Counter()
    for r in found:
        by_target[r["target"]] += r["taken"]
    assert all(abs(by_target[t] - t) <= 4 for t in target.values()) and {r["source_size"] for r in found} == set(sizes.values())
    pieces = mixed.pieces.toPandas()
    assert len(set(pieces["shard"])) == (1 if block_words > 10_000 else max(pieces["shard"]) + 1)
    assert sorted(map(tuple, mixing.taken_words(mixing.mix(docs.repartition(5), block_words=block_words, shard_blocks=shard_blocks)).collect()), key=str) == sorted(map(tuple, found), key=str)


def test_mixed_documents_carry_what_was_taken(spark):
    ship_package(spark)
    docs = llm_data.documents(spark)
    rows = mixing.mixed_documents(docs)
    assert rows.columns == docs.columns
    out, taken = Counter(), Counter()
    for r in rows.collect():
        assert r["n_chars"] == len(r["text"]) or words(r["text"]) > 0
        out[(r["doc_id"], r["source"])] += words(r["text"])
    for r in mixing.taken_words(mixing.mix(docs)).collect():
        taken[r["doc_id"]] += r["taken"]
    whole = Counter()
    for (doc, _), n in out.items():
        whole[doc] += n
    assert {d: n for d, n in whole.items() if n} == {d: n for d, n in taken.items() if n}


def test_mixed_documents_follow_the_draw(spark):
    ship_package(spark)
    data = [r for r in llm_data.rows() if r[0] is not None]
    data = [r for r in data if data.count(r) == 1]
    settings = {"block_words": 50, "shard_blocks": 3}
    got = [r["doc_id"] for r in mixing.mixed_documents(llm_data.documents(spark, data), **settings).collect()]
    first = {}
    for p in sorted(mixing.mix(llm_data.documents(spark, data), **settings).pieces.collect(), key=lambda p: p["first_word"]):
        first.setdefault((p["doc_id"], p["epoch"]), (p["shard"], p["place"] % 2**64))
    assert len({shard for shard, _ in first.values()}) > 10
    assert got == [doc for (doc, _), _ in sorted(first.items(), key=lambda f: f[1])]


def test_nothing_to_mix(spark):
    assert mixing.taken_words(mixing.mix(llm_data.empty(spark))).count() == 0
    assert mixing.mixed_documents(llm_data.empty(spark)).count() == 0
    assert [r["taken"] for r in mixing.taken_words(mixing.mix(llm_data.documents(spark, [(1, "", "en", "a", 0), (2, None, "en", None, 0)]))).collect()] == [0, 0]
