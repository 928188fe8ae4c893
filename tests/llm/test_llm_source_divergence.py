"""Divergences against counting everything in plain Python."""

import random
import re
from collections import Counter, defaultdict

import llm_data
import numpy as np
import pandas as pd
import pytest

from spectrabatch.llm import source_divergence
from spectrabatch.session import ship_package

SCALE = 10**9


def slow(rows, least, ranks=10):
    """``rows``: (text, lang, source)."""
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + SCALE * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, last in (("pair", pairs, None), ("term", terms, ranks)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:last]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def found_rows(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize("least", [1, 2, 10])
def test_as_counted_in_full(spark, least):
    ship_package(spark)
    data = [(*r[:2], ["en", "fr", None][i % 3] if r[2] else None, r[3], r[4]) for i, r in enumerate(llm_data.rows(count=60))]
    data += [(900 + i, "Ünïcode ÀÉ prefixes prefix pre p " + "y" * (40 + i % 2), "xx", f"t{i % 3}", 0) for i in range(24)]
    data += [(990, "only here", "one", "alone", 0), (991, None, "none", "a", 0), (992, "12 3", "none", "b", 0)]
    found = found_rows(source_divergence.source_divergence(llm_data.documents(spark, data), least))
    assert found == slow([(r[1], r[2], r[3]) for r in data], least)
    assert {r[0] for r in found} >= {"none", "en", ""} and ("none", "a", "pair", "b", 0, 1) in found


def test_refinement_keeps_what_counting_keeps(spark):
    ship_package(spark)
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abé") for _ in range(rng.randrange(1, 20))) for _ in range(30)) + " " + "ab" * rng.choice([300, 301]) for _ in range(150)]
    rows = source_divergence.term_rows(llm_data.documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]))
    kept = {(bytes(r["term"]).decode(), r["docs"]) for r in source_divergence.kept_terms(spark, rows, 5).collect()}
    held = Counter(t for text in texts for t in set(text.split()))
    assert kept == {(t, n) for t, n in held.items() if n >= 5} and any(len(t) > 500 for t, _ in kept)


@pytest.mark.parametrize("bands, dense", [(1, 1 << 20), (3, 7), (5, 1)])
def test_blocks_and_bands_sum_all_pairs(monkeypatch, bands, dense):
    monkeypatch.setattr(source_divergence, "DENSE_CELLS", dense)
    rng = np.random.default_rng(2)
    base = rng.integers(1, 1000, 7)
    table = np.tile(base, (20, 1))
    cells = [(t, s, int(rng.integers(1, 10**9))) for t in range(20) for s in range(7) if rng.random() < 0.4]
    for t, s, p in cells:
        table[t, s] = p
    seen = [t for t in range(20) if any(c[0] == t for c in cells)]
    frame = pd.DataFrame([(f"t{t}".encode(), s, p) for t, s, p in cells], columns=["term", "number", "p"]).sample(frac=1, random_state=1)
    groups = pd.DataFrame({"number": range(7), "p0": base, "bands": bands}).sample(frac=1, random_state=2)
    parts = [source_divergence._block_sums(("en", 0, band), frame, groups) for band in range(bands)]
    got = {(r.a, r.b): r.value for part in parts for r in part.itertuples()}
    assert got == {(a, b): sum((int(table[t, a]) - int(table[t, b])) ** 2 // int(table[t, a] + table[t, b]) for t in seen) for a in range(7) for b in range(a + 1, 7)}


def test_no_documents_no_rows(spark):
    ship_package(spark)
    assert source_divergence.source_divergence(llm_data.empty(spark)).count() == 0
