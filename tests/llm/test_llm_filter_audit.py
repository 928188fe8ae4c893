"""The filter audit against applying all filters in all orders, document by document."""

import re
from itertools import permutations

import llm_data
import pytest

from spectrabatch.llm import filter_audit
from spectrabatch.session import ship_package


def slow_audit(rows, labels):
    """``rows``: (doc_id, text, source); ``labels``: (doc_id, quality, toxic)."""
    firsts = {}
    for doc, text, _ in rows:
        if doc is not None:
            firsts[text or ""] = min(firsts.get(text or "", doc), doc)
    found = {}
    fails = []
    for doc, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc is not None and firsts[text] < doc,
        }
        good = any(d == doc and q == 1 for d, q, _ in labels if d is not None)
        toxic = any(d == doc and t == 1 for d, _, t in labels if d is not None)
        fails.append((source or "", {k for k, v in failed.items() if v}, good, toxic))
    for part in {f[0] for f in fails}:
        mine = [f[1:] for f in fails if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if letter in f[0]]
                left = [f for f in left if letter not in f[0]]
                every = sum(letter in f[0] for f in mine)
                alone = sum(f[0] == {letter} for f in mine)
                found[part, order, step] = [len(left), len(gone), every - len(gone), alone, sum(f[1] for f in gone), sum(f[2] for f in gone)]
                shapley[letter] += len(gone)
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                found[part, order, step].append(shapley[letter])
    return {key: tuple(value) for key, value in found.items()}


def labels(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, quality int, toxic int, part string")


def result(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in df.collect()}


def test_every_order_as_if_applied(spark):
    ship_package(spark)
    data = llm_data.rows() + [(1000 + i, ("Many WORDS # " * 120) if i % 2 else "plain words " * 150, "en", f"s{i % 3}", 1) for i in range(12)]
    marks = [(3 * i, i % 2, i % 3 == 0) for i in range(50)] + [(9, 0, 1), (9, 1, 0), (None, 1, 1), (1001, None, 1), (1002, 1, None), (77777, 1, 1)]
    marks = [(d, q, None if t is None else int(t)) for d, q, t in marks]
    found = result(filter_audit.audit(llm_data.documents(spark, data), labels(spark, marks)))
    assert found == slow_audit([(r[0], r[1], r[3]) for r in data], marks)
    assert len({v[:6] for v in found.values()}) > 20


def test_null_ids_neither_fail_nor_cause_copies(spark):
    data = [(None, "a", None, None, 1), (5, "a", None, None, 1), (5, "a", None, "", 1), (7, "a", None, "x", 1), (8, None, None, "x", 0), (9, "", None, "x", 0)]
    found = result(filter_audit.audit(llm_data.documents(spark, data), labels(spark, [])))
    assert found == slow_audit([(r[0], r[1], r[3]) for r in data], [])
    assert found["", "EABCD", 1][1] == 0 and found["x", "EABCD", 1][1] == 2


@pytest.mark.parametrize("marked", [False, True])
def test_no_documents_no_rows(spark, marked):
    assert filter_audit.audit(llm_data.empty(spark), labels(spark, [(1, 1, 1)] if marked else [])).count() == 0
