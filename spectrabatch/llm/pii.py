"""Personal data: candidate spans judged by gradient-boosted trees.

Exact detectors find the base spans, which always stay. Generators of high recall
propose further, overlapping spans: obfuscated addresses, numbers with unusual
separators, phone numbers without a plus, addresses with spaces. Boosted trees see
the format of a candidate (lengths, digit groups, separators, checksum) and its
context (neighbouring characters, words nearby), and give a probability; the
threshold is calibrated on a part of the sample the trees did not see, so that a
stated share of what they select is right. Selected candidates that touch no base
span are taken by falling probability, without overlaps.

Labels come from the detectors (distant supervision): a candidate of the sample is
right if it is a base span of its kind, wrong if it overlaps none. Right ones are
also rewritten the ways people write them (``[at]``, other separators, no plus), so
the trees learn to recognise what the detectors can't. The sample is bounded:
``SAMPLE`` documents with candidates, chosen by a hash of their text. Model and
sample fit the driver; scoring is one pass over all texts without a shuffle, and
only texts that hold a digit or a sign of an address are looked at closely.

Null and empty texts have no spans. Positions are code points, end exclusive.
Detectors and generators are linear in the text, however long its runs are. If the
sample has no candidate, only base spans are returned. Repeated rows are scanned
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, text_or_empty

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 2000
PRECISION = 0.99
TREES, DEPTH, RATE, BINS = 40, 3, 0.3, 32

# The patterns asked for. They are possessive where that finds the
# same matches, so that no run of characters is read more than once.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORTH = re.compile(r"[0-9@]|[\[({](?:at|AT)[\])}]")

# What the generators propose.
WIDE = (
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}+\x20{0,2}(?:@|[\[({](?:at|AT)[\])}])\x20{0,2}[\w-]{1,63}(?:\x20?(?:\.|[\[({](?:dot|DOT)[\])}])\x20?[\w-]{1,63}){1,6}")),
    ("ip", re.compile(r"(?<![0-9])[0-9]{1,3}(?:\x20?[.,]\x20?[0-9]{1,3}){3}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}[0-9]){11,19}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])\+?[0-9(](?:[\x20()./-]{0,2}[0-9]){6,16}(?![0-9])")),
)
CUES = (
    re.compile(r"mail|contact|write|@", re.I),
    re.compile(r"\bip\b|host|server|address", re.I),
    re.compile(r"card|visa|credit|pay|account", re.I),
    re.compile(r"phone|tel|call|mobile|fax", re.I),
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, found from each @ outwards."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at) if start < at else None
        if match:
            yield start, match.end()
            last = match.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The exact detectors, by kind as listed, then by start."""
    found = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(part) <= 3 and int(part or "0") <= 255 for part in (p.lstrip("0") for p in m[0].split("."))):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


def candidates(text: str) -> list[tuple[str, int, int]]:
    return [(kind, *m.span()) for kind, pattern in WIDE for m in pattern.finditer(text)]


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    span, digits = text[start:end], _digits(text[start:end])
    groups = [len(g) for g in re.findall("[0-9]+", span)] or [0]
    before, after = text[max(0, start - 40) : start], text[end : end + 20]
    previous, following = before[-1:], after[:1]
    near = [1.0 if cue.search(before) else 0.0 for cue in CUES]
    return [
        *[float(kind == k) for k in KINDS],
        len(span),
        len(digits),
        len(groups),
        groups[0],
        groups[-1],
        max(groups),
        min(groups),
        float(len(set(digits))),
        float(bool(digits) and luhn(digits)),
        float(span[:1] == "+"),
        span.count("("),
        span.count("."),
        span.count("-"),
        span.count(" "),
        span.count("/") + span.count("_") + span.count(","),
        span.count("@"),
        float(bool(re.search(r"[\[({](?:at|AT)[\])}]", span))),
        sum(c.isalpha() for c in span),
        float(max((int(g) for g in re.findall("[0-9]{1,6}", span)), default=0) <= 255),
        float(previous.isalnum()),
        float(previous in ".,:;/-_=#$" and previous != ""),
        float(following.isalnum()),
        float(following in "./-_%=" and following != ""),
        *near,
    ]


@dataclass
class Trees:
    """Gradient-boosted trees for the logistic loss on binned features."""

    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[list[tuple[int, int, float]]] = field(default_factory=list)  # per node: feature, bin, value
    prior: float = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), int)

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        b = self.binned(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.prior = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.prior)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            gradient, curvature = y - p, np.maximum(p * (1 - p), 1e-6)
            nodes, where = [(-1, 0, 0.0)] * (2 ** (depth + 1) - 1), np.zeros(len(y), dtype=int)
            for node in range(2**depth - 1):
                mine = np.flatnonzero(where == node)
                split = self._split(b[mine], gradient[mine], curvature[mine]) if len(mine) > 1 else None
                if split:
                    nodes[node] = (*split, 0.0)
                    where[mine] = 2 * node + 1 + (b[mine, split[0]] > split[1])
            for node in np.unique(where):
                mine = where == node
                nodes[node] = (-1, 0, float(rate * gradient[mine].sum() / (curvature[mine].sum() + 1.0)))
            score += np.array([n[2] for n in nodes])[where]
            self.trees.append(nodes)
        return self

    @staticmethod
    def _split(b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
        total_g, total_h = g.sum(), h.sum()
        best, found = total_g**2 / (total_h + 1.0) + 1e-6, None
        for j in range(b.shape[1]):
            left_g, left_h = np.cumsum(np.bincount(b[:, j], g, BINS + 1))[:-1], np.cumsum(np.bincount(b[:, j], h, BINS + 1))[:-1]
            gain = left_g**2 / (left_h + 1.0) + (total_g - left_g) ** 2 / (total_h - left_h + 1.0)
            at = int(np.argmax(gain))
            if gain[at] > best:
                best, found = gain[at], (j, at)
        return found

    def probability(self, x: np.ndarray) -> np.ndarray:
        b, score = self.binned(x), np.full(len(x), self.prior)
        for nodes in self.trees:
            where = np.zeros(len(x), dtype=int)
            for _ in range(DEPTH):
                feature = np.array([n[0] for n in nodes])[where]
                cut = np.array([n[1] for n in nodes])[where]
                go = feature >= 0
                where = np.where(go, 2 * where + 1 + (b[np.arange(len(x)), np.maximum(feature, 0)] > cut), where)
            score += np.array([n[2] for n in nodes])[where]
        return 1 / (1 + np.exp(-score))


@dataclass
class Model:
    trees: Trees
    threshold: float


def rewritten(kind: str, span: str, rng: random.Random) -> str | None:
    """A base span as people also write it."""
    if kind == "email":
        name, _, host = span.partition("@")
        return name + rng.choice([" [at] ", "[at]", " (at) ", " @ "]) + host
    if kind == "phone":
        return rng.choice([span.lstrip("+"), span.replace(" ", ".").replace("-", "."), span.replace(") ", ")/")])
    if kind == "card":
        digits, mark = _digits(span), rng.choice([".", "/", "  ", "_"])
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return rng.choice([span.replace(".", " . "), span.replace(".", ", "), span])


def broken(kind: str, span: str, rng: random.Random) -> str | None:
    """Something of a like shape that is no personal data: a wrong checksum, a large part, a date, a sum."""
    if kind == "card":
        digits, mark = _digits(span), rng.choice(["", ".", "/", " ", "-", "  "])
        digits = digits[:-1] + str((int(digits[-1]) + rng.randrange(1, 10)) % 10)
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == "ip":
        parts = span.split(".")
        parts[rng.randrange(4)] = str(rng.randrange(256, 999))
        return rng.choice([".", ", "]).join(parts)
    if kind == "phone":
        day = f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}"
        return rng.choice([day, f"{day} {rng.randrange(24):02}", f"{day}/{day}", str(rng.randrange(10**7, 10**12)), f"{rng.randrange(10**4)} {rng.randrange(10**5)}", f"{rng.randrange(1, 999)}.{rng.randrange(10**3):03}.{rng.randrange(10**3):03}"])
    return None


def examples(texts: list[str], seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and document numbers of the sample's candidates and of their rewritten forms."""
    rng = random.Random(seed)
    rows, labels, documents = [], [], []

    def learn(text: str, number: int, label_of) -> None:
        for kind, a, b in candidates(text):
            label = label_of(kind, a, b)
            if label is not None:
                rows.append(features(text, kind, a, b))
                labels.append(label)
                documents.append(number)

    for number, text in enumerate(texts):
        base = base_spans(text)
        own = {(k, a, b) for k, a, b in base}

        def of_text(kind, a, b, own=own, base=base):
            return 1 if (kind, a, b) in own else None if any(a < e and s < b and k == kind for k, s, e in base) else 0

        learn(text, number, of_text)
        for kind, a, b in base[:8]:
            for change, label in ((rewritten, 1), (broken, 0)):
                put = change(kind, text[a:b], rng)
                if put is None:
                    continue
                left, right = text[max(0, a - 60) : a], text[b : b + 60]
                edge = (len(left), len(left) + len(put))

                def of_change(k, s, e, kind=kind, edge=edge, label=label):
                    if (s, e) == edge and k == kind:
                        return label
                    return 0 if s < edge[1] and edge[0] < e else None

                learn(left + put + right, number, of_change)
    return np.array(rows, dtype=float), np.array(labels, dtype=float), np.array(documents)


def train(texts: list[str], precision: float = PRECISION) -> Model | None:
    """Fit on three quarters of the sampled documents, calibrate on the rest."""
    x, y, number = examples(texts)
    fitting = number % 4 != 3 if len(y) else np.zeros(0, bool)
    if not len(y) or len(set(y[fitting])) < 2 or not y[~fitting].sum():
        return None
    trees = Trees().fit(x[fitting], y[fitting])
    p = trees.probability(x[~fitting])
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[~fitting][order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= precision)
    # ties of the last one must pass together
    threshold = max(0.5, float(p[order][good[-1]])) if len(good) else 2.0
    if len(good) and (y[~fitting][p >= threshold]).mean() < precision:
        threshold = float(np.nextafter(threshold, 2))
    return Model(trees, threshold)


def find(text: str, model: Model | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans by kind and start."""
    if not WORTH.search(text):
        return [], []
    base = base_spans(text)
    taken = [(a, b) for _, a, b in base]
    more = []
    proposed = candidates(text) if model and model.threshold <= 1 else []
    if proposed:
        limits = np.array(sorted(taken)).reshape(-1, 2)
        starts, ends = limits[:, 0], np.maximum.accumulate(limits[:, 1]) if len(limits) else limits[:, 1]
        free = []
        for kind, a, b in proposed:
            i = int(np.searchsorted(starts, b, side="left"))
            if i == 0 or ends[i - 1] <= a:
                free.append((kind, a, b))
        if free:
            p = model.trees.probability(np.array([features(text, *c) for c in free], dtype=float))
            chosen: dict[int, int] = {}
            for j in sorted(np.flatnonzero(p >= model.threshold), key=lambda j: (-p[j], free[j][1], free[j][2])):
                _, a, b = free[j]
                if not any(at in chosen for at in range(a, b)):  # a candidate is at most a few hundred characters
                    chosen.update(dict.fromkeys(range(a, b), j))
                    more.append(free[j])
    return base, sorted([*base, *more], key=lambda s: (KINDS.index(s[0]), s[1]))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Train on a bounded sample of the documents that hold candidates, the first by a hash of their text."""
    likely = docs.select("text").filter(F.col("text").rlike(r"[0-9]{3}|@|\[at\]|\(at\)"))
    # long texts would crowd the driver: of each sampled text the places around its first signs are kept
    signs = F.slice(F.regexp_extract_all("text", F.lit(r"(?s)(.{0,80}(?:[0-9]{3}|@|\[at\]|\(at\)).{0,120})"), F.lit(1)), 1, 8)
    # copies of a text count once, so a large group of them cannot fill the sample
    hashed = likely.withColumn("_order", F.xxhash64("text"))
    drawn = first_by_hash(hashed.select("_order").distinct(), "_order", sample).collect()
    chosen = docs.sparkSession.createDataFrame(drawn, "_order long")  # at most `sample` numbers
    places = hashed.join(F.broadcast(chosen), "_order").select("_order", F.array_join(signs, " ").alias("near"))
    rows = places.groupBy("_order").agg(F.min("near").alias("near")).collect()
    return train([r["near"] for r in sorted(rows, key=lambda r: (r["_order"], r["near"]))])


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per document: doc_id, counts of base spans, the digest of the base spans, and all spans."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                base, every = find(text.as_py(), sent.value)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                out.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            columns = list(zip(*out)) or [()] * 6
            yield pa.record_batch([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:]]], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return texts.mapInArrow(rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
