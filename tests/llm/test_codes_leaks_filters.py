"""Vector codes, benchmark decontamination and the filter audit against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_tables import documents, folder, prose, texts, with_extras

from tradebook.llm import decontamination, filteraudit, vectorcodes
from tradebook.llm.book import QUERIES

VECTORS = "vec_id long, embedding array<double>, label int, code string, part string, error string"
ITEMS = "item_id long, text string, words string, fp string"
LABELS = "doc_id long, quality int, toxic int, part string, good string"


def codes(rows, parts=16, entries=64, rounds=2):
    """One component at a time, in Python integers."""
    good = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not good:
        return []
    each = max(1, -(-max(len(v) for _, v, _ in good) // parts))
    whole = [[int(x) * 256 if abs(x) > 2 ** 900 else math.floor(256 * x) for x in v] + [0] * (parts * each - len(v)) for _, v, _ in good]
    cut = [[w[p * each:(p + 1) * each] for p in range(parts)] for w in whole]
    smallest = {}
    for (i, v, _), c in zip(good, cut):
        if i not in smallest or v < smallest[i][0]:
            smallest[i] = (v, c)
    first = [smallest[i][1] for i in sorted(smallest, key=lambda i: (i is None, i))[:entries]]
    books = [[list(c[p]) for c in first] for p in range(parts)]

    def nearest(p, own):
        away = [sum((a - b) ** 2 for a, b in zip(own, e)) for e in books[p]]
        return away.index(min(away)), min(away)

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for c in cut:
                members[nearest(p, c[p])[0]].append(c[p])
            for e, own in members.items():
                books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    errors, by_label = [sum(d for _, d in f) for f in found], defaultdict(int)
    for (_, _, label), e in zip(good, errors):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    long = lambda x: x if x < 1 << 63 else None
    return [(i, "".join(f"{n:02x}" for n, _ in f), long(e), long(by_label[label]), digest) for (i, _, label), f, e in zip(good, found, errors)]


def got_codes(spark, tmp_path, rows):
    given = [(i, v, label, "x", "y", "z") for i, v, label in rows]
    sf_dir = folder(spark, tmp_path, spark.createDataFrame(given, VECTORS), "embeddings")
    return sorted((tuple(r) for r in QUERIES["op11_vector_codes"](spark, sf_dir).collect()), key=str)


def odd_vectors(scale):
    pick = np.random.default_rng(3)
    rows = [(i, (pick.standard_normal(32) * scale).tolist(), i % 5 or None) for i in range(150)]
    rows += [(i, rows[0][1], 7) for i in range(200, 230)]
    rows += [(3, rows[9][1], 1), (3, rows[9][1], 1), (None, rows[5][1], None), (400, [0.25, -0.001], 2), (401, [], 2)]
    return rows + [(500, None, 1), (501, [math.nan] * 32, 1), (502, [math.inf] + [0.0] * 31, 1), (503, [None] + [1.0] * 31, 1)]


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e11, 1e30, 1e200])
def test_codes_equal_brute_force(spark, tmp_path, scale):
    rows = odd_vectors(scale)
    assert got_codes(spark, tmp_path, rows) == sorted(codes(rows), key=str)


def test_codes_of_few_or_no_vectors(spark, tmp_path):
    assert got_codes(spark, tmp_path / "a", []) == []
    assert got_codes(spark, tmp_path / "b", [(1, None, 1), (2, [math.nan], 1)]) == []
    few = [(5, [1.0, 2.0, 3.0], None), (5, [0.5, 2.0, 3.0], None), (1, [1.0, -2.0], 4)]
    assert got_codes(spark, tmp_path / "c", few) == sorted(codes(few), key=str)


@pytest.mark.parametrize("width", [1, 3, 4, 1000])
@pytest.mark.parametrize("size", [10, 1 << 20, (1 << 27) + 5, 1 << 90])
def test_limb_products_are_exact(width, size):
    pick = random.Random(width)
    kind = object if size > 1 << 40 or width * size * size >= 1 << 62 else np.int64
    left = [[pick.randint(-size, size) for _ in range(width)] for _ in range(5)]
    right = [[pick.randint(-size, size) for _ in range(width)] for _ in range(7)]
    want = [[sum(a * b for a, b in zip(x, y)) for y in right] for x in left]
    assert vectorcodes.products(np.array(left, dtype=kind), np.array(right, dtype=kind)).tolist() == want
    assert width * ((1 << vectorcodes.limb_bits(width)) - 1) ** 2 < 2 ** 53


def leaks(rows, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    marks = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            marks[tuple(w[i:i + n])].add(item)
    lengths, out = {len(m) for m in marks}, []
    for doc, text in rows:
        w, hit, named = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                found = marks.get(tuple(w[i:i + n]))
                if found:
                    hit.update(range(i, i + n))
                    named |= found
        names = sorted(str(i) for i in named if i is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def got_leaks(spark, tmp_path, docs, items):
    sf_dir = folder(spark, tmp_path, docs)
    folder(spark, tmp_path, spark.createDataFrame([(*i, "x", "y") for i in items], ITEMS), "benchmark")
    return sorted((tuple(r) for r in QUERIES["op12_decontamination"](spark, sf_dir).collect()), key=str)


def test_leaks_equal_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE", 1000)
    rows = texts()
    text_of = {r[0]: r[1] for r in rows}
    ten = [f"w{i}" for i in range(40)]
    rows += [(200, " ".join(ten[5:15]).upper(), "en", "x"), (201, " ".join(ten[5:14]), "en", "x"), (202, "w1-w2," + "  ".join(ten[3:30]), "en", "x"),
             (203, "again " * 300, "en", "x"), (204, "ÉCOLE école 3.5 tiny", None, None), (205, "x " * 20 + " ".join(ten) * 3, "en", "x")]
    items = [(1, " ".join(ten)), (2, " ".join(ten[20:])), (2, "again " * 12), (None, " ".join(ten[:12])), (10, "école 3"), (11, "tiny"),
             (12, None), (13, " .,"), (14, text_of[80]), (15, prose(7, 120)), (16, text_of[9][2000:9000]), (16, text_of[9][2000:9000])]
    want = leaks([r[:2] for r in rows], items)
    assert got_leaks(spark, tmp_path / "a", with_extras(documents(spark, rows)), items) == want
    monkeypatch.setattr(decontamination, "GRAM", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert got_leaks(spark, tmp_path / "b", documents(spark, rows), items) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_leaks_of_empty_tables(spark, tmp_path):
    assert got_leaks(spark, tmp_path / "a", documents(spark, []), [(1, "a b")]) == []
    rows = texts()[:6]
    assert got_leaks(spark, tmp_path / "b", documents(spark, rows), []) == leaks([r[:2] for r in rows], [])


@pytest.mark.parametrize("n", [10, 11, 30])
def test_every_shared_window_keeps_a_common_fingerprint(n):
    pick = random.Random(n)
    for _ in range(50):
        shared = [pick.choice("abc") for _ in range(n)]
        left = [pick.choice("abcd") for _ in range(pick.randint(0, 30))] + shared + [pick.choice("abcd") for _ in range(pick.randint(0, 30))]
        prints = [set(decontamination.fingerprints(decontamination.word_hashes(" ".join(w).encode()), 10, 5).tolist()) for w in (left, shared)]
        assert prints[1] <= prints[0]


def audit(rows, labels):
    """One document, order and step at a time."""
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    low = {}
    for doc, text, *_ in rows:
        if doc is not None:
            low[text or ""] = min(doc, low.get(text or "", doc))
    judged = defaultdict(list)
    for doc, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                 bool(re.search("[#$%&*|]", text)), doc is not None and doc > low[text]]
        judged[lang or ""].append((dict(zip("ABCDE", fails)), doc in good, doc in toxic))
    out = []
    for part, docs in judged.items():
        total = Counter()
        lines = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                total[f] += len(gone)
                lines.append((part, order, step, len(left), len(gone), sum(d[0][f] for d in docs) - len(gone),
                              sum(d[0][f] and sum(d[0].values()) == 1 for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)))
        out += [(*line, total[line[1][line[2] - 1]]) for line in lines]
    return sorted(out)


def got_audit(spark, tmp_path, docs, labels):
    sf_dir = folder(spark, tmp_path, docs)
    folder(spark, tmp_path, spark.createDataFrame([(*r, "x", "y") for r in labels], LABELS), "labels")
    return sorted(tuple(r) for r in QUERIES["op13_filter_audit"](spark, sf_dir).collect())


def test_audit_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(filteraudit, "PIECE", 50)
    rows = texts()
    rows += [(300 + i, " ".join(f"{'Word' if i % 2 else 'w'}{j}" for j in range(120)) + ("#" if i % 3 else ""), [None, "en", ""][i % 3], "x") for i in range(12)]
    rows += [(400 + i, rows[-1][1], ["en", "fr"][i % 2], "x") for i in range(9)] + [(None, rows[-1][1], "en", "x"), (None, None, "en", "x")]
    labels = [(300 + i, i % 2, i % 3 == 0 or None) for i in range(30)] + [(300, 1, 1), (301, None, 0), (None, 1, 1), (9999, 1, 1), (60, 1, 1)]
    labels = [(d, q, None if t is None else int(t)) for d, q, t in labels]
    want = audit([(r[0], r[1], r[2]) for r in rows], labels)
    assert got_audit(spark, tmp_path, with_extras(documents(spark, rows)), labels) == want


def test_audit_of_empty_tables(spark, tmp_path):
    assert got_audit(spark, tmp_path / "a", documents(spark, []), [(1, 1, 1)]) == []
    rows = texts()[:6]
    assert got_audit(spark, tmp_path / "b", documents(spark, rows), []) == audit([(r[0], r[1], r[2]) for r in rows], [])


def test_min_plus_is_the_first_failing_filter():
    order, position = filteraudit.orders(5)
    failed = np.array(list(itertools.product([False, True], repeat=5)))
    gone = filteraudit.min_plus(failed, position)
    for m, p in itertools.product(range(len(failed)), range(len(order))):
        assert gone[m, p] == next((s for s, f in enumerate(order[p]) if failed[m, f]), 5)
