"""The pipeline and its stages against brute force, on a table with odd rows."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from llm_tables import documents, folder, prose, texts, with_extras
from tokenizers import Tokenizer

from tradebook.llm import langid, packing, simhash

PASSAGES = [prose(900 + i, 60) for i in range(4)]
LINE = "Licensed under terms that many files repeat, word for word, without any change."


def rows() -> list[tuple]:
    """The odd texts, a doc_id with two texts, short common lines, passages of over 50 words, exact and near copies."""
    out = [(r[0], r[1][:6000] if r[0] == 9 else r[1], *r[2:]) for r in texts()]
    out += [(200 + i, prose(400 + i, 80) + " " + PASSAGES[i % 4] + " " + prose(500 + i, 70) + "\n" + LINE + "\n" + prose(550 + i, 30), "en", "m") for i in range(12)]
    out += [(300 + i, prose(600, 300) + f" end {i}", "en", "n") for i in range(5)]
    out += [(400, prose(700, 90), "en", "o"), (401, prose(701, 90), "en", "o"), (401, prose(700, 90), "en", "o"), (None, prose(702, 60), "en", "o")]
    return out


def buckets(text: str) -> Counter:
    """Hashed n-grams, one at a time."""
    found, word = Counter(), (1 << 64) - 1
    points = [ord(c) for c in text.lower()]
    for n in langid.GRAMS:
        for at in range(len(points) - n + 1):
            state = 0
            for k in range(n):
                state = (state * 0x9E3779B97F4A7C15 + points[at + k] + k + 1) & word
            found[((state ^ state >> 29) * 0xBF58476D1CE4E5B9 & word) >> 48] += 1
    return found


def held_out(doc) -> bool:
    return doc is None or zlib.crc32(str(doc).encode()) % 4 == 2


def languages(given: list[tuple]) -> list[tuple[str, float]]:
    counts = defaultdict(Counter)
    for doc, text, lang, *_ in given:
        if text is not None and lang is not None and not held_out(doc):
            counts[lang] += buckets(text)
    size = {lang: sum(c.values()) + 0.5 * langid.BUCKETS for lang, c in counts.items()}
    out = []
    for _, text, *_ in given:
        if text is None or not any(c.isalpha() for c in text):
            out.append(("und", 0.0))
            continue
        own = buckets(text)
        total = {lang: sum(n * math.log((counts[lang][b] + 0.5) / size[lang]) for b, n in own.items()) for lang in counts}
        best = max(sorted(total), key=total.get)
        root = math.sqrt(sum(own.values()))
        out.append((best, 1 / sum(math.exp((t - total[best]) / root) for t in total.values())))
    return out


def test_language_scores_equal_brute_force(spark, tmp_path):
    given = rows()
    sf_dir = folder(spark, tmp_path, with_extras(documents(spark, given)))
    from tradebook.llm.book import QUERIES

    got = sorted((str(r["doc_id"]), r["held_out"], r["lang_pred"], r["score"]) for r in QUERIES["op10_language"](spark, sf_dir).collect())
    want = sorted((str(r[0]), held_out(r[0]), *found) for r, found in zip(given, languages(given)))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-4)


def told(given):
    return [r for r, (lang, score) in zip(given, languages(given)) if lang != "und" and score >= 0.5]


def one_of_each(given):
    prints = [simhash.fingerprint(r[1], simhash.SHINGLE) for r in given]
    group = list(range(len(given)))
    for i in range(len(given)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= simhash.MOST and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    kept = [r for r in given if r[0] is None]
    for g in set(group):
        own = [r for r, x in zip(given, group) if x == g and r[0] is not None]
        kept += sorted(own, key=lambda r: (r[0], r[1] or ""))[:1]
    return kept


def without_passages(given):
    raw = [(r[1] or "").encode() for r in given]
    n = corpus_pipeline.PASSAGE
    seen = Counter(b[i:i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for row, b in zip(given, raw):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i:i + n]] > 1:
                gone[i:i + n] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        for a, z in zip(edges[::2], edges[1::2]):
            if len(b[a:z].split()) < corpus_pipeline.PASSAGE_WORDS:
                gone[a:z] = False
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]).decode(errors="ignore")
        out.append((row[0], None if row[1] is None else kept, *row[2:]))
    return out


def pieces(given):
    library, out = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY)), []
    for doc, text, *_ in given:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for n, (start, length) in enumerate(packing.cuts(len(ids), 2048)):
            out.append((doc, n, start, length, zlib.crc32(ids[start:start + length].tobytes())))
    return out


def plain(df):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def given(spark):
    return documents(spark, rows())


def test_representatives_are_rows_of_their_group(spark, given):
    got = corpus_pipeline.without_near_copies(spark, with_extras(given), "")
    assert got.columns == with_extras(given).columns
    assert [r[:2] for r in plain(got)] == [r[:2] for r in sorted(one_of_each(rows()), key=str)]
    a, b = prose(800, 60), prose(801, 60)
    few = documents(spark, [(2, b, "en", "x"), (5, a, "en", "x"), (5, b, "en", "x"), (5, a, "en", "x")])
    assert [r[:2] for r in plain(simhash.one_of_each(few))] == [(2, b), (5, a)]


def test_passages_of_over_fifty_words_go(spark, given):
    got = corpus_pipeline.without_repeated_passages(spark, with_extras(given), "")
    assert plain(got) == sorted(without_passages(rows()), key=str)
    left = {r["doc_id"]: r["text"] for r in got.collect()}
    for i in range(12):
        assert PASSAGES[i % 4][20:-20] not in left[200 + i] and LINE in left[200 + i] and prose(400 + i, 80)[:-5] in left[200 + i]


def test_pipeline_equals_brute_force(spark, tmp_path):
    sf_dir = folder(spark, tmp_path, with_extras(documents(spark, rows())))
    got = [r.asDict() for r in corpus_pipeline.run(spark, sf_dir).collect()]
    want = pieces(without_passages(one_of_each(told(rows()))))
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got), key=str) == sorted(want, key=str)
    filled = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled[r["sequence_id"]]
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 2048 and len(filled) == -(-sum(filled.values()) // 2048)


@pytest.mark.parametrize("some", [[], [(None, None, None, None), (1, None, None, None), (1, None, None, None)]])
def test_stages_of_empty_and_null_tables(spark, some):
    empty = with_extras(documents(spark, some))
    docs = empty
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.pinned(stage(spark, docs, ""))
        assert docs.columns == empty.columns and docs.isEmpty(), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").collect() == []
