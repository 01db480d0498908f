"""The operators on documents against brute force, on small tables with odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from llm_tables import documents, folder, prose, texts, with_extras
from tokenizers import Tokenizer, models, pre_tokenizers

from tradebook.llm import bytebpe, langid, lzprint, packing, sharding, simhash, suffixdedup, tokencount
from tradebook.llm.book import QUERIES

ROWS = texts()


def key(row: tuple) -> tuple:
    return tuple((v is not None, v) for v in row)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("data"), with_extras(documents(spark)))


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("none"), documents(spark, []))


def collected(spark, name: str, sf_dir: str) -> list[tuple]:
    return sorted((tuple(r) for r in QUERIES[name](spark, sf_dir).collect()), key=key)


@pytest.mark.parametrize("name", [n for n in QUERIES if n.split("_")[0] not in ("op1", "op4", "op11", "op12", "op13")])
def test_empty_table(spark, empty_dir, name):
    assert collected(spark, name, empty_dir) == []


# sharding

def test_shards(spark, sf_dir):
    rows = [r.asDict() for r in QUERIES["op2_sharding"](spark, sf_dir).collect()]
    sizes = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows)
    assert sizes == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in ROWS)
    for shard in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    of_text = {}
    for r in rows:
        text = next(t or "" for d, t, *_ in ROWS if d == r["doc_id"])
        assert of_text.setdefault(text, r["shard"]) == r["shard"]


def test_best_fit_takes_the_tightest_bin():
    assert sharding.best_fit([6, 5, 4, 4, 1], 10) == [0, 1, 0, 1, 1]
    assert sharding.best_fit([12, 3], 10) == [0, 1]
    assert sharding.best_fit([6, 6, 6], 10, most=2) is None


def test_best_fit_equals_a_scan_over_all_bins():
    sizes = sorted((int(x) for x in np.random.default_rng(1).integers(1, 900, 3000)), reverse=True)
    left, want = [], []
    for size in sizes:
        fit = [(room, b) for b, room in enumerate(left) if room >= size]
        at = min(fit)[1] if fit else len(left)
        if not fit:
            left.append(1000)
        left[at] -= size
        want.append(at)
    assert sharding.best_fit(sizes, 1000) == want


def test_balance_with_a_giant_and_with_few_groups():
    sizes = sorted([10_000, *np.random.default_rng(2).integers(1, 50, 2000).tolist()], reverse=True)
    bins = np.bincount(sharding.balanced(sizes, 8), weights=sizes, minlength=8)
    assert sorted(bins)[-1] == 10_000 and max(bins[1:]) - min(bins[1:]) <= 50
    assert sharding.balanced([5, 3], 4) == [0, 1]
    assert sharding.balanced([], 4) == []


def test_capacity_shards(spark):
    sizes = [int(x) for x in np.random.default_rng(3).integers(1, 60, 500)]
    groups = spark.createDataFrame(list(enumerate(sizes)), "key long, bytes long")
    rows = sharding.capacity_shards(groups, 100).collect()
    held = Counter()
    for r in rows:
        held[r["shard"]] += sizes[r["key"]]
    assert len(rows) == 500 and max(held.values()) <= 100 and len(held) <= 1.1 * sum(sizes) / 100 + 2


# suffix arrays

def repeats(rows: list[tuple], length: int) -> list[tuple]:
    raw = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (doc, *_), b in zip(rows, raw):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        runs = int(np.sum(np.diff(np.append(False, gone).astype(int)) == 1))
        out.append((doc, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=key)


def test_repeated_bytes(spark, sf_dir):
    want = repeats(ROWS, 400)
    assert sum(r[2] for r in want) > 1000
    rows = QUERIES["op3_suffix_dedup"](spark, sf_dir).collect()
    assert sorted((tuple(r)[:5] for r in rows), key=key) == want
    whole = [r for r in rows if len(r["text"].encode()) == r["n_bytes"] - r["n_removed"]]
    assert len(whole) > 30 and all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in whole)


@pytest.mark.parametrize("kinds", [1000, 2])
def test_short_strings_and_hot_anchors(spark, monkeypatch, kinds):
    monkeypatch.setattr(suffixdedup, "BATCH", 64)
    rows = [(i, prose(5 + i % 3, 8) + " " + prose(50 + i, 12) + " " + prose(5, 8), "en", None) for i in range(40)]
    docs = suffixdedup.with_places(documents(spark, rows).select("doc_id", "text"), 24, 10, kinds)
    got = []
    for r in docs.collect():
        raw = r["text"].encode()
        kept, n = suffixdedup.kept_parts(raw, r["_llm_starts"], r["_llm_stops"])
        got.append((r["doc_id"], len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest()))
    assert sorted(got, key=key) == repeats(rows, 24)


def test_family_levels_and_hits():
    pick = np.random.default_rng(4)
    family, seen, hit = suffixdedup.Family(), [], set()
    for _ in range(20):
        batch = pick.integers(0, 300, 37).astype("S3")
        hit |= set(family.add(batch, np.arange(len(seen), len(seen) + 37)).tolist())
        seen += batch.tolist()
        sizes = [len(level) for level, _ in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
    times = Counter(seen)
    assert hit == {i for i, s in enumerate(seen) if times[s] > 1}


def test_cut_texts_keep_rows_and_columns(spark):
    docs = with_extras(documents(spark))
    got = suffixdedup.without_repeats(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ROWS)
    assert all((r["text"] is None) == (r["n_chars"] is None) for r in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)


# packing

def test_pieces_are_the_librarys_ids(spark, sf_dir):
    rows = [r.asDict() for r in QUERIES["op5_packing"](spark, sf_dir).collect()]
    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = []
    for doc, text, *_ in ROWS:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(doc, n, a, z - a, zlib.crc32(ids[a:z].tobytes())) for n, (a, z) in enumerate(zip(cuts, cuts[1:]))]
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted((tuple(r[c] for c in names) for r in rows), key=key) == sorted(want, key=key)
    filled = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 2048 and len(filled) == -(-sum(r["length"] for r in rows) // 2048)


def test_encoder_is_the_library(monkeypatch):
    monkeypatch.setattr(packing, "PIECE", 40)
    pick = random.Random(4)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        library, own = Tokenizer.from_file(path), packing.Encoder(path)
        assert (own.fast is not None) == (name == packing.VOCABULARY)
        for n in range(400):
            text = "".join(pick.choice("abcdehinorst   AB'\n\t.,;!?019éß中😀 \u00a0\u3000") for _ in range(n)) + prose(n, n % 30)
            text += "<|endoftext|> x" * (n % 7 == 0)
            assert own.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_fullest_is_the_best_subset_sum():
    pick = np.random.default_rng(6)
    for _ in range(200):
        counts = {int(x): int(n) for x, n in zip(pick.integers(1, 40, 6), pick.integers(1, 4, 6))}
        room = int(pick.integers(1, 90))
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * t for s in sums for t in range(n + 1) if s + x * t <= room}
        chosen = packing.fullest(counts, room)
        assert sum(x * n for x, n in chosen) == max(sums) and all(n <= counts[x] for x, n in chosen)


def test_patterns_use_every_piece():
    counts = {7: 100, 5: 33, 3: 1, 12: 9}
    used = Counter()
    for repeat, combined in packing.patterns(counts, 12):
        assert sum(x * n for x, n in combined) <= 12
        for x, n in combined:
            used[x] += repeat * n
    assert used == counts


# byte-level BPE

def test_bpe_is_the_librarys_and_decodes(spark, sf_dir, monkeypatch):
    path = public_tokenizers.path(bytebpe.RANKS)
    ranks = {t: i for i, t in enumerate(bytebpe.tokens(path)) if t}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for doc, text, *_ in ROWS:
        ids = library.encode_ordinary(text or "")
        raw = np.array(ids, "<u4").tobytes()
        want.append((doc, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert collected(spark, "op6_byte_bpe", sf_dir) == sorted(want, key=key)


def test_cuts_at_single_spaces_beside_wider_white_space():
    rng, some = random.Random(6), ["  ", " ", " ", "\n", "\t", "\r", "\u00a0", "\x1c", "\u2003", "a", "b'", "s", "1", "7", "-", "\u00e9"]
    given = ["".join(rng.choices(some, k=rng.randrange(14))) for _ in range(3000)]
    assert sum(bool(bytebpe.UNSAFE.search(t)) for t in given) > 1000
    chunk = bytebpe.Chunk(given)
    words, flat, counts = chunk.words()
    starts = bytebpe.offsets(counts)
    for text, ((begin, known), steps) in zip(given, chunk.coded(), strict=True):
        parts = [begin, *bytebpe.from_first_use(steps.astype("<u4"), known)]
        assert [words[i].decode() for p in parts for i in flat[starts[p]:starts[p + 1]]] == bytebpe.pattern().findall(text)
    assert bytebpe.from_first_use(bytebpe.by_first_use(flat)).tolist() == flat.tolist()


def test_a_stretch_is_searched_once_and_not_by_the_second_pass(monkeypatch):
    looked = []
    monkeypatch.setattr(bytebpe, "words_of", lambda text, before="": looked.append(before + text) or [before + text])
    chunk = bytebpe.Chunk(["if x1:\n    return x1 if x1 else y2", "a1\n    return x1", ""])
    assert len(list(chunk.coded())) == 3 and not looked
    chunk.words()
    assert sorted(looked) == ["", " x1", " x1:\n   ", " y2", "a1\n   "]


def test_chunks_of_equal_rows(spark):
    docs = documents(spark, [(1, "same words here", "en", None)] * 6).repartition(6)
    got = bytebpe.encode_documents(docs, public_tokenizers.path(bytebpe.RANKS)).collect()
    assert len(got) == 6 and len({bytes(r["ids"]) for r in got}) == 1


# Lempel-Ziv

def test_lz_fingerprints(spark, sf_dir):
    order = sorted(((d, t or "") for d, t, *_ in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))

    def sketch(text):
        seen, open_ = set(), ""
        for c in text:
            open_ += c
            if open_ not in seen:
                seen.add(open_)
                open_ = ""
        return set(sorted({xxhash.xxh32_intdigest(s, lzprint.SEED) for s in seen})[:lzprint.SIZE])

    def near(a, b):
        both = sorted(a | b)[:lzprint.SIZE]
        return sum(x in a and x in b for x in both) / len(both) if both else 1.0

    def told(s):
        return "".join(f"{x:08x}" for x in sorted(s))

    want = []
    for i, (doc, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        edit = len(text) // 4
        edited = text[:len(text) - edit] + following[:edit]
        a, b, c = sketch(text), sketch(edited), sketch(following)
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), told(a), told(b), near(a, b), near(a, c)))
    assert collected(spark, "op7_lz_fingerprint", sf_dir) == sorted(want, key=key)


def test_dictionary_starts_anew(monkeypatch):
    text = prose(8, 300)
    monkeypatch.setattr(lzprint, "BLOCK", 100)
    whole = lzprint.Parse().feed(text).sketch()
    two = lzprint.Parse().feed(text[:250]).copy().feed(text[250:]).sketch()
    assert whole.tolist() == two.tolist()


# SimHash

def brute_groups(fps: list[int], ids: list) -> list:
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                up[root(i)] = root(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [low.get(root(i)) for i in range(len(fps))]


def test_simhash(spark, sf_dir):
    def fingerprint(text):
        words = (text or "").encode()
        words = bytes(c + 32 if 65 <= c <= 90 else c for c in words).split()
        parts = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = [fingerprint(t) for _, t, *_ in ROWS]
    groups = brute_groups(fps, [r[0] for r in ROWS])
    want = sorted(((r[0], f"{f:016x}", g) for r, f, g in zip(ROWS, fps, groups)), key=key)
    assert collected(spark, "op8_simhash", sf_dir) == want


@pytest.mark.parametrize("block", [8192, 7])
def test_links_find_every_component(spark, block):
    pick = np.random.default_rng(9)
    base = pick.integers(0, 1 << 63, 40).tolist()
    fps = set(base)
    for x in base[:20]:
        for _ in range(15):
            for b in pick.choice(64, int(pick.integers(1, 5)), replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    ordered = sorted(fps)
    table = spark.createDataFrame([(simhash.signed(x),) for x in ordered], "fp long")
    from tradebook.llm.components import components

    roots = {r["node"]: r["root"] for r in components(simhash.links(table, 3, block)).collect()}
    got = [roots.get(simhash.signed(x), simhash.signed(x)) for x in ordered]
    want = brute_groups(ordered, [simhash.signed(x) for x in ordered])
    assert got == want


def test_thresholds_cover_the_distance():
    pick = np.random.default_rng(10)
    sample = pick.integers(-(1 << 62), 1 << 62, 500)
    for rows in (100, 10**6, 10**10):
        found, thresholds = simhash.plan(sample, rows)
        assert sum(t + 1 for t in thresholds) == 3 + 1 and sum(found) == (1 << 64) - 1


def test_one_document_of_each_group(spark):
    docs = with_extras(documents(spark))
    kept = simhash.one_of_each(docs)
    groups = simhash.near_groups(docs).collect()
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert kept.columns == docs.columns
    assert ids == sorted({r["component_id"] for r in groups if r["doc_id"] is not None})


# languages

def test_languages_are_told(spark, sf_dir):
    rows = QUERIES["op10_language"](spark, sf_dir).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ROWS)
    for r in rows:
        text = next(t for d, t, *_ in ROWS if d == r["doc_id"])
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    QUERIES["op10_language"](spark, "/root/testdata/sf0.01").createOrReplaceTempView("told")
    docs.createOrReplaceTempView("docs")
    right = spark.sql("select avg(if(lang_pred = lang, 1, 0)) from told join docs using (doc_id) where held_out and lang_pred <> 'und'")
    assert right.first()[0] > 0.97


def test_score_is_the_multinomial_sum():
    matrix = np.log(np.random.default_rng(1).dirichlet(np.ones(langid.BUCKETS), 2).T).astype(np.float32)
    text = "Ein Straßenfest, 3 eaux"
    found = np.concatenate(list(langid.grams(text)))
    assert len(found) == sum(len(text.lower()) - n + 1 for n in langid.GRAMS)
    best = int(np.argmax(matrix[found].sum(axis=0, dtype=float)))
    assert langid.score(text, ["a", "b"], matrix)[0] == "ab"[best]
    assert langid.score("12 !", ["a", "b"], matrix) == ("und", 0.0)
    assert langid.score(text, [], np.zeros((langid.BUCKETS, 0))) == ("und", 0.0)


def test_filter_keeps_told_documents(spark):
    docs = with_extras(documents(spark))
    kept = langid.accepted(docs)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns
    assert not ids & {1, 2, 3, 4} and {9, 20, 60, 90} <= ids
    unlabelled = langid.accepted(docs.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r["doc_id"] for r in unlabelled.collect()} == {d for d, t, *_ in ROWS if t and any(c.isalpha() for c in t)}


# token counts

def test_token_counts(spark, sf_dir):
    pieces = tokencount.vocabulary(public_tokenizers.path(tokencount.VOCABULARY))
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tokencount.SPACE, prepend_scheme="always", split=True)
    want = [(d, len(t or ""), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in ROWS]
    assert collected(spark, "op9_token_counts", sf_dir) == sorted(want, key=key)


def test_ties_and_unknown_runs():
    pieces = [("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("ba", -2.0), ("▁a", -3.0), ("bb", -2.5)]
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tokencount.SPACE, prepend_scheme="always", split=True)
    counter, pick = tokencount.Counter(pieces), np.random.default_rng(2)
    for _ in range(3000):
        text = "".join(pick.choice(list("aabb x中"), int(pick.integers(0, 12))))
        assert counter.text(text) == len(library.encode(text, add_special_tokens=False).ids), text
