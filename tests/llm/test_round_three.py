"""Phrases, decontamination and resampling against brute force: nulls, empty and long texts, ties, repeats, clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from facetwise.llm import decontamination, phrases, resampling

DOCS = "doc_id long, text string, lang string, key string, seg long, n long, phrase string, spans long"


def frame(spark, docs):
    """(doc_id, text, lang) rows with columns whose names operators use inside."""
    return spark.createDataFrame([(d, t, g, "k", 2, 3, "p", 4) for d, t, g in docs], DOCS).repartition(3)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


# ---------------------------------------------------------------- 11 phrases


def brute_phrases(docs, max_words, min_count, contained, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for s in range(1, max_words + 1):
                for i in range(len(w) - s + 1):
                    f[lang][tuple(w[i : i + s])] += 1
    out = set()
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        rows = []
        for p, a in good.items():
            cuts = [(2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            outer = [b for q, b in good.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= contained * a for b in outer):
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return out


def some_texts(seed, rows=60):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "the", "of", "dög", "日本", "x1", "it's", "-", "\x00q", "zz"]
    fixed = ["the art of war", "New York City hall", "a b a b a b"]
    out = []
    for d in range(rows):
        parts = [rng.choice(vocabulary) if rng.random() < 0.7 else rng.choice(fixed) for _ in range(rng.randint(0, 60))]
        text = "".join(p + rng.choice([" ", " ", "\t", "  ", ", ", ". ", "\n", " "]) for p in parts)
        out.append((d, text, rng.choice(["en", "fr", None, "und"])))
    return [*out, (500, None, "en"), (501, "", "en"), (None, out[3][1], "en"), (None, out[3][1], "en"), (7, out[7][1], out[7][2])]


@pytest.mark.parametrize("bits, max_words", [(64, 4), (7, 4), (64, 2), (5, 3)])
def test_phrases_against_counting(spark, bits, max_words):
    """Symbols of a few bits make words share fingerprints, which has to change nothing."""
    docs = some_texts(bits)
    got = phrases.collocations(frame(spark, docs), max_words=max_words, min_count=4, top=25, bits=bits, limit=300)
    want = brute_phrases(docs, max_words, 4, 80, 25)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20


def test_phrases_of_long_pieces_hot_words_and_no_rows(spark):
    long = "one two three " * 3000 + "end. " + "one two " * 2000
    docs = [(1, long, "en"), (2, long, "en"), (3, "one two three", "de")]
    got = phrases.collocations(frame(spark, docs), min_count=3, limit=1000, hot=2)
    assert {tuple(r) for r in got.collect()} == brute_phrases(docs, 4, 3, 80, 2000)
    assert phrases.collocations(frame(spark, [])).count() == 0
    counts, totals = phrases.phrase_counts(frame(spark, [(1, None, None), (2, " .,", "en")]))
    assert counts.count() == 0 and totals.count() == 0


def test_scores_stay_exact_past_64_bits(spark):
    a = 9_223_372_036_854
    got = spark.sql(f"SELECT {a}L AS a, {a}L AS l, {a + 3}L AS r").select(F.expr("2000000 * CAST(a AS DECIMAL(20, 0)) div (l + r)").cast("long"))
    assert got.first()[0] == 2000000 * a // (2 * a + 3)


# ---------------------------------------------------------------- 12 decontamination


def test_index_finds_what_stands_there():
    rng = np.random.default_rng(5)
    for n, top in ((1, 2), (7, 2), (300, 3), (5000, 4), (3000, 2000), (900, 1)):
        s = rng.integers(1, top + 1, n)
        s[n // 2 :] = s[: n - n // 2]  # a long repeat
        order = decontamination.suffix_array(np.append(s, 0))
        whole = [*s.tolist(), 0]
        assert order.tolist() == sorted(range(n + 1), key=lambda i: whole[i:]) if n <= 900 else len(set(order.tolist())) == n + 1
        index = decontamination.FMIndex(s)
        starts = rng.integers(0, n, 20)
        sizes = np.minimum(rng.integers(1, 6, 20), n - starts)
        lines = np.zeros((20, 5), np.int64)
        for line, i, m in zip(lines, starts, sizes):
            line[5 - m :] = s[i : i + m]
        low, high = index.search(lines, sizes)
        for line, m, a, z in zip(lines, sizes, low, high):
            want = [i for i in range(n - m + 1) if (s[i : i + m] == line[5 - m :]).all()]
            assert sorted(index.places(np.arange(a, z)).tolist()) == want


def brute_hits(docs, items, width):
    windows = defaultdict(set)
    for item, text in items:
        w = plain_words(text)
        for i in range(max(len(w) - width, 0) + 1 if w else 0):
            windows[tuple(w[i : i + width])].add("" if item is None else str(item))
    out = []
    for d, text, *_ in docs:
        w, hit, found = plain_words(text), set(), set()
        for i in range(len(w)):
            for n in range(1, width + 1):
                if i + n <= len(w) and (p := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[p]
        spans = [(i, next(j for j in range(i, len(w) + 1) if j not in hit)) for i in sorted(hit) if i - 1 not in hit]
        out.append((d, len(w), tuple(spans), tuple(sorted(found))))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1 << 17, 5])
def test_spans_against_search(spark, block):
    rng = random.Random(block)
    words = ["red", "Fish", "été", "4", "of", "sea", "日本"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, some(rng.choice([1, 4, 5, 9, 12]) + 3 * (i % 2))) for i in range(12)]
    items += [(3, "another one of the same name"), (None, "no name at all here"), (77, None), (78, " -- "), (80, items[4][1])]
    docs = []
    for d in range(30):
        text = some(rng.randint(0, 60))
        if d % 3:
            text += rng.choice([" ", "\n--", ", "]) + (rng.choice(items)[1] or "") + " " + some(3)
        docs.append((d, text.upper() if d % 5 == 0 else text, "en"))
    docs += [(100, None, "en"), (101, "", None), (102, "...", None), docs[4], docs[4], (None, docs[5][1], "x"), (103, (some(30) + " ") * 40, "en")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(frame(spark, docs), asked, width=6, block=block)
    key = sorted(((r.doc_id, r.n_words, tuple(map(tuple, r.spans)), tuple(r["items"])) for r in got.collect()), key=str)
    assert key == brute_hits(docs, items, 6)
    assert sum(len(r[2]) > 0 for r in key) > 10

    cleaned = {r.doc_id: r.text for r in decontamination.clean_texts(frame(spark, docs), got).collect()}
    for d, n, spans, _ in key:
        text = next(t for i, t, _ in docs if i == d) or ""
        if not spans:
            assert cleaned[d] == text
        gone = {k for a, z in spans for k in range(a, z)}
        assert plain_words(cleaned[d]) == [w for k, w in enumerate(plain_words(text)) if k not in gone]


def test_spans_do_not_depend_on_shards(spark, monkeypatch):
    rng = random.Random(8)
    text = " ".join(rng.choice("abc") for _ in range(4000))
    asked = spark.createDataFrame([(1, text[1000:1020]), (2, "a b a"), (3, text[:10])], "item_id long, text string")
    rows = [(r["phrase"], r["items"]) for r in decontamination.windows(asked, 6).collect()]
    known = decontamination.phrases_of(rows, 6)
    batch = [pa.RecordBatch.from_arrays([pa.array([1, None]), pa.array(["x", "y"]), pa.array([text, text[:2000]])], ["doc_id", "text_md5", "text"])]

    class Held:
        value = known

    one = [b.to_pydict() for b in decontamination._search(Held)(iter(batch))]
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 37)
    assert [b.to_pydict() for b in decontamination._search(Held)(iter(batch))] == one


def test_no_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.contamination(frame(spark, [(1, "a b", "en")]), none).first()
    assert (got.doc_id, got.n_words, got.spans, got["items"]) == (1, 2, [], [])
    assert decontamination.contamination(frame(spark, []), none).count() == 0


# ---------------------------------------------------------------- 13 resampling


def brute_draw(docs, target, max_n, buckets, percent, min_words):
    def features(text):
        w = plain_words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]

    raw = [(d, len(plain_words(t)), features(t)) for d, t, _ in docs]
    s = Counter(x for _, _, f in raw for x in f)
    t = Counter(x for text in target for x in features(text))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    rows = []
    for (d, n, f), (_, text, _) in zip(raw, docs):
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in f) // len(f) if f else 0
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append([d, len(f), weight, score, n, hashlib.md5((text or "").encode()).digest()])
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[5]))
    rank = {id(r): i for i, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


@pytest.mark.parametrize("max_n", [1, 3])
def test_draw_against_counting(spark, max_n):
    rng = random.Random(max_n)
    words = ["red", "Fish", "été", "4", "of", "sea", "日本", "blue"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [some(rng.randint(1, 9)) for _ in range(5)]
    docs = [(d, "\n".join(rng.choice(shared) if rng.random() < 0.5 else some(rng.randint(0, 8)) for _ in range(rng.randint(0, 12))), "en") for d in range(80)]
    docs += [(200, None, None), (201, "", None), (202, "\n\n", None), (203, "..\n" * 50 + "sea", "en"), (204, "one\ntwo\n\nthree", None)]
    docs += [docs[5], docs[5], (None, docs[6][1], "en"), (None, docs[6][1], "en"), (None, docs[7][1], "en"), (300, "sea " * 5000, "en")]
    target = [shared[0], some(30) + "\n" + some(4), None, ""]
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(frame(spark, docs), asked, percent=40, min_words=8, seed="7", max_n=max_n, buckets=50)
    key = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()), key=str)
    assert key == brute_draw(docs, target, max_n, 50, 40, 8)
    assert resampling.drawn_documents(frame(spark, docs), got).where("doc_id = 5").count() in (0, 3)


def test_draw_from_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(frame(spark, []), none).count() == 0
    got = resampling.resample(frame(spark, [(1, "a b c", "en")]), none, percent=100, min_words=1).first()
    assert (got.n_words, got.n_features, got["rank"]) == (3, 3, 1)


def test_crc_of_spans():
    raw = bytes(range(256)) * 3
    start, length = np.array([0, 5, 100, 9]), np.array([4, 0, 300, 1])
    got = resampling.crc32s(np.frombuffer(raw, np.uint8), start, length).tolist()
    assert got == [zlib.crc32(raw[a : a + n]) for a, n in zip(start, length)]
