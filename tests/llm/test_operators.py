"""Corpus operators against brute force on small frames: nulls, empty and long texts, ties, repeats, clashing names."""

import math
import os
import random
import re
import zlib
from collections import Counter
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from facetwise.llm import exact, graph, katz, language, licenses, lines, packing, pieces, simhash, substrings, vectors
from facetwise.llm.common import slices

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, part long, key string, hash long"


def frame(spark, docs):
    """Documents with columns whose names operators use inside."""
    return spark.createDataFrame([(d, t, 1, "k", 2) for d, t in docs], DOCS).repartition(3)


def words_of(text):
    return re.findall(r"[^ \t-\r]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------- 1 lines


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def edited(rng, s):
    i, k = rng.randrange(len(s) + 1), rng.random()
    return s[:i] + "zé"[k < 0.5] + s[i + (k > 0.3) :] if k < 0.8 else s[:i] + s[i + 1 :]


def test_lines_within_one_edit(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("abé ") for _ in range(n)) for n in (3, 4, 5, 6, 17, 255, 256, 257, 520, 3000) for _ in range(2)]
    docs = []
    for d in range(40):
        some = [rng.choice(base) for _ in range(rng.randint(0, 9))]
        docs.append((d, "\n".join(edited(rng, edited(rng, s)) if rng.random() < 0.3 else edited(rng, s) if rng.random() < 0.5 else s for s in some)))
    docs += [(100, None), (101, ""), (None, base[4]), (102, "Page 1 of 9\nPage 2 of 9\nPage 3 of 9"), (102, "Page 1 of 9\nPage 2 of 9\nPage 3 of 9")]
    got = {(r.doc_id, r.line_no): tuple(r.origin) for r in lines.duplicate_lines(frame(spark, docs)).collect()}
    places = sorted({(d, i, s) for d, t in docs if d is not None and t is not None for i, s in enumerate(t.split("\n")) if s.strip(" ")})
    want = {}
    for n, (d, i, s) in enumerate(places):
        for e, j, o in places[:n]:
            if (e, j) != (d, i) and (o == s or len(o) >= 5 and len(s) >= 5 and one_edit(o, s)):
                want[d, i] = (e, j)
                break
    assert got == want and len(want) > 50

    texts = {r.doc_id: r.text for r in lines.without_duplicate_lines(frame(spark, docs)).collect()}
    for d, t in docs:
        if d is not None:
            assert texts[d] == (t and "\n".join(s for i, s in enumerate(t.split("\n")) if (d, i) not in want))
    assert texts[None] == base[4]
    assert lines.duplicate_lines(empty(spark)).count() == 0


# ---------------------------------------------------------------- 2 pieces


@pytest.fixture(scope="module")
def piece_model():
    return public_tokenizers.path("piece_bpe_32k.model")


TEXTS = ["", " ", "a", "Hello  world\n\nfoo", "x" * 900, "déjà vu 日本語 \U0001f600 " * 40, "   lead", "a\tb\u0000c", "the " * 300, "ab" * 333 + " tail"]


def test_pieces_do_not_depend_on_chunks_and_come_back(spark, piece_model):
    docs = [*enumerate(TEXTS), (50, None), (51, TEXTS[5]), (51, TEXTS[4]), (None, TEXTS[4])]
    one = pieces.digests(*pieces.encode_parts(frame(spark, docs), piece_model), piece_model)
    many = pieces.digests(*pieces.encode_parts(frame(spark, docs), piece_model, chunk=37), piece_model)
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(one) == key(many)
    import hashlib

    assert sorted(r.text_sha256 for r in one.collect()) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in docs)
    assert pieces.encode(empty(spark), piece_model).count() == 0


def test_pieces_have_the_best_sum(piece_model):
    """Against all ways to cut, worked out from the end of the text."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    score = {library.id_to_piece(i): max(pieces.LOWEST, library.get_score(i)) for i in range(259, len(library))}
    lexicon = pieces.Lexicon(piece_model)
    rng = random.Random(3)
    for _ in range(100):
        text = pieces.prepared(" ".join("".join(rng.choice("abcdefghinorstu") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 6))))
        best = [0.0] * (len(text) + 1)
        for i in range(len(text) - 1, -1, -1):
            best[i] = max(score[text[i:j]] + best[j] for j in range(i + 1, len(text) + 1) if text[i:j] in score)
        ids = lexicon.whole(text)
        assert "".join(library.id_to_piece(i) for i in ids) == text
        assert sum(library.get_score(i) for i in ids) == best[0]


def test_segments_side_by_side_are_cut_as_one_by_one(piece_model):
    """Sums and ids of many texts at once, with unknown letters, long segments, repeats and empty texts."""
    lexicon = pieces.Lexicon(piece_model)
    rng = random.Random(5)
    odd = ["".join(rng.choice("aeinst\n \u2581\u65e5\ud7fb\U0001f600") for _ in range(rng.randint(0, 150))) for _ in range(60)]
    texts = [pieces.prepared(t) for t in [*TEXTS, *odd, *odd[:5], "q" * 300 + " and"]]
    for text, (total, ids) in zip(texts, lexicon.paths(texts)):
        begins = [*np.flatnonzero(pieces.segment_starts(pieces.code_points(text))).tolist(), len(text)] if text else [0]
        each = [lexicon.segment(text[a:b]) for a, b in zip(begins, begins[1:])]
        assert (total, ids) == (sum(v for v, _ in each), b"".join(i for _, i in each))


def test_portions_keep_all_rows():
    batch = pa.record_batch([pa.array(range(7)), pa.array(["a" * 10, None, "", "b" * 100, "c", "d" * 9, ""])], ["id", "text"])
    for limit in (1, 10, 50, 1000):
        cut = list(pieces.portions(iter([batch, batch.slice(0, 0)]), "text", limit))
        assert pa.Table.from_batches(cut).equals(pa.Table.from_batches([batch]))
        assert all(c.num_rows == 1 or sum(len(t.as_py() or "") for t in c.column("text")) <= limit for c in cut)


def test_states_of_chunks_join_up(piece_model):
    lexicon = pieces.Lexicon(piece_model)
    text = pieces.prepared("internationalisation of uncharacteristically long words")
    for size in (1, 2, 5, 16, 30):
        cut = [(text[s : s + size], text[s + size : s + size + lexicon.longest - 1]) for s in range(0, len(text), size)]
        states = pieces.boundary_states([lexicon.matrix(*c) for c in cut])
        ids = [i for c, a, b in zip(cut, states, states[1:]) for i in lexicon.ids(*c, a, b)]
        assert ids == lexicon.whole(text)


# ---------------------------------------------------------------- 3 vectors


def brute_vectors(rows):
    ok = [v is not None and lab is not None and i is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v, lab in rows]
    links = [[] for _ in rows]
    for a, (i, u, la) in enumerate(rows):
        for b, (j, v, lb) in enumerate(rows):
            if a != b and ok[a] and ok[b] and la == lb and len(u) == len(v):
                x, y = np.array(u) / np.abs(u).max(), np.array(v) / np.abs(v).max()
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[a].append(b)
    out = []
    for a, (i, _, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out.append((i, len(links[a]), i if len(seen) == 1 else min(rows[b][0] for b in seen)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [2048, 16])
def test_vectors_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = []
    for c in range(30):
        centre = rng.standard_normal(24)
        for _ in range(12):
            rows.append((len(rows), (centre + rng.standard_normal(24) * rng.choice([0.05, 0.2, 0.3])).tolist(), int(c % 3)))
    rows += [(900 + k, rows[0][1], rows[0][2]) for k in range(40)]
    rows += [(950, [x * 1e300 for x in rows[1][1]], rows[1][2]), (951, None, 1), (952, [0.0] * 24, 1), (953, [float("nan")] * 24, 1)]
    rows += [(954, [None] * 24, 1), (955, rows[2][1], None), (956, [], 1), (957, [1.0], 1), (958, [2.0], 1), (959, [float("inf")] * 24, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit(0))
    found = vectors.near_vectors(df).collect()
    got = sorted([(r.vec_id, r.n_links, r.component_id) for r in found], key=str)
    want = brute_vectors(rows)
    links = [sum(x[1] for x in some) for some in (got, want)]
    assert links[1] * 0.99 <= links[0] <= links[1] and sum(a == b for a, b in zip(got, want)) >= 0.99 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert vectors.near_vectors(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 4 packing


def test_token_ids_and_sequences(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    texts = ["A.b don't x'S 'S they're it's.'s", "é.̸x ≠ a≠b", "…. ...a 12.5 Ünï-Öx", "ΑΣ ΑΣ. Σ'ΑΣ", "日本語.テ a日.本 'll 'LL!'d", "word " * 5000, "x" * 7000]
    docs = [*enumerate(texts), (20, None), (21, ""), (None, "no id"), (22, "twice"), (22, "twice"), *[(100 + k, "some words here " * (k * 7 % 90)) for k in range(300)]]
    got = packing.packed(frame(spark, docs), path, capacity=512).collect()
    want = Counter()
    for d, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), 512):
            want[d, s, len(ids[s : s + 512]), zlib.crc32(ids[s : s + 512].tobytes()), len(ids), ids[s : s + 512].tobytes()] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, bytes(r.ids)) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_length, r.padded_length))
    for parts in by.values():
        at = 0
        for offset, length, total, padded in sorted(parts):
            assert offset == at
            at += length
            assert padded == (total if total & (total - 1) == 0 else 512)
        assert at == parts[0][2] <= 512
    assert len(by) <= math.ceil(sum(r.length for r in got) / 512 * 1.03) + 1
    assert packing.packed(empty(spark), path).count() == 0


def test_first_fit_decreasing_is_the_plain_rule():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 100):
        sizes = rng.integers(1, 60, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 64)
        room = []
        for i in np.argsort(-sizes, kind="stable"):
            b = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            room += [64] * (b == len(room))
            assert (bins[i], offsets[i]) == (b, 64 - room[b])
            room[b] -= sizes[i]


# ---------------------------------------------------------------- 5 simhash


def fingerprint(text):
    w = [x.encode() for x in words_of(lower(text))]
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_near_groups_against_all_pairs(spark):
    rng = random.Random(7)
    base = [[rng.choice("red green blue Été dog cat sun") + str(rng.randint(0, 30)) for _ in range(80)] for _ in range(12)]
    docs = []
    for d in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "Edit" + str(rng.randint(0, 9))
        docs.append((d, "\t ".join(w)))
    docs += [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "ONE"), (205, "one two"), (None, docs[0][1]), (206, docs[0][1]), (206, docs[0][1])]
    rows = [(d, fingerprint(t)) for d, t in docs]
    label = {f: f for _, f in rows}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= 2 and label[b] < label[a]:
                    label[a], changed = label[b], True
    least = {}
    for d, f in rows:
        if d is not None:
            least[label[f]] = min(d, least.get(label[f], d))
    got = simhash.near_groups(frame(spark, docs)).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((d, f"{f:016x}", least[label[f]]) for d, f in rows)
    assert len(set(least.values())) < len(label)
    assert simhash.near_groups(empty(spark)).count() == 0


def test_anchors_meet_within_two_bits():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**64, 500, dtype=np.uint64)
    flips = [np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64) for _ in range(2)]
    b = a ^ flips[0] ^ flips[1]
    near = [{(i, x) for i, x in zip(*(y.tolist() for y in simhash.anchors(m)))} for m in (a, b)]
    assert {i for i, _ in near[0] & near[1]} == set(range(500))
    assert max(Counter(i for i, _ in near[0]).values()) <= 32


def test_components_of_chains_and_hubs(spark):
    links = [(k, k + 1) for k in range(100, 140)] + [(7, 500 + k) for k in range(60)] + [(3, 3), (None, 4), (500, 140)]
    got = {r.node: r.component_id for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: 7 for n in [7, *range(100, 141), *range(500, 560)]}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 6 katz


@pytest.mark.parametrize("least_part", [2.0**-19, 0.004])
def test_katz_against_a_plain_model(spark, least_part):
    rng = random.Random(9)
    vocab = [f"W{k}é" for k in range(300)]
    docs = [(d, " ".join(rng.choice(vocab[: rng.choice([5, 40, 300])]) for _ in range(rng.randint(0, 60)))) for d in range(120)]
    docs += [(500, None), (501, ""), (502, "never seen words"), (503, "x" * 5000)]
    df = frame(spark, docs)
    fitted = katz.fit(df.where(katz.training_rows()), least_part=least_part)
    got = {r.doc_id: r for r in katz.score(df, fitted).collect()}
    token = lambda t: [*words_of(lower(t)), "</end>"]
    train = [token(t) for d, t in docs if zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    heavy = {w for w in c if c[w] >= max(1, n * least_part)} | {"</end>"}
    cls = lambda w: w if w in heavy else "<rare>"
    pairs = Counter((cls(a), cls(b)) for t in train for a, b in zip(["</end>", *t], t))
    repeats = Counter(pairs.values())
    d = katz.good_turing([repeats[k] for k in range(1, 7)])
    classes = Counter({"<rare>": 0})
    for w in c:
        classes[cls(w)] += c[w]
    uni = {w: (classes[w] + 1) / (n + len(classes)) for w in classes}
    history = {}
    for (a, b), k in pairs.items():
        history.setdefault(a, {})[b] = k

    def p(a, b):
        seen = history.get(a, {})
        total = sum(seen.values())
        q = {w: (d[k] if k <= 5 else 1.0) * k / total for w, k in seen.items()}
        if q and 1 - sum(q.values()) < 1 / (total + 1):
            s = total / (total + 1) / sum(q.values())
            q = {w: x * s for w, x in q.items()}
        open_part = 1 - sum(uni[w] for w in q)
        if open_part < 1e-9:
            return q[b] / sum(q.values())
        return q[b] if b in q else (1 - sum(q.values())) / open_part * uni[b]

    for a in list(history)[:20]:
        assert abs(sum(p(a, b) for b in uni) - 1) < 1e-9  # exactly normalised
    rare = n - sum(c[w] for w in heavy), v - len(heavy)
    for i, t in docs:
        w = token(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10(p(cls(a), cls(b))) + (0 if cls(b) != "<rare>" else math.log10((c[b] + 1) / (sum(rare) + 1))) for a, b in zip(["</end>", *w], w))
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
    assert katz.score(empty(spark), fitted).count() == 0
    nothing = katz.fit(empty(spark))
    assert {r.n_known for r in katz.score(df, nothing).collect()} == {0}


def test_katz_counts_bigrams_of_rare_words(spark):
    """Some 1.2 million tokens, so that a word that occurs once is far below 2^-19 of them."""
    rng = random.Random(12)
    docs = [(d, " ".join(rng.choice("abcdefgh") for _ in range(100_000))) for d in range(12)] + [(20, "a qa qb b"), (21, "c qd qe d")]
    fitted = katz.fit(frame(spark, docs))
    asked = [(1, "a qa qb b"), (2, "a qb qa b"), (3, "a qa qe b"), (4, "a qx qy b")]
    got = {r.doc_id: r for r in katz.score(frame(spark, asked), fitted).collect()}
    assert [got[k].n_known for k in (1, 2, 3, 4)] == [5, 5, 5, 3]
    assert got[1].score > got[3].score + 1 and got[1].score > got[2].score + 1 and got[3].score > got[4].score


@pytest.mark.parametrize("hot_part", [0.004, 0.02, 2.0])
def test_katz_does_not_depend_on_what_is_sent_to_all(spark, hot_part):
    rng = random.Random(10)
    vocab = [f"W{k}é" for k in range(300)]
    docs = [(d, " ".join(rng.choice(vocab[: rng.choice([5, 40, 300])]) for _ in range(rng.randint(0, 60)))) for d in range(120)]
    docs += [(500, None), (501, ""), (502, "never seen words"), (503, "W1é never W2é"), (1, "w1é w2é"), (None, "w3é")]
    df = frame(spark, docs)
    train = df.where(katz.training_rows())
    whole, some = ({r.doc_id: r for r in katz.score(df, katz.fit(train, **k)).collect()} for k in ({"least_part": 2.0**-19}, {"hot_part": hot_part}))
    assert whole.keys() == some.keys()
    for i, a in whole.items():
        b = some[i]
        assert a[:3] == b[:3] and (a.train_tokens, a.base_score, a.score) == (b.train_tokens, pytest.approx(b.base_score), pytest.approx(b.score))


def test_katz_moves_and_stores_little(spark):
    """The disk: a pair that was counted, and a token that is looked up, take a few bytes, hot or cold."""
    rng = random.Random(13)
    text = lambda: " ".join(f"w{int(rng.paretovariate(0.3)) % 5000}" for _ in range(300))
    docs = [(d, text()) for d in range(800)]
    for hot_part in (0.0003, 0.02):
        fitted = katz.fit(frame(spark, docs), hot_part=hot_part)
        tokens = [["</end>", *words_of(t), "</end>"] for _, t in docs]
        pairs = len({p for t in tokens for p in zip(t, t[1:])})
        files = {f for table in fitted if hasattr(table, "inputFiles") for f in table.inputFiles()}
        stored = sum(os.path.getsize(urlparse(f).path) for f in files)
        assert pairs > 50_000 and stored < 9 * pairs, (hot_part, pairs, stored)
        batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], ["doc_id", "text"])
        (part,) = slices(iter([batch]), 12 << 20)
        moved = sum(len(cell) for row in katz._entries(part, fitted.model) for cell in row if isinstance(cell, bytes))
        assert moved < 9 * 301 * len(docs), (hot_part, moved)


def test_katz_arrays_in_cells():
    rng = np.random.default_rng(14)
    least = np.iinfo(np.int64).min
    some = [
        np.empty(0, np.uint64), np.zeros(1000, np.int64), np.array([7], np.uint32), rng.random(3000), np.array([least, -1, 0, 5, 2**62]),
        np.sort(rng.integers(0, 2**64, 5000, np.uint64, endpoint=False)), rng.integers(0, 3, 70).astype(np.uint32), np.array([0, 2**64 - 1], np.uint64),
    ]
    (cell,) = pa.array([katz._cell(*some)])
    for a, b in zip(some, katz._arrays(cell, *[a.dtype for a in some]), strict=True):
        assert a.dtype == b.dtype and a.tobytes() == b.tobytes()
    for keys in (some[4], some[5]):
        (cell,) = pa.array([katz._cell(katz._gaps(keys), some[3])])
        again, rest = katz._sorted_arrays(cell, keys.dtype, float)
        assert (again == keys).all() and (rest == some[3]).all()
    for n in (1, 7, 12, 3000):
        at = katz._bounds(some[5], n)
        assert at[0] == 0 and at[-1] == len(some[5]) and len(at) == n + 1 and at == sorted(at)
        own = [int(k) * n >> 64 for k in some[5]]
        assert own == [b for b, (i, j) in enumerate(zip(at, at[1:])) for _ in range(i, j)]


# ---------------------------------------------------------------- 7 licenses


def test_templates():
    a = licenses.compile_template("x", "licensed under [the|a] (cc|creative commons) by [{v:1} {m:2}]")
    accepted = lambda t: a.accepts(t.encode().split())
    assert [accepted(t) for t in ("licensed under cc by", "licensed under a creative commons by 4 0 x y", "licensed cc by", "licensed under the by")] == [4, 9, 0, 0]
    with pytest.raises(ValueError):
        licenses.compile_template("x", "[open")
    with pytest.raises(ValueError):
        licenses.compile_template("x", "[only] {any:2}").first_words()


def test_license_scan(spark):
    docs = [
        (0, "MIT License, then the (mit-license) again"), (1, "Licensed under the terms of the MIT License."), (2, None), (3, ""),
        (4, "general public  license x APACHE\nLicense"), (5, "générale public license mit"), (6, "Licensed under CC BY-NC 4.0."),
        (7, "license " * 3000 + "mit license"), (None, "all rights reserved"), (8, "mit"), (8, "mit"),
    ]
    got = licenses.scan(frame(spark, docs)).collect()
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    want = []
    for d, t in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        hits = [(i, lab) for p, lab in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want.append((d, len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))))
    assert sorted([tuple(r)[:6] for r in got], key=str) == sorted(want, key=str)
    labels = {r.doc_id: (r.labels, r.score) for r in got}
    assert labels[1] == ("mit", 1.0) and labels[6] == ("cc-by-nc", 1.0) and labels[4] == ("apache,gpl", 0.5)
    assert labels[8] == ("", 0.0) and labels[None] == ("all-rights-reserved", 1.0)
    assert licenses.scan(empty(spark)).count() == 0


# ---------------------------------------------------------------- 8 exact


@pytest.mark.parametrize("bits", [None, 1])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups_even_when_hashes_collide(spark, bits, keep):
    rng = random.Random(4)
    docs = [(d, rng.choice(["a", "b", "A", "", None, "é", "long" * 999])) for d in range(60)] + [(70, "a"), (70, "a"), (None, "b"), (None, "only")]
    weak = {} if bits is None else {"content_hash": lambda t: F.hex(F.length(t) % 2).cast("binary")}
    got = exact.exact_groups(frame(spark, docs), keep=keep, carry={"n": F.length("text")}, **weak).collect()
    groups = {}
    for d, t in docs:
        groups.setdefault(t or "", []).append(d)
    best = max if keep == "largest" else min
    want = Counter()
    for d, t in docs:
        k = best([x for x in groups[t or ""] if x is not None], default=None)
        want[d, k, len(groups[t or ""]), d == k, len(t or "")] += 1
    assert Counter(map(tuple, got)) == want
    assert exact.exact_groups(empty(spark)).count() == 0


def test_exact_lists_hashes_not_rows(spark, monkeypatch):
    """One collided hash with many rows must not hide the others."""
    monkeypatch.setattr(exact, "MAX_LISTED", 5)
    docs = [(d, f"{d:04d}") for d in range(300)] + [(1000 + d, "x" * (5 + 2 * d)) for d in range(6)]
    df = spark.createDataFrame([(d, t, 1, "k", 2) for d, t in docs], DOCS).coalesce(1)
    got = exact.exact_groups(df, content_hash=lambda t: F.hex(F.length(t) % 2).cast("binary")).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(d, d, 1) for d, _ in docs]


# ---------------------------------------------------------------- 9 passages


def test_passages_against_all_windows(spark):
    rng = random.Random(2)
    vocab = ["a", "b", "çé", "longerwordthan8bytes"]
    base = [[rng.choice(vocab) for _ in range(rng.randint(5, 90))] for _ in range(8)]
    docs = []
    for d in range(60):
        w = []
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            i = rng.randrange(len(b))
            w += b[i : i + rng.randint(1, 60)] if rng.random() < 0.7 else [rng.choice(vocab) for _ in range(rng.randint(1, 15))]
        docs.append((d, " \n".join(w)))
    docs += [(90, None), (91, ""), (92, "  "), (93, "a b " * 300), (94, "x a b " + "a b " * 40), (95, "é" * 9000)]
    first, want = set(), {}
    for d, t in docs:
        w, gone = words_of(t), set()
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            gone |= set(range(p, p + 20)) if k in first else set()
            first.add(k)
        want[d] = (" ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone))
    got = {r.doc_id: (r.text, r.n_words, r.n_removed) for r in substrings.without_repeats(frame(spark, docs)).collect()}
    assert got == want and sum(x[2] for x in want.values()) > 500
    again = substrings.without_repeats(frame(spark, [(None, "w " * 30), (1, "w " * 30), (1, "w " * 30)])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in again) == [("1", 30), ("1", 30), ("None", 29)]
    assert substrings.without_repeats(empty(spark)).count() == 0


# ---------------------------------------------------------------- 10 languages


def test_languages_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    model = language.fit(docs.where(language.training_rows()))
    assert sorted(model) == ["de", "en", "es", "fr"]
    held = docs.where(~language.training_rows())
    got = {r.doc_id: r for r in language.identify(held, model).collect()}
    right = [got[r.doc_id].lang_pred == r.lang for r in held.collect()]
    assert sum(right) >= 0.95 * len(right)
    assert sum(r.rejected for r in got.values()) <= 0.02 * len(got)


def test_languages_at_the_edges(spark):
    model = {"xx": b"alpha beta gamma " * 50, "yy": b"uno due tre quattro " * 50}
    docs = [(1, None), (2, ""), (3, "123 !?"), (4, "ALPHA beta gamma alpha"), (5, "uno due tre " * 9000), (None, "uno due tre quattro uno due tre"), (6, "q"), (6, "q")]
    got = sorted(((r.doc_id or 0, r.lang_pred, r.rejected) for r in language.identify(frame(spark, docs), model).collect()), key=str)
    assert got == sorted([(1, "und", True), (2, "und", True), (3, "und", True), (4, "xx", False), (5, "yy", False), (0, "yy", False), (6, "xx", True), (6, "xx", True)], key=str)
    assert {r.lang_pred for r in language.identify(frame(spark, docs), {}).collect()} == {"und"}
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.fit(none) == {} and language.identify(none, model).count() == 0
    rows = language.identify(frame(spark, docs), model, whole_row=True).select("row.*")
    assert rows.columns == frame(spark, docs).columns


def test_long_texts_of_one_language_are_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs.where(language.training_rows()))
    texts = {}
    for r in docs.where(~language.training_rows()).where("text IS NOT NULL").orderBy("doc_id").collect():
        texts.setdefault(r.lang, []).append(r.text)
    long = [(k, (lang, ("\n".join(t) * (5_000_000 // sum(map(len, t)) + 1))[:5_000_000])) for k, (lang, t) in enumerate(sorted((x for x in texts.items() if x[0] in model)))]
    assert len(long) >= 4
    got = {r.doc_id: r for r in language.identify(frame(spark, [(k, t) for k, (_, t) in long]), model).collect()}
    for k, (lang, _) in long:
        assert got[k].lang_pred == lang and not got[k].rejected and got[k].score > 0.02


def test_pieces_of_a_text_are_whole_characters():
    for text in ("", "a", "日本語é" * 9000, "x" * language.PIECE_BYTES):
        cut = language.pieces_of(text.encode())
        assert "".join(p.decode() for p in cut) == text and max(map(len, cut)) <= language.PIECE_BYTES + 4
