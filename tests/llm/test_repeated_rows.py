"""Rows that repeat an id: as copies, and with different texts."""

import hashlib
import random

import public_tokenizers
import pytest

from facetwise.llm import pieces, substrings

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def piece_model():
    return public_tokenizers.path("piece_bpe_32k.model")


def test_long_texts_of_one_id_come_back_row_by_row(spark, piece_model):
    long, other = "some words of a text " * 40, "quite another text " * 45
    docs = [(1, long), (1, long), (1, other), (None, long), (None, long), (None, None), (2, "short"), (2, "short")]
    short, cut = pieces.encode_parts(spark.createDataFrame(docs, DOCS), piece_model, chunk=100)
    got = sorted(map(tuple, pieces.digests(short, cut, piece_model).collect()), key=str)
    whole = pieces.digests(*pieces.encode_parts(spark.createDataFrame(docs, DOCS), piece_model), piece_model)
    assert got == sorted(map(tuple, whole.collect()), key=str)
    hashes = sorted((str(d), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in docs)
    assert sorted((str(r[0]), r[3]) for r in got) == hashes
    texts = {}
    for r in sorted(pieces.decode(cut, piece_model).collect(), key=lambda r: r.chunk_no):
        key = (r.doc_id, r.text_key, r.copies)
        texts[key] = texts.get(key, "") + r.text
    assert sorted((str(d), c, t) for (d, _, c), t in texts.items()) == sorted([("1", 2, long), ("1", 1, other), ("None", 2, long)])


@pytest.mark.parametrize("whole_row", [False, True])
def test_passages_of_different_texts_under_one_id(spark, whole_row):
    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    w, z, y = text(), text(), text()
    docs = [(1, w), (2, w), (2, z), (3, y), (3, y), (None, z + " " + y), (None, y), (None, None), (4, w)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], f"{DOCS}, tag string, shared int")
    got = sorted((str(r.doc_id), r.text, r.n_words, r.n_removed) for r in substrings.without_repeats(frame, whole_row=whole_row).collect())
    rest = [r for r in got if r[0] != "None"]
    # z and y stand in rows without an id, which come first.
    assert rest == sorted([("1", w, 30, 0), ("2", "", 30, 30), ("2", "", 30, 30), ("3", "", 30, 30), ("3", "", 30, 30), ("4", "", 30, 30)])
    # Which of two texts without an id keeps y is told by their hashes; z stays, y stays once.
    kept = " ".join(r[1] for r in got if r[0] == "None").split()
    assert sorted(kept) == sorted((z + " " + y).split())


def test_unique_text_of_a_repeated_id_stays(spark):
    rng = random.Random(6)
    w, z = (" ".join(f"v{rng.randrange(10**6)}" for _ in range(40)) for _ in range(2))
    got = substrings.without_repeats(spark.createDataFrame([(1, w), (2, w), (2, z), (2, z)], DOCS)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(1, w), (2, ""), (2, z), (2, z)])
