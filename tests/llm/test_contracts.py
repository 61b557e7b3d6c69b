"""Contracts at the edges: repeated and null ids, added tokens of the tokenizer, predictions told again plainly."""

import random
import zlib

import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

from facetwise.llm import language, packing, queries

DOCS = "doc_id long, text string, lang string"


def test_dictionary_keeps_its_bound_with_repeated_and_null_ids(spark):
    rows = [(7 if i % 2 else None, f"{w} text number {i} {w}", w) for i in range(300) for w in ("aa", "bb")]
    frame = spark.createDataFrame(rows + [(9, None, "aa"), (10, "12 34", "bb"), (11, "no language", None)], DOCS)
    model = language.fit(frame, texts=4, chars=100)
    assert sorted(model) == ["aa", "bb"] and all(1 <= raw.count(b"number") <= 4 for raw in model.values())
    assert all(other not in model[w] for w, other in (("aa", b"bb"), ("bb", b"aa")))
    assert language.fit(frame.repartition(7, "text"), texts=4, chars=100) == model


def test_held_out_is_never_null(spark, tmp_path):
    rows = [(None, "some words of a text", "en"), (3, None, "en"), (3, "quelques mots", "fr"), (8, "some words", None)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op10_language_id(spark, str(tmp_path)).collect()
    crc = {None: False} | {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in (3, 8)}
    assert len(found) == 4 and all(r["held_out"] is crc[r["doc_id"]] for r in found)


def test_predictions_told_again_plainly(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit(docs.where(language.training_rows()))
    names = sorted(model)

    def size(text, name, level):
        d = zstandard.ZstdCompressionDict(model[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        coder = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        raw, n = text.lower().encode(), -(-len(text.lower().encode()) // 8192) or 1
        cuts = [len(raw) * k // n for k in range(n + 1)]
        for k in range(1, n):
            while 0x80 <= raw[cuts[k]] < 0xC0:
                cuts[k] -= 1
        return sum(len(coder.compress(raw[a:b])) for a, b in zip(cuts, cuts[1:]))

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in language.identify(docs, model).where("doc_id % 5 = 0").collect():
        text = texts[r["doc_id"]]
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        sizes = [size(text, n, 9) for n in names]
        best, second = sorted(sizes)[:2]
        if second - best < 0.03 * second:
            sizes = [s + size(text, n, 12) for s, n in zip(sizes, names)]
            best, second = sorted(sizes)[:2]
        assert r["lang_pred"] == names[sizes.index(best)]
        assert r["score"] == pytest.approx(1 - best / second) and r["rejected"] == (1 - best / second < 0.005)


def test_added_tokens_inside_texts(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rng = random.Random(5)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "|>", "<|", " ", "\n", "Hello", "it's", "a", "!", "\u00e9", "12"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(600)]
    # Side by side in memory, two documents must not make a token.
    texts += ["hello <|endoftext|> world", "x <|endof", "text|> y", "<|endoftext|>", "", None]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {r["doc_id"]: r for r in packing.pieces(frame, path).collect()}
    for i, text in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert bytes(found[i]["ids"]) == raw and found[i]["doc_tokens"] == len(ids), text
        assert found[i]["ids_crc32"] == zlib.crc32(raw)
