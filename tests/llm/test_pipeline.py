"""Registered corpus queries against their SQL, and the pipeline's stages one by one."""

import re
import zlib

import check
import pytest

import corpus_pipeline
from facetwise.llm import queries

OPERATORS = sorted(n for n in queries.QUERIES if n.startswith("op"))


@pytest.fixture(scope="module")
def duck(sf_dir):
    return check.connect(sf_dir)


@pytest.mark.parametrize("name", OPERATORS)
def test_query(spark, duck, sf_dir, name):
    verdict, _ = check.compare(spark, duck, sf_dir, name, queries.QUERIES[name], queries.ORACLES.get(name))
    assert verdict.startswith(("ok", "rows-only")), verdict


def test_all_are_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in OPERATORS} == set(range(1, 14))
    assert "pipeline" in queries.QUERIES and corpus_pipeline.ORACLE_SQL is None


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def without_lines(docs):
    """Brute force: lines within one edit of an earlier one go."""
    seen, out = [], {}
    for d in sorted(docs):
        kept = []
        for line in docs[d].split("\n"):
            near = line.strip(" ") and any(s == line or min(len(s), len(line)) >= 5 and one_edit(s, line) for s in seen)
            kept += [] if near else [line]
            seen += [line] if line.strip(" ") else []
        out[d] = "\n".join(kept)
    return out


def without_passages(docs):
    first, out = set(), {}
    for d in sorted(docs):
        w = re.findall(r"[^ \t-\r]+", docs[d])
        gone = set()
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            gone |= set(range(p, p + 20)) if k in first else set()
            first.add(k)
        out[d] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else docs[d]
    return out


def test_stages_against_brute_force(spark, sf_dir):
    """Each stage on what the one before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120).cache()
    stages = dict(corpus_pipeline.STAGES)
    text = lambda df: {r.doc_id: r.text for r in df.collect()}

    found = stages["language"](spark, docs, sf_dir).cache()
    assert found.columns == docs.columns
    assert len(text(found)) >= 0.97 * docs.count() and text(found).items() <= text(docs).items()

    lined = stages["lines"](spark, found, sf_dir).cache()
    assert lined.columns == docs.columns and text(lined) == without_lines(text(found))
    assert all(r.n_chars == len(r.text) for r in lined.collect())

    single = stages["near_duplicates"](spark, lined, sf_dir).cache()
    from facetwise.llm import simhash

    groups = {}
    for r in simhash.near_groups(lined).collect():
        groups.setdefault(r.component_id, []).append(r.doc_id)
    assert sorted(text(single)) == sorted(min(g) for g in groups.values()) and text(single).items() <= text(lined).items()

    passages = stages["passages"](spark, single, sf_dir).cache()
    assert passages.columns == docs.columns and text(passages) == without_passages(text(single))

    packed = stages["packing"](spark, passages, sf_dir).collect()
    tokens = {}
    for r in packed:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
        assert r.length <= 2048
    assert tokens == {r.doc_id: r.doc_tokens for r in packed} and sorted(tokens) == sorted(text(passages))


def test_stages_take_nulls_repeats_and_more_columns(spark, sf_dir):
    rows = [(1, None, None, None), (None, "no id at all here", "en", 3), (2, "the same text twice", "en", 1), (2, "the same text twice", "en", 1), (3, "", "fr", 0)]
    rows += [(k, f"some words about number {k} and others {k * 7}", "en", 1) for k in range(10, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").selectExpr("*", "'x' AS row", "1 AS part")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
        stage(spark, docs, sf_dir).collect()
    assert stage(spark, docs, sf_dir).count() == len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == len(rows)
    assert zlib.crc32(b"") == 0
