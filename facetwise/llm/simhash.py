"""SimHash near duplicates: 64-bit fingerprints linked through the words of a covering code.

Anchors are the words of the Hamming code of 63 bits. The code is perfect: every 63-bit string lies
within one bit (the covering radius) of exactly one word. Two fingerprints that differ in two bits or
fewer have a string halfway, at most one bit from either, and its anchor lies within two bits of both.
So each fingerprint goes to all anchors within the covering radius plus half the threshold (at most
32), and fingerprints are compared only where they meet. The last bit is left to the comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from facetwise.llm import graph
from facetwise.llm.common import LOWER, SPACES, ids_array, plain, slices, split_words, stored

THRESHOLD = 2
SHINGLE = 3
SEED = 42
#: Shingles that a task holds the single bits of; their counts fit 16 bits.
BLOCK = 1 << 14


# ---------------------------------------------------------------- fingerprints


def _shingle_hashes(raw: bytes, start: np.ndarray, length: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hashes of the shingles of one document's words, ``BLOCK`` shingles at a time."""
    digest, found = xxhash.xxh64_intdigest, [np.empty(0, np.uint64)]
    for begin in range(0, max(len(start) - size + 1, min(len(start), 1)), BLOCK):
        some = slice(begin, begin + BLOCK + size - 1)
        words = [raw[a : a + n] for a, n in zip(start[some].tolist(), length[some].tolist())]
        text, ends = b" ".join(words), np.cumsum(length[some] + 1)
        spans = zip((ends - length[some] - 1).tolist(), (ends - 1)[min(size, len(words)) - 1 :].tolist())
        found.append(np.array([digest(text[a:b], seed) for a, b in spans], np.uint64))
    return np.concatenate(found)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes the number whose bits are set in over half of them."""
    ones, owner = np.zeros((len(counts), 64), np.int64), np.repeat(np.arange(len(counts)), counts)
    for begin in range(0, len(hashes), BLOCK):
        some, of = hashes[begin : begin + BLOCK], owner[begin : begin + BLOCK]
        bits = np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = np.flatnonzero(np.diff(of, prepend=-1))
        ones[of[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.uint16)
    packed = np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8").ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                 seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint long) of whole texts: A-Z in lower case, words between ASCII white space,
    shingles of ``size`` words with repeats. Fewer words: the whole sequence. No word: zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1 << 20):
            low = LOWER[part.data]
            words, raw = split_words(part._replace(data=low), SPACES), low.tobytes()
            spans = zip(words.first[:-1].tolist(), words.first[1:].tolist())
            each = [_shingle_hashes(raw, words.start[a:b], words.length[a:b], size, seed) for a, b in spans]
            marks = majority(np.concatenate(each), np.array([len(x) for x in each])).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids_array(part.ids), pa.array(marks)], ["doc_id", "fingerprint"])

    return plain(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint long")


# ---------------------------------------------------------------- anchors


def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Bit k of the 63 has column k + 1: the six syndrome bits as parity masks, and by column the bit."""
    masks = np.array([sum(1 << k for k in range(63) if (k + 1) >> j & 1) for j in range(6)], np.uint64)
    flip = np.array([0] + [1 << k for k in range(63)], np.uint64)
    return masks, flip


def anchors(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint (uint64) all code words within two bits of its first 63: (index, anchor)."""
    masks, flip = _syndromes()
    body = marks & np.uint64((1 << 63) - 1)
    syndrome = np.zeros(len(body), np.int64)
    for j, m in enumerate(masks):
        syndrome |= (np.bitwise_count(body & m) & 1).astype(np.int64) << j
    index, found = [np.arange(len(body))], [body ^ flip[syndrome]]
    # A word two bits away has columns c and c ^ syndrome, both not zero.
    for c in range(1, 64):
        other = syndrome ^ c
        ok = np.flatnonzero((syndrome > 0) & (other > c))
        index.append(ok)
        found.append(body[ok] ^ flip[c] ^ flip[other[ok]])
    return np.concatenate(index), np.concatenate(found)


def _links_of(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what lies within the threshold, from each fingerprint to the smallest it
    reaches here. Around one anchor there are at most 4,034 fingerprints, whatever the input."""
    label = np.arange(len(marks))
    near = [np.flatnonzero(np.bitwise_count(marks ^ m) <= THRESHOLD) for m in marks]
    while True:
        new = np.array([label[n].min() for n in near])
        new = new[new]
        if (new == label).all():
            break
        label = new
    away = label != np.arange(len(marks))
    return marks[away], marks[label[away]]


def fingerprint_links(marks: DataFrame) -> DataFrame:
    """Links (a, b) among distinct fingerprints, column ``fingerprint``, that connect exactly those
    connected by steps of two bits or fewer."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            index, found = anchors(values.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(values[index])], ["anchor", "fingerprint"])

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            a, f = frame["anchor"].to_numpy(), frame["fingerprint"].to_numpy()
            if rest is not None:
                a, f = np.concatenate([rest[0], a]), np.concatenate([rest[1], f])
            cut = int(np.searchsorted(a, a[-1], "left"))  # the last anchor may go on
            rest = (a[cut:], f[cut:])
            yield from _compared(a[:cut], f[:cut])
        if rest is not None:
            yield from _compared(*rest)

    met = marks.select("fingerprint").mapInArrow(spread, "anchor long, fingerprint long")
    return met.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(compare, "a long, b long").distinct()


def _compared(anchor: np.ndarray, marks: np.ndarray) -> Iterator[pd.DataFrame]:
    if not len(anchor):
        return
    at = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1], [True]]))
    found = [_links_of(marks[i:j].view(np.uint64)) for i, j in zip(at[:-1], at[1:]) if j - i > 1]
    if found:
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
        yield pd.DataFrame({"a": a, "b": b})


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints are linked at two differing bits or fewer; component_id is the smallest doc_id that
    links reach. Documents with one fingerprint are one node, so copies are never compared with each
    other. Null text: no word, fingerprint zero. A fingerprint that only rows with null ids have links
    with nothing, and its component_id is null. Repeated rows all come back; other columns are ignored; no rows give no rows.
    """
    rows = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    # A node is named by its smallest id, so the smallest node of a component is its answer.
    nodes = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    ends = nodes.where("least IS NOT NULL")
    links = (
        fingerprint_links(ends)
        .join(ends.select(F.col("fingerprint").alias("a"), F.col("least").alias("least_a")), "a")
        .join(ends.select(F.col("fingerprint").alias("b"), F.col("least").alias("least_b")), "b")
        .select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))
    )
    parts = graph.components(links).withColumnRenamed("node", "least")
    of_mark = nodes.join(parts, "least", "left").select("fingerprint", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(of_mark, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
