"""Substring dedup: words covered by a window of words that also starts earlier.

Hashing every window would ship one key per word of the corpus. Windows are anchored instead: short runs
of words are hashed only where their position, modulo 13, lies in the difference cover {0, 1, 3, 9}. Any
two equal windows of 20 words, wherever they start, hold an equal run of 8 words at the same distance
from their starts with both positions in the cover, since every difference modulo 13 is one of two
members. So runs are matched first, at 4 of 13 positions, and matches are extended: only windows around a
run that stands twice are hashed whole, to 128 bits, and compared by their first place.

A document is known by its id and a tag. The tag is 0 where all rows of an id have one text, else a hash of
the text, so that different texts under one id, or under none, are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from facetwise.llm.common import (
    Docs, blob, buckets_of, column_bytes, ids_array, mixed, plain, plain_columns, slices, split_words, stored, window_hashes, word_hashes,
)

WINDOW = 20
PERIOD = 13
#: A difference cover modulo 13: every difference occurs.
COVER = (0, 1, 3, 9)
RUN = WINDOW - PERIOD + 1
#: Added to word hashes for the second half of a window's hash.
SECOND = np.uint64(0x9E3779B97F4A7C15)
#: ``more``: the other half of the keys, only of whole windows.
PLACES = "bucket int, keys binary, more binary, ids binary, tags binary, pos binary, seen binary"
MARKS = "part int, ids binary, tags binary, pos binary"


def _deltas(ids: np.ndarray) -> bytes:
    """Ids as differences, which compress better."""
    return blob(np.diff(ids, prepend=np.int64(0)))


def _ids(raw: np.ndarray) -> np.ndarray:
    return np.cumsum(raw)


def _by(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, indices) for each value of a small-number array, indices in order."""
    order = np.argsort(group, kind="stable")
    at = np.flatnonzero(np.diff(group[order], prepend=-1, append=-1))
    for i, j in zip(at[:-1], at[1:]):
        yield int(group[order[i]]), order[i:j]


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return (keys % np.uint64(n)).astype(np.int32)


def _who(ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """A hash of documents by id and tag."""
    return mixed(mixed(ids.view(np.uint64)) + tags.view(np.uint64))


def part_of(ids: np.ndarray, tags: np.ndarray, n: int) -> np.ndarray:
    """The part of documents that a document is in."""
    return (_who(ids, tags) % np.uint64(n)).astype(np.int32)


def _places(ids, tags, pos) -> dict:
    return {"ids": _deltas(ids), "tags": blob(tags) if tags.any() else b"", "pos": blob(pos.astype(np.uint32))}


def _place_rows(keys, ids, tags, pos, n: int, seen=None, more=None) -> list[dict]:
    part = lambda values, i: b"" if values is None else blob(values[i])
    return [
        {"bucket": b, "keys": blob(keys[i]), "more": part(more, i), **_places(ids[i], tags[i], pos[i]), "seen": part(seen, i)}
        for b, i in _by(_bucket(keys, n))
    ]


def _mark_rows(ids, tags, pos, n: int) -> list[dict]:
    """Marks that need no meeting: rows without keys, in the bucket of their documents."""
    return [
        {"bucket": b, "keys": b"", "more": b"", **_places(ids[i], tags[i], pos[i]), "seen": b""}
        for b, i in _by(part_of(ids, tags, n))
    ]


def _read_places(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Ids, tags and positions of each row."""
    ids = [_ids(x) for x in column_bytes(table["ids"], np.int64)]
    tags = [t if len(t) else np.zeros(len(i), np.int64) for t, i in zip(column_bytes(table["tags"], np.int64), ids)]
    return ids, tags, column_bytes(table["pos"], np.uint32)


def _schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in text.split(", ")])


class _Text:
    """Words of some documents: their hashes, documents and positions."""

    def __init__(self, part: Docs, tags: np.ndarray):
        self.part, self.tags, self.words = part, tags, split_words(part)
        self.doc = self.words.docs()
        self.pos = np.arange(len(self.doc)) - self.words.first[self.doc]
        self.left = np.diff(self.words.first)[self.doc] - self.pos  # words from here to the end
        self.hash = word_hashes(part.data, self.words)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[_Text]:
    """The words of (doc_id, text, tag) batches, some documents at a time."""
    for batch in batches:
        tags, at = batch.column(2).to_numpy(zero_copy_only=False), 0
        for part in slices(iter([batch])):
            yield _Text(part, tags[at : at + len(part.ids)])
            at += len(part.ids)


def _runs(t: _Text, n: int) -> list[dict]:
    """Runs at cover positions: one entry for each different one; where it stands twice here, all its
    places are marked at once."""
    long_enough = np.diff(t.words.first)[t.doc] >= WINDOW
    at = np.flatnonzero(np.isin(t.pos % PERIOD, COVER) & (t.left >= RUN) & long_enough)
    keys, ids, tags, pos = window_hashes(t.hash, RUN)[at], t.part.ids[t.doc[at]], t.tags[t.doc[at]], t.pos[at]
    _, first, back, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    again = count[back] > 1
    first = np.sort(first)
    once = _place_rows(keys[first], ids[first], tags[first], pos[first], n, seen=again[first])
    return once + _mark_rows(ids[again], tags[again], pos[again], n)


def _windows(t: _Text, marked: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> list[dict]:
    """Whole windows around marked runs: the earliest place of each; the others are late already."""
    covered = np.zeros(len(t.doc) + 1, np.int64)
    at = _indices(t, *marked)
    np.add.at(covered, at - np.minimum(t.pos[at], WINDOW - RUN), 1)
    np.add.at(covered, at + 1, -1)
    at = np.flatnonzero((np.cumsum(covered)[:-1] > 0) & (t.left >= WINDOW))
    doc = t.doc[at]
    keys, ids, tags, pos = window_hashes(t.hash, WINDOW)[at], t.part.ids[doc], t.tags[doc], t.pos[at]
    more = window_hashes(mixed(t.hash + SECOND), WINDOW)[at]
    late = _late(keys, more, ids, tags, pos)
    early = np.flatnonzero(~late)
    once = _place_rows(keys[early], ids[early], tags[early], pos[early], n, more=more[early])
    return once + _mark_rows(ids[late], tags[late], pos[late], n)


def _late(keys, more, ids, tags, pos) -> np.ndarray:
    """Whether a place is later than the first one of its key, in the order of id, tag and position."""
    order = np.lexsort((pos, tags, ids, more, keys))
    k, m = keys[order], more[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (m[1:] != m[:-1])]) if len(k) else np.empty(0, bool)
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
    late = np.empty(len(k), bool)
    late[order] = (ids[order] != ids[first]) | (tags[order] != tags[first]) | (pos[order] != pos[first])
    return late


def _indices(t: _Text, ids: np.ndarray, tags: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Indices of the words at (id, tag, position), in every row of that document."""
    own = t.part.ids
    if not len(ids) or not len(own):
        return np.empty(0, np.int64)
    who = _who(ids, tags)
    order = np.argsort(who, kind="stable")
    who, ids, tags, pos = who[order], ids[order], tags[order], pos[order]
    wanted = _who(own, t.tags)
    low, high = np.searchsorted(who, wanted, "left"), np.searchsorted(who, wanted, "right")
    n = high - low
    which = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    rows = np.repeat(np.arange(len(own)), n)
    fits = (pos[which] < np.diff(t.words.first)[rows]) & (ids[which] == own[rows]) & (tags[which] == t.tags[rows])
    return t.words.first[rows][fits] + pos[which][fits]


def _meet(first_stays: bool, n: int):
    """By bucket: which places are marked, grouped by part. Either all but a key's first place, or all
    places of a key that stands twice."""

    def run(table: pa.Table) -> pa.Table:
        ids, tags, pos = _read_places(table)
        keys, more = column_bytes(table["keys"], np.uint64), column_bytes(table["more"], np.uint64)
        seen = column_bytes(table["seen"], np.bool_)
        keyed = [len(k) > 0 for k in keys]
        join = lambda some, want, kind: np.concatenate([np.empty(0, kind), *(x for x, k in zip(some, keyed) if k == want)])
        of = lambda want: (join(ids, want, np.int64), join(tags, want, np.int64), join(pos, want, np.uint32))
        done, open_ = of(False), of(True)
        key = join(keys, True, np.uint64)
        if first_stays:
            hit = _late(key, join(more, True, np.uint64), *open_)
        else:
            _, back, count = np.unique(key, return_inverse=True, return_counts=True)
            hit = (count[back] > 1) & ~join(seen, True, np.bool_)
        i, t, p = (np.concatenate([d, o[hit]]) for d, o in zip(done, open_))
        order = np.lexsort((p, t, i))
        i, t, p = i[order], t[order], p[order]
        rows = [{"part": b, **_places(i[x], t[x], p[x])} for b, x in _by(part_of(i, t, n))]
        return pa.Table.from_pylist(rows, _schema(MARKS))

    return run


def _marked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, tags, pos = _read_places(table)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *ids]), np.concatenate([none, *tags]), np.concatenate([none, *pos]).astype(np.int64)


def _kept(t: _Text, marked: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """Texts without the words that late windows cover."""
    part = t.part
    cover = np.zeros(len(t.doc) + WINDOW + 1, np.int64)
    at = np.unique(_indices(t, *marked))
    cover[at] += 1
    cover[at + WINDOW] -= 1
    gone = np.cumsum(cover)[: len(t.doc)] > 0
    n_gone = np.add.reduceat(np.append(gone, False), t.words.first[:-1], dtype=np.int64) if len(part.ids) else np.empty(0, np.int64)
    n_gone = np.where(np.diff(t.words.first) > 0, n_gone, 0)
    starts, lengths, doc = t.words.start[~gone], t.words.length[~gone], t.doc[~gone]
    # Bytes of kept words, each followed by a space; the last space of a document goes.
    ends = np.cumsum(lengths + 1)
    take = np.repeat(starts - (ends - lengths - 1), lengths + 1) + np.arange(ends[-1] if len(ends) else 0)
    data = np.append(part.data, np.uint8(32))[np.minimum(take, len(part.data))]
    data[ends - 1] = 32
    bound = np.searchsorted(doc, np.arange(len(part.ids) + 1), "left")
    stop = np.concatenate([[0], ends])
    texts = [data[stop[a] : max(stop[b] - 1, stop[a])].tobytes().decode() for a, b in zip(bound[:-1], bound[1:])]
    return pa.RecordBatch.from_arrays(
        [ids_array(part.ids), pa.array(texts, pa.string()), pa.array(np.diff(t.words.first)), pa.array(n_gone)],
        ["doc_id", "text", "n_words", "n_removed"],
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_row: bool = False) -> DataFrame:
    """One row per document: doc_id, text (the kept words joined by one space), n_words, n_removed; with
    ``whole_row`` also row, a struct of all columns but the text, and texts that lose nothing as they are.

    Words stand between ASCII white space. A window is 20 consecutive words of one document; every word
    of a window whose words also start earlier (smaller doc_id, or the same document and further left)
    is removed. Judged on the input. Null or short texts lose nothing. Null ids count as the smallest id.
    Rows that repeat an id and a text are copies of one document: what goes from one goes from all. Different
    texts of one id, or of none, are documents of their own, in the order of a hash of their text.
    Other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    n = buckets_of(spark, 1)
    tag = F.xxhash64("text")
    texts_of = plain(docs, id_col, text_col).groupBy("doc_id").agg(F.min(tag).alias("low"), F.max(tag).alias("high"))
    # As a table its size is known when the joins are planned: texts move only where many ids repeat.
    shared = stored(texts_of.where("low <> high").select(F.col("doc_id").alias("shared_id"), F.lit(True).alias("shared")), "shared-ids")

    def tagged(rows: DataFrame) -> DataFrame:
        joined = rows.join(shared, F.col("doc_id").eqNullSafe(F.col("shared_id")), "left")
        others = [F.col(c) for c in rows.columns if c not in ("doc_id", "text")]
        return joined.select("doc_id", "text", F.when(F.col("shared"), tag).otherwise(F.lit(0)).alias("tag"), *others)

    rows = tagged(plain(docs, id_col, text_col))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _texts(batches):
            yield pa.RecordBatch.from_pylist(_runs(t, n), _schema(PLACES))

    def whole(table: pa.Table) -> Iterator[_Text]:
        return _texts(iter(table.select(["doc_id", "text", "tag"]).combine_chunks().to_batches()))

    def windows(texts: pa.Table, marks: pa.Table) -> pa.Table:
        marked = _marked(marks)
        found = [r for t in whole(texts) for r in _windows(t, marked, n)] if len(marked[0]) else []
        return pa.Table.from_pylist(found, _schema(PLACES))

    def kept(texts: pa.Table, marks: pa.Table) -> pa.Table:
        marked, schema = _marked(marks), _schema("doc_id long, text string, n_words long, n_removed long")
        out = pa.Table.from_batches([_kept(t, marked) for t in whole(texts)], schema)
        if whole_row:  # rows come in the order of the texts
            same = pc.equal(out["n_removed"], 0)
            out = out.set_column(1, "text", pc.if_else(same, texts["text"].cast(pa.string()), out["text"]))
            out = out.append_column("row", texts["row"])
        return out

    def part_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).fill_null(int(np.iinfo(np.int64).min)).to_numpy(zero_copy_only=False)
            tags = b.column(2).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(part_of(ids, tags, n)), *b.columns], ["part", *b.schema.names])

    dealt, row_kind = rows, ""
    if whole_row:
        others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
        dealt = tagged(docs.select(*plain_columns(id_col, text_col), F.struct(*others).alias("row")))
        row_kind = f", row {dealt.schema['row'].dataType.simpleString()}"
    texts = dealt.mapInArrow(part_column, f"part int, doc_id long, text string, tag long{row_kind}").groupBy("part")
    met = rows.mapInArrow(runs, PLACES).groupBy("bucket").applyInArrow(_meet(False, n), MARKS)
    places = texts.cogroup(met.groupBy("part")).applyInArrow(windows, PLACES)
    late = places.groupBy("bucket").applyInArrow(_meet(True, n), MARKS)
    return texts.cogroup(late.groupBy("part")).applyInArrow(kept, f"doc_id long, text string, n_words long, n_removed long{row_kind}")
