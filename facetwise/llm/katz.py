"""Language-model scores: a Katz backoff bigram model over all words.

Bigram counts are discounted by Good-Turing, and what that frees goes, for each history, to the words not
seen after it, in proportion to their unigram probability and normalised exactly. A word never seen has
(0 + 1) of the tokens, types and one unseen type. With ``least_part`` words with a smaller part of the
tokens share one class instead, in which a word has (c + 1) of the class's tokens, types and one unseen type.

Counts are tables in the shared folder, one row per bucket with sorted keys. A pair stands in the bucket of
its history; where that is hot, of its word; where both are, of the pair. log10 p(w|v) is taken apart: each
token adds what its word has as a word and as a history (unigram and backoff weight: a document's words are
its histories as well), and a pair that was seen adds the difference to its discounted share. So tokens
meet one table, by word or by pair: a document gives each bucket its different keys and how often it
has them, and takes back one sum. Hot words and pairs, at least 2^-19 of all, are sent to all tasks too;
that saves their look-up and changes no result.

What is moved or stored is small: hot words go by number, cold ones as the list of a bucket and places in it,
sorted keys as differences, and arrays by bytes of equal weight, compressed. Only counts are stored; what a pair
adds is worked out from them where its bucket is looked up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from facetwise.llm.common import LOWER, Docs, buckets_of, group_sums, ids_array, mixed, plain, slices, split_words, stored, word_hashes

#: Least part of the tokens, or of the pairs, that is sent to all tasks; the rest is looked up.
HOT_PART = 2.0**-19
#: Counts up to this are discounted.
DISCOUNTED = 5
END_HASH, RARE_HASH = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47)
TABLE = "bucket int, data binary, total long, distinct long, repeats array<long>"
#: Of one bucket: pairs of hot words (number of the history times how many are hot, plus number of the word); cold
#: words, their counts, pairs of a hot and a cold word (place of the cold one times how many are hot, plus number of
#: the hot one) and the other way round; pairs of cold words (place of the history, and the word). Each with counts.
PAIRS = "bucket int, hot binary, half binary, cold binary, repeats array<long>"
ENTRIES = "bucket int, kind int, of int, data binary, half binary, cold binary"
ENTRY, OWN, TABLE_ROW, ANSWER = range(4)


def training_rows(id_col: str = "doc_id") -> Column:
    """Documents whose crc32 of the id, as text, leaves no remainder of two by seven; null ids are learned from."""
    return ~F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 7 == 2, F.lit(False))


class Model(NamedTuple):
    """What all tasks hold: sorted hashes of hot words, their counts, what a token of each adds, and what
    all seen pairs of each as a history add; hot pairs (history times words, plus word) and what they add; what
    an unknown word adds; discounts by count, and what a count is a part of. With classes, the words that are
    no part of the rare one; every class is hot then."""

    words: np.ndarray
    counts: np.ndarray
    adds: np.ndarray
    after: np.ndarray
    pairs: np.ndarray
    pair_adds: np.ndarray
    unknown: float
    discount: np.ndarray
    base: float
    vocabulary: np.ndarray | None
    buckets: int


# ---------------------------------------------------------------- arrays in cells


def packed(values: np.ndarray) -> bytes:
    """Bytes of an array: of all values the lowest byte, then the next one, and so on, each compressed."""
    width = values.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T
    parts = []
    for plane in planes:
        raw = plane.tobytes() if plane.any() else b""
        small = pa.compress(raw, "zstd", asbytes=True) if len(raw) > 64 else raw
        parts.append(small if len(small) < len(raw) else raw)
    return np.array([len(values), *map(len, parts)], np.uint32).tobytes() + b"".join(parts)


def unpacked(data: memoryview, dtype) -> tuple[np.ndarray, int]:
    """The array that ``packed`` wrote at the beginning, and where its bytes end."""
    width = np.dtype(dtype).itemsize
    n, *sizes = np.frombuffer(data, np.uint32, width + 1).tolist()
    planes, at = np.zeros((width, n), np.uint8), 4 * (width + 1)
    for k, size in enumerate(sizes):
        if size:
            part = data[at : at + size]
            planes[k] = np.frombuffer(part if size == n else pa.decompress(part, n, "zstd"), np.uint8)
        at += size
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype), at


def _cell(*arrays: np.ndarray) -> bytes:
    return b"".join(packed(a) for a in arrays)


def _arrays(cell: pa.Scalar, *dtypes) -> list[np.ndarray]:
    """The arrays of one cell, in order; a cell may hold more."""
    data, out = memoryview(cell.as_buffer()), []
    for dtype in dtypes:
        values, size = unpacked(data, dtype)
        out.append(values)
        data = data[size:]
    return out


def _gaps(keys: np.ndarray) -> np.ndarray:
    """Differences of sorted keys; cumsum takes them back."""
    return np.diff(keys, prepend=keys.dtype.type(0))


def _sorted_arrays(cell: pa.Scalar, *dtypes) -> list[np.ndarray]:
    """As _arrays, where the first was stored as differences."""
    first, *rest = _arrays(cell, *dtypes)
    return [np.cumsum(first, dtype=first.dtype), *rest]


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.Table.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [f for f, _ in fields])


# ---------------------------------------------------------------- counting


def _tokens(part: Docs) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each document's end included, and the document of each."""
    part = part._replace(data=LOWER[part.data])
    words = split_words(part)
    n = len(part.ids)
    out = np.empty(len(words.start) + n, np.uint64)
    ends = words.first[1:] + np.arange(n)
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word], out[ends] = word_hashes(part.data, words), END_HASH
    return out, np.repeat(np.arange(n), np.diff(words.first) + 1)


def _find(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places in a sorted table, -1 where a key is not in it."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _at(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Values at places, 0 at -1."""
    return np.append(values, np.zeros(1, values.dtype))[places]


def _classes(hashes: np.ndarray, vocabulary: np.ndarray | None) -> np.ndarray:
    if vocabulary is None:
        return hashes
    return np.where((_find(hashes, vocabulary) >= 0) | (hashes == END_HASH), hashes, RARE_HASH)


def _before(w: np.ndarray, doc: np.ndarray, end) -> np.ndarray:
    """Of each token the one before it; before the first stands the end."""
    v = np.roll(w, 1)
    v[np.diff(doc, prepend=-1) != 0] = end
    return v


def _split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    at = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    for i, j in zip(at[:-1], at[1:]):
        yield int(bucket[order[i]]), order[i:j]


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return (mixed(keys) % np.uint64(n)).astype(np.int32)


def _bounds(words: np.ndarray, n: int) -> np.ndarray:
    """Where the buckets of sorted word hashes begin, and the end: bucket k has the k-th range of all hashes."""
    return np.searchsorted(words, np.array([-(-(k << 64) // n) for k in range(n)], np.uint64)).tolist() + [len(words)]


def _repeated(counts: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, ... DISCOUNTED + 1."""
    return np.bincount(np.minimum(counts, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2]


def _same_places(place: np.ndarray, w: np.ndarray, doc: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order by place, word (and document), and where in it another one begins."""
    columns = [place, w] if doc is None else [place, w, doc]
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new |= np.diff(c[order], prepend=c[order[:1]]) != 0
    new[:1] = True
    return order, np.flatnonzero(new)


def _count_words(rows: DataFrame, n: int) -> DataFrame:
    """Counts of words, merged in each task, then by bucket: one row per bucket, keys in order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 12 << 20):
            keys, counts = np.unique(_tokens(part)[0], return_counts=True)
            at = _bounds(keys, n)
            found = [(b, _cell(_gaps(keys[i:j]), counts[i:j].astype(np.uint32))) for b, (i, j) in enumerate(zip(at[:-1], at[1:])) if i < j]
            yield from _table(found, "bucket int, data binary").to_batches()

    def merge(table: pa.Table) -> pa.Table:
        cells = [_sorted_arrays(c, np.uint64, np.uint32) for c in table["data"]]
        keys, counts = group_sums(np.concatenate([k for k, _ in cells]), np.concatenate([c for _, c in cells]).astype(np.int64))
        return _table([(table["bucket"][0].as_py(), _cell(_gaps(keys), counts), int(counts.sum()), len(keys), _repeated(counts).tolist())], TABLE)

    merged = rows.mapInArrow(count, "bucket int, data binary").groupBy("bucket").applyInArrow(merge, TABLE)
    return stored(merged, "word-counts")


class Sides(NamedTuple):
    """Tokens of a slice: place of each and of the one before among hot words (-1: none) and among the slice's cold words."""

    at: np.ndarray
    v_at: np.ndarray
    cold: np.ndarray
    place: np.ndarray
    v_place: np.ndarray


def _sides(hashes: np.ndarray, w: np.ndarray, doc: np.ndarray, words: np.ndarray) -> Sides:
    at = _find(w, words)
    known = (at >= 0) & (w != RARE_HASH)
    cold, inverse = np.unique(hashes[~known], return_inverse=True)
    place = np.full(len(w), -1)
    place[~known] = inverse
    end = np.array([END_HASH])
    return Sides(at, _before(at, doc, _find(end, words)[0]), cold, place, _before(place, doc, _find(end, cold)[0]))


def _count_pairs(rows: DataFrame, word_table: DataFrame, hot, vocabulary: np.ndarray | None, n: int) -> DataFrame:
    """Counts of pairs, merged in each task, then by bucket with the counts of its cold words: one row per bucket."""
    schema = "bucket int, source int, hot binary, half binary, cold binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = hot.value[0]
        size = max(len(words), 1)
        for part in slices(batches, 12 << 20):
            hashes, doc = _tokens(part)
            w = _classes(hashes, vocabulary)
            x = _sides(hashes, w, doc, words)
            a, b = x.v_at >= 0, x.at >= 0
            keys, counts = np.unique(x.v_at[a & b] * size + x.at[a & b], return_counts=True)
            found = {k: (_cell(_gaps(keys[i]), counts[i].astype(np.uint32)), b"", b"") for k, i in _split(_bucket(keys.view(np.uint64), n))}
            if not (a & b).all():
                before, before_n = np.unique(x.place[a & ~b] * size + x.v_at[a & ~b], return_counts=True)
                behind, behind_n = np.unique(x.v_place[~a & b] * size + x.at[~a & b], return_counts=True)
                place, cold_w = x.v_place[~a & ~b], w[~a & ~b]
                order, first = _same_places(place, cold_w)
                cold_n = np.diff(np.append(first, len(order)))
                place, cold_w = place[order[first]], cold_w[order[first]]
                at = _bounds(x.cold, n)
                i, j, k = (np.searchsorted(keys, np.array(at) * s).tolist() for keys, s in ((before, size), (behind, size), (place, 1)))
                for to in range(n):
                    if at[to] == at[to + 1]:
                        continue
                    y, z, c = (slice(m[to], m[to + 1]) for m in (i, j, k))
                    half = _cell(
                        _gaps(x.cold[at[to] : at[to + 1]]), _gaps(before[y] - at[to] * size), before_n[y].astype(np.uint32),
                        _gaps(behind[z] - at[to] * size), behind_n[z].astype(np.uint32),
                    )
                    cold = _cell(_gaps(place[c] - at[to]), cold_w[c], cold_n[c].astype(np.uint32))
                    found[to] = (found[to][0] if to in found else b"", half, cold)
            yield from _table([(to, 0, *cells) for to, cells in found.items()], schema).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        size = max(len(hot.value[0]), 1)
        none = np.empty(0, np.int64)
        here = table["source"].to_numpy() < 0
        known = [_sorted_arrays(c, np.uint64, np.int64) for c in table.filter(pa.array(here))["half"]]
        words, word_counts = known[0] if known else (np.empty(0, np.uint64), none)
        is_cold = _find(words, hot.value[0]) < 0
        words, word_counts = words[is_cold], word_counts[is_cold]
        found = table.filter(pa.array(~here))
        keys, counts = [none], [none]
        for cell in found["hot"]:
            if len(cell.as_buffer()):
                for some, more in zip((keys, counts), _sorted_arrays(cell, np.int64, np.uint32)):
                    some.append(more)
        hh = group_sums(np.concatenate(keys), np.concatenate(counts).astype(np.int64))
        half = [[none], [none], [none], [none]]
        both = [[none], [np.empty(0, np.uint64)], [none]]
        for c, d in zip(found["half"], found["cold"]):
            if not len(c.as_buffer()):
                continue
            own, *lists = _sorted_arrays(c, np.uint64, np.int64, np.uint32, np.int64, np.uint32)
            to = np.searchsorted(words, own)
            for k in (0, 2):
                key = np.cumsum(lists[k])
                half[k].append(to[key // size] * size + key % size)
                half[k + 1].append(lists[k + 1])
            place, w, times = _sorted_arrays(d, np.int64, np.uint64, np.uint32)
            for some, more in zip(both, (to[place], w, times)):
                some.append(more)
        before, behind = (group_sums(np.concatenate(half[k]), np.concatenate(half[k + 1]).astype(np.int64)) for k in (0, 2))
        place, w, times = (np.concatenate(x) for x in both)
        order, first = _same_places(place, w)
        times = np.add.reduceat(times[order].astype(np.int64), first) if len(first) else none
        place, w = place[order[first]], w[order[first]]
        repeats = sum(_repeated(c) for c in (hh[1], before[1], behind[1], times))
        cells = [
            _cell(_gaps(hh[0]), hh[1].astype(np.int64)),
            _cell(_gaps(words), word_counts, _gaps(before[0]), before[1], _gaps(behind[0]), behind[1]),
            _cell(_gaps(place), w, times),
        ]
        return _table([(table["bucket"][0].as_py(), *cells, repeats.tolist())], PAIRS)

    found = rows.mapInArrow(count, schema)
    none = F.lit(b"")
    met = found.union(word_table.select("bucket", F.lit(-1).alias("source"), none.alias("hot"), F.col("data").alias("half"), none.alias("cold")))
    return stored(met.groupBy("bucket").applyInArrow(merge, PAIRS), "pair-counts")


def _pairs_of(half: pa.Scalar, cold: pa.Scalar | None = None) -> tuple[np.ndarray, ...]:
    """Cold words of a bucket, their counts, keys and counts of pairs behind and before a hot word; with ``cold``, of two cold words."""
    words, counts, before, before_n, behind, behind_n = _arrays(half, np.uint64, *[np.int64] * 5)
    out = (np.cumsum(words, dtype=np.uint64), counts, np.cumsum(before), before_n, np.cumsum(behind), behind_n)
    return out if cold is None else (*out, *_sorted_arrays(cold, np.int64, np.uint64, np.int64))


def _heavy(table: DataFrame, column: str, key_type, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys with at least ``least`` occurrences, sorted, and their counts: at most total / least."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                k, c = _sorted_arrays(cell, key_type, np.int64)
                if (c >= least).any():
                    yield from _table([(k[c >= least].tobytes(), c[c >= least].tobytes())], "keys binary, counts binary").to_batches()

    rows = table.select(column).mapInArrow(pick, "keys binary, counts binary").collect()
    keys = np.concatenate([np.empty(0, key_type), *(np.frombuffer(r[0], key_type) for r in rows)])
    counts = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(r[1], np.int64) for r in rows)])
    order = np.argsort(keys)
    return keys[order], counts[order]


def _repeats(table: DataFrame) -> list[int]:
    return list(table.agg(*[F.coalesce(F.sum(F.col("repeats")[k]), F.lit(0)) for k in range(DISCOUNTED + 1)]).first())


def good_turing(repeats: list[int]) -> np.ndarray:
    """Katz's discounts for counts 0 to DISCOUNTED, from how many keys occur once, twice, ... Where the
    figures allow none (missing or rising counts), the count stays whole."""
    n, k = [0, *repeats], DISCOUNTED
    out = np.ones(k + 1)
    top = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        if n[r] and top < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top)
            out[r] = d if 0 < d < 1 else 1.0
    return out


def _discounted(counts: np.ndarray, discount: np.ndarray) -> np.ndarray:
    return discount[np.where(counts <= DISCOUNTED, counts, 0)] * counts


def _backoff(count: np.ndarray, mass: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By history, from its count, the discounted count of what follows, and the unigram probability of all
    that follows: log10 of its backoff weight, and what a seen pair of it adds besides its own part."""
    left = np.where(count > 0, 1 - mass / np.maximum(count, 1), 1.0)
    # Where nothing is discounted one occurrence is held back, so that no word is impossible.
    scale = np.where(left < 1 / (count + 1), count / (count + 1) / np.maximum(1 - left, 1e-300), 1.0)
    scale[count == 0] = 1.0
    left = np.where(count > 0, 1 - scale * mass / np.maximum(count, 1), 1.0)
    # After a history that every class follows nothing is left to back off to: then it has all mass.
    full = 1 - seen < 1e-9
    scale[full] /= np.maximum(1 - left[full], 1e-300)
    back = np.log10(np.where(full, 1.0, left / np.maximum(1 - seen, 1e-300)))
    return back, np.log10(scale / np.maximum(count, 1)) - back


class Fitted(NamedTuple):
    """The model; counts of pairs and of the words that are not hot, by bucket; for pairs of two such words the
    counts of the second; tokens and different words."""

    model: Model
    pairs: DataFrame
    counts: DataFrame
    total: int
    distinct: int


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_part: float = 0.0, hot_part: float = HOT_PART) -> Fitted:
    """Counts of all words and of all pairs in all texts, and the model that follows.

    ``least_part``: words with a smaller part of the tokens share one class; 0: every word is its own.
    ``hot_part``: part of the tokens from which a word or pair is sent to all tasks; no result depends on it.
    """
    rows = plain(train, id_col, text_col)
    context = rows.sparkSession.sparkContext
    n = buckets_of(rows.sparkSession, 1)
    word_table = _count_words(rows, n)
    r = word_table.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    total, distinct = r[0], r[1]
    words, counts = _heavy(word_table, "data", np.uint64, max(1.0, total * (least_part or hot_part)))
    vocabulary, classes = None, max(distinct, 1) + 1  # the end, and one for all that is unknown
    if least_part:
        keep = words != END_HASH
        vocabulary, heavy, ends = words[keep], counts[keep], rows.count()
        rare = int(total - ends - heavy.sum()), int(distinct - len(vocabulary) - (ends > 0))
        classes = len(vocabulary) + 2
        words = np.append(vocabulary, [END_HASH, RARE_HASH])
        order = np.argsort(words)
        words, counts = words[order], np.append(heavy, [ends, rare[0]])[order]
    hot = context.broadcast((words, counts))  # bounded by the part
    base = float(total + classes)

    pair_table = _count_pairs(rows, word_table, hot, vocabulary, n)
    discount = good_turing(_repeats(pair_table))
    mass, seen = _hot_sums(pair_table, hot, discount, base)
    back, after = _backoff(counts, mass, seen)
    p = (counts + 1) / base
    # The words of a pair are at least as frequent, so that of a hot pair both are hot.
    pairs, pair_counts = _heavy(pair_table, "hot", np.int64, max(1.0, total * hot_part))
    v, w = np.divmod(pairs, max(len(words), 1))
    pair_adds = np.log10(_discounted(pair_counts, discount)) - np.log10(p[w]) + after[v]
    # With classes this is the rest of an unknown word's share in the rare class.
    unknown = -math.log10(sum(rare) + 1) if least_part else -math.log10(base)
    model = Model(words, counts, back + np.log10(p), after, pairs, pair_adds, unknown, discount, base, vocabulary, n)
    return Fitted(model, pair_table, _counts_for_pairs(pair_table, word_table, n), total, distinct)


def _counts_for_pairs(pair_table: DataFrame, word_table: DataFrame, n: int) -> DataFrame:
    """For each bucket of pairs, and each bucket of words, the counts of the second words of pairs of two cold words, in order."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, cell in zip(batch.column("bucket").to_pylist(), batch.column("cold")):
                w = np.unique(_arrays(cell, np.int64, np.uint64)[1])
                at = _bounds(w, n)
                some = [(b, source, _cell(_gaps(w[i:j]))) for b, (i, j) in enumerate(zip(at[:-1], at[1:])) if i < j]
                yield from _table(some, "bucket int, source int, data binary").to_batches()

    def answer(table: pa.Table) -> pa.Table:
        source, of = table["source"].to_numpy(), table["bucket"][0].as_py()
        known = [_sorted_arrays(c, np.uint64, np.int64) for c in table.filter(pa.array(source < 0))["data"]]
        keys, counts = known[0] if known else (np.empty(0, np.uint64), np.empty(0, np.int64))
        asked = table.filter(pa.array(source >= 0))
        found = [
            (s, of, _cell(_at(counts, _find(_sorted_arrays(c, np.uint64)[0], keys)))) for s, c in zip(asked["source"].to_pylist(), asked["data"])
        ]
        return _table(found, "bucket int, of int, data binary")

    asks = pair_table.select("bucket", "cold").mapInArrow(ask, "bucket int, source int, data binary")
    met = asks.union(word_table.select("bucket", F.lit(-1).alias("source"), "data"))
    return stored(met.groupBy("bucket").applyInArrow(answer, "bucket int, of int, data binary"), "pair-word-counts")


def _hot_sums(pair_table: DataFrame, hot, discount: np.ndarray, base: float) -> np.ndarray:
    """By hot history: the discounted count of what follows, and the unigram probability of all that follows."""
    names = ["at", "d", "p"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = hot.value[1]
        size = len(counts)
        sums = np.zeros((2, size))
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1)):
                keys, c = _sorted_arrays(a, np.int64, np.int64)
                _, word_counts, before, before_n, *_ = _pairs_of(b)
                some = []
                if len(keys):
                    v, w = np.divmod(keys, size)
                    some.append((v, c, counts[w]))
                if len(before):
                    w, v = np.divmod(before, size)
                    some.append((v, before_n, word_counts[w]))
                for v, c, k in some:
                    sums[0] += np.bincount(v, _discounted(c, discount), size)
                    sums[1] += np.bincount(v, (k + 1) / base, size)
        at = np.flatnonzero(sums.any(axis=0)).astype(np.int32)
        for i in range(0, len(at), 1 << 16):
            some = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[0, some]), pa.array(sums[1, some])], names)

    found = pair_table.select("hot", "half").mapInArrow(rows, "at int, d double, p double")
    found = found.groupBy("at").agg(F.sum("d"), F.sum("p")).toArrow()
    out = np.zeros((2, len(hot.value[1])))
    for k in range(2):
        out[k, found.column(0).to_numpy()] = found.column(k + 1).to_numpy()
    return out


# ---------------------------------------------------------------- scoring


def _entries(part: Docs, model: Model) -> list[tuple]:
    """What documents have to ask of each bucket, and what they can answer themselves."""
    n, size, docs = model.buckets, max(len(model.words), 1), len(part.ids)
    hashes, doc = _tokens(part)
    w = _classes(hashes, model.vocabulary)
    x = _sides(hashes, w, doc, model.words)
    own = np.zeros((4, docs))  # tokens, known tokens, sum of log10(c + 1), sum of log10 p
    own[0] = np.bincount(doc, minlength=docs)
    a, b = x.v_at >= 0, x.at >= 0
    known = x.place < 0
    count = _at(model.counts, x.at)
    own[1] = np.bincount(doc[known & (count > 0)], minlength=docs)
    own[2] = np.bincount(doc[known], np.log10(count[known] + 1), docs)
    pairs = np.where(a & b, x.v_at * size + x.at, -1)
    found = _find(pairs, model.pairs)
    own[3] = np.bincount(doc, _at(model.adds, x.at) + _at(model.pair_adds, found), docs)

    def listed(pick: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        both, times = np.unique(keys[pick] * docs + doc[pick], return_counts=True)
        return (*np.divmod(both, docs), times)

    # Pairs of hot words; a hot word and a cold one, the other way round; cold words behind a cold one; pairs of those.
    hh = listed(a & b & (found < 0), pairs)
    half = [
        (listed(a & ~b, x.place * size + x.v_at), size), (listed(~a & b, x.v_place * size + x.at), size),
        (listed(~known & ~(a & ~b), x.place), 1),
    ]
    cold = ~a & ~b
    place, cold_w, cold_doc = x.v_place[cold], w[cold], doc[cold]
    order, first = _same_places(place, cold_w, cold_doc)
    times = np.diff(np.append(first, len(order)))
    place, cold_w, cold_doc = (c[order[first]] for c in (place, cold_w, cold_doc))
    by_pair = dict(_split(_bucket(hh[0].view(np.uint64), n)))
    at = _bounds(x.cold, n)
    cuts = [np.searchsorted(keys, np.array(at) * s).tolist() for (keys, _, _), s in half] + [np.searchsorted(place, at).tolist()]
    rows: list[tuple] = []
    for to in range(n):
        i = by_pair.get(to, np.empty(0, np.int64))
        if not len(i) and at[to] == at[to + 1]:
            continue
        parts = [slice(c[to], c[to + 1]) for c in cuts]
        some = [tuple(c[i] for c in hh), *((k[p] - at[to] * s, d[p], t[p]) for ((k, d, t), s), p in zip(half, parts))]
        some.append((place[parts[3]] - at[to], cold_doc[parts[3]], times[parts[3]]))
        here = np.zeros(docs, bool)
        for _, d, _ in some:
            here[d] = True
        number = np.cumsum(here) - 1
        coded = [y for k, d, t in some for y in (_gaps(k), number[d].astype(np.uint32), t.astype(np.uint32))]
        rows.append((to, ENTRY, 0, _cell(part.ids[here], _gaps(x.cold[at[to] : at[to + 1]]), *coded, cold_w[parts[3]]), b"", b""))
    for to, i in _split(_bucket(part.ids.view(np.uint64), n)):
        rows.append((to, OWN, 0, _sums_cell(part.ids[i], own[:, i]), b"", b""))
    return rows


def _sums_cell(ids: np.ndarray, sums: np.ndarray) -> bytes:
    return _cell(_gaps(ids), *sums)


def _sums_of(cell: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    ids, *sums = _sorted_arrays(cell, np.int64, *[np.float64] * 4)
    return ids, np.array(sums)


def _added(cells: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different ids, and the sums of each."""
    ids, *sums = group_sums(np.concatenate([i for i, _ in cells]), *np.concatenate([s for _, s in cells], axis=1))
    return ids, np.array(sums)


class Weights(NamedTuple):
    """Of one bucket: pairs of hot words and what they add; cold words, their counts and what a token of each adds;
    the other pairs as in PAIRS, and what they add."""

    hot: np.ndarray
    hot_adds: np.ndarray
    words: np.ndarray
    counts: np.ndarray
    adds: np.ndarray
    before: np.ndarray
    before_adds: np.ndarray
    behind: np.ndarray
    behind_adds: np.ndarray
    cold: np.ndarray
    cold_w: np.ndarray
    cold_adds: np.ndarray


def _weights(table: pa.Table, answers: pa.Table, model: Model) -> Weights:
    """What the words and seen pairs of a bucket add, from their counts. All pairs of a cold history are in it."""
    size, base = max(len(model.words), 1), model.base
    none = np.empty(0, np.int64)
    hot, hot_n, counts, before, before_n, behind, behind_n, cold, cold_n = [none] * 9
    words = cold_w = np.empty(0, np.uint64)
    if table.num_rows:
        hot, hot_n = _sorted_arrays(table["data"][0], np.int64, np.int64)
        words, counts, before, before_n, behind, behind_n, cold, cold_w, cold_n = _pairs_of(table["half"][0], table["cold"][0])
    asked = np.unique(cold_w)
    at, of_w = _bounds(asked, model.buckets), np.zeros(len(asked), np.int64)
    for of, cell in zip(answers["of"].to_pylist(), answers["data"]):
        of_w[at[of] : at[of + 1]] = _arrays(cell, np.int64)[0]
    d = [_discounted(c, model.discount) for c in (hot_n, before_n, behind_n, cold_n)]
    p = [(c + 1) / base for c in (model.counts[hot % size], counts[before // size], model.counts[behind % size], of_w[np.searchsorted(asked, cold_w)])]
    history = behind // size, cold
    mass, seen = (sum(np.bincount(v, x[k], len(words)) for v, k in zip(history, (2, 3))) for x in (d, p))
    back, after = _backoff(counts, mass, seen)
    afters = model.after[hot // size], model.after[before % size], *(after[v] for v in history)
    adds = [np.log10(x) - np.log10(y) + z for x, y, z in zip(d, p, afters)]
    return Weights(hot, adds[0], words, counts, back + np.log10((counts + 1) / base), before, adds[1], behind, adds[2], cold, cold_w, adds[3])


def _answers(table: pa.Table, model: Model) -> pa.Table:
    """In one bucket: what keys add, looked up, and one sum per document and bucket."""
    n, size = model.buckets, max(len(model.words), 1)
    kind = table["kind"].to_numpy()
    entries, own, rows, answers = (table.filter(pa.array(kind == k)) for k in (ENTRY, OWN, TABLE_ROW, ANSWER))
    x = _weights(rows, answers, model)
    sums = [_sums_of(c) for c in own["data"]] + [(np.empty(0, np.int64), np.empty((4, 0)))]
    cold_keys = _place_hashes(x.cold, x.cold_w)
    order = np.argsort(cold_keys)
    cold_keys, cold_adds = cold_keys[order], x.cold_adds[order]
    for cell in entries["data"]:
        block = [np.int64, np.uint32, np.uint32]
        ids, words, *blocks = _arrays(cell, np.int64, np.uint64, *block * 5, np.uint64)
        to = _find(np.cumsum(words, dtype=np.uint64), x.words)
        to = np.append(to, -1)
        s = np.zeros((4, len(ids)))
        keys = [np.cumsum(k) for k in blocks[:15:3]]
        docs, times = blocks[1:15:3], blocks[2:15:3]

        def held(key: np.ndarray, known: np.ndarray) -> np.ndarray:
            """Places among the bucket's keys of keys that go by the entry's own list of words; -1 for unknown words."""
            place = to[key // size]
            return np.where(place >= 0, _find(np.maximum(place, 0) * size + key % size, known), -1)

        s[3] += np.bincount(docs[0], times[0] * _at(x.hot_adds, _find(keys[0], x.hot)), len(ids))
        s[3] += np.bincount(docs[1], times[1] * _at(x.before_adds, held(keys[1], x.before)), len(ids))
        s[3] += np.bincount(docs[2], times[2] * _at(x.behind_adds, held(keys[2], x.behind)), len(ids))
        place = to[keys[4]]
        at = np.where(place >= 0, _find(_place_hashes(place, blocks[15]), cold_keys), -1)
        s[3] += np.bincount(docs[4], times[4] * _at(cold_adds, at), len(ids))
        for place, d, t in ((to[keys[1] // size], docs[1], times[1]), (to[keys[3]], docs[3], times[3])):
            counts = _at(x.counts, place)
            logs = t * np.log10(counts + 1)
            s[1] += np.bincount(d, t * (counts > 0), len(ids))
            s[2] += np.bincount(d, logs, len(ids))
            adds = logs + t * model.unknown if model.vocabulary is not None else t * np.where(place >= 0, _at(x.adds, place), model.unknown)
            s[3] += np.bincount(d, adds, len(ids))
        sums.append((ids, s))
    ids, s = _added(sums)
    some = [(p, _sums_cell(ids[i], s[:, i])) for p, i in _split(_bucket(ids.view(np.uint64), n))]
    return _table(some, "part int, data binary")


def _place_hashes(place: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(mixed(place.astype(np.uint64)) + w)


def _totalled(table: pa.Table) -> pa.Table:
    i, s = _added([_sums_of(c) for c in table["data"]])
    tokens, known = (np.rint(x).astype(np.int64) for x in s[:2])
    return pa.Table.from_arrays([ids_array(i), *map(pa.array, (tokens, known, s[2], s[3]))], ["doc_id", "n_tokens", "n_known", "known_log", "score"])


def score(docs: DataFrame, fitted: Fitted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per id: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    A-Z in lower case; tokens are the words between ASCII white space and one end. base_score: tokens by
    their counts with one added. score: log10 probability of the text under the Katz model. Null and empty
    texts are an end alone. Rows that repeat an id are scored as parts of one document; null ids are one
    id. Other columns are ignored; no rows give no rows; after no training all tokens are unknown.
    """
    model = fitted.model
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by hot_part, or by least_part

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 12 << 20):
            yield from _table(_entries(part, held.value), ENTRIES).to_batches()

    entries = plain(docs, id_col, text_col).mapInArrow(ask, ENTRIES)
    none = F.lit(b"")
    pairs = fitted.pairs.select("bucket", F.lit(TABLE_ROW).alias("kind"), F.lit(0).alias("of"), F.col("hot").alias("data"), "half", "cold")
    counts = fitted.counts.select("bucket", F.lit(ANSWER).alias("kind"), "of", "data", none.alias("half"), none.alias("cold"))
    met = entries.union(pairs).union(counts)
    answers = met.groupBy("bucket").applyInArrow(lambda t: _answers(t, held.value), "part int, data binary")
    sums = answers.groupBy("part").applyInArrow(_totalled, "doc_id long, n_tokens long, n_known long, known_log double, score double")
    base = F.col("known_log") - F.col("n_tokens") * F.log10(F.lit(float(fitted.total + fitted.distinct + 1)))
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(fitted.total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
