"""Benchmark decontamination with an FM-index for each shard of training text.

Texts become sequences of word numbers, cut into shards. A shard's suffix array gives its Burrows-Wheeler
transform, kept as a wavelet matrix of bit planes with counts, so that the rank of a word before any place takes
one lookup a plane. All test phrases are searched backward side by side; the rows of the ranges that are left walk
back to the next sampled suffix, which names their place. Places become spans of words to remove, merged per
document.

Word numbers come from 64-bit hashes; each place found is held against the bytes of the phrase.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from facetwise.llm.common import LOWER, Docs, Words, plain, slices, split_words, stored, word_hashes
from facetwise.llm.licenses import BREAKS

WINDOW = 10
SLICE = 8 << 20
#: Words of a shard; longer sequences are cut with an overlap of a window.
SHARD_WORDS = 1 << 20
#: Every suffix at a place divisible by this is sampled.
SAMPLED = 16
#: Different windows that go to the tasks at a time, of ten words and a list of items each; more are dealt by hash
#: into blocks of about half of it.
BLOCK = 1 << 17
FOUND = "doc_id long, text_md5 string, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


# ---------------------------------------------------------------- the index


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The order of the suffixes of ``s``, whose last number is its only 0; prefixes double, and only suffixes
    that are still equal are sorted again."""
    n = len(s)
    width = max(int(s.max()).bit_length(), 1)
    depth = max(62 // width, 1)
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key <<= width
        key[: max(n - k, 0)] |= s[k:]
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # the first place of each group of equals
    rank[order] = head
    while True:
        alone = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return order
        at = order[open_]
        key = np.full(len(at), -1, np.int64)
        after = at + depth
        key[after < n] = rank[after[after < n]]
        group = head[open_]
        again = np.argsort(group * np.int64(n + 1) + key + 1, kind="stable")
        order[open_] = at[again]
        key, group = key[again], group[again]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        new[open_] = fresh
        head[open_] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        rank[order[open_]] = head[open_]
        depth *= 2


class _Bits:
    """A row of bits that counts its ones before any place."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        raw = np.zeros((n // 64 + 1) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        raw[: len(packed)] = packed
        self.words = raw.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = n - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, low = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << low) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


class FMIndex:
    """Backward search and places for a sequence of numbers above 0."""

    def __init__(self, s: np.ndarray):
        s = np.append(s, 0)
        order = suffix_array(s)
        last = s[order - 1]  # the transform; the whole sequence is preceded by its end
        self.width = max(int(s.max()).bit_length(), 1)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(s))])
        self.planes: list[_Bits] = []
        v = last
        for k in range(self.width - 1, -1, -1):
            bit = (v >> k) & 1 > 0
            self.planes.append(_Bits(bit))
            v = np.concatenate([v[~bit], v[bit]])
        marked = order % SAMPLED == 0
        self.marked, self.samples = _Bits(marked), order[marked]
        self.begin = self._down(np.arange(len(self.less) - 1), np.zeros(len(self.less) - 1, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where place ``at`` of the transform comes to in the last plane, for a symbol."""
        for k, plane in zip(range(self.width - 1, -1, -1), self.planes):
            ones = plane.ones(at)
            at = np.where((symbol >> k) & 1 > 0, plane.zeros + ones, at - ones)
        return at

    def extended(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first row whose suffix begins with ``symbol``, plus the rank of it before ``at``."""
        return self.less[symbol] + self._down(symbol, at) - self.begin[symbol]

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of each phrase, the words of which end each line of ``phrases``."""
        n = len(sizes)
        low, high = np.zeros(n, np.int64), np.full(n, self.less[-1])
        for step in range(phrases.shape[1]):
            live = np.flatnonzero((sizes > step) & (low < high))
            c = phrases[live, phrases.shape[1] - 1 - step]
            low[live], high[live] = self.extended(c, low[live]), self.extended(c, high[live])
        return low, high

    def places(self, rows: np.ndarray) -> np.ndarray:
        """The place of the suffix of each row: back word by word to a sampled one."""
        out, steps = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        at = rows.copy()
        while len(todo):
            there = self.marked.get(at)
            out[todo[there]] = self.samples[self.marked.ones(at[there])] + steps[todo[there]]
            todo, at = todo[~there], at[~there]
            steps[todo] += 1
            symbol, place = np.zeros(len(at), np.int64), at
            for plane in self.planes:
                bit, ones = plane.get(place), plane.ones(place)
                symbol = symbol * 2 + bit
                place = np.where(bit, plane.zeros + ones, place - ones)
            at = self.less[symbol] + place - self.begin[symbol]
        return out


# ---------------------------------------------------------------- test phrases


class Phrases(NamedTuple):
    """Different windows of test items: their words, the hashes of these at the end of lines of WINDOW, and items."""

    words: list[list[bytes]]
    hashes: np.ndarray
    sizes: np.ndarray
    items: list[list[str]]


def phrases_of(rows: list[tuple[str, list[str]]], width: int) -> Phrases:
    """From (phrase, item ids) rows."""
    words = [p.encode().split(b" ") for p, _ in rows]
    flat = b" ".join(w for ws in words for w in ws)
    docs = Docs(np.zeros(1, np.int64), np.frombuffer(flat, np.uint8), np.array([0, len(flat)]))
    h = word_hashes(docs.data, split_words(docs, BREAKS))
    sizes = np.array([len(ws) for ws in words], np.int64)
    out = np.zeros((len(words), width), np.uint64)
    ends = np.cumsum(sizes)
    for k in range(width):  # the word k before the last
        has = sizes > k
        out[has, width - 1 - k] = h[ends[has] - 1 - k]
    return Phrases(words, out, sizes, [list(i) for _, i in rows])


# ---------------------------------------------------------------- inside tasks


def _shard_hits(doc: np.ndarray, h: np.ndarray, known: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(place, phrase) of every phrase in a sequence of words; documents are parted by a number of their own."""
    names, number = np.unique(h, return_inverse=True)
    at = np.searchsorted(names, known.hashes)
    at[at == len(names)] = 0
    used = np.arange(known.hashes.shape[1])[None, :] >= known.hashes.shape[1] - known.sizes[:, None]
    there = (names[at] == known.hashes) | ~used
    able = np.flatnonzero(there.all(axis=1))
    if not len(able):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # 1 parts documents, words are numbered from 2.
    parted = np.flatnonzero(np.diff(doc)) + 1
    s = np.insert(number.astype(np.int64) + 2, parted, 1)
    index = FMIndex(s)
    low, high = index.search(at[able] + 2, known.sizes[able])
    n = high - low
    which = np.repeat(np.arange(len(able)), n)
    rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]
    place = index.places(rows)
    # The separators before a place are no words.
    return place - np.searchsorted(parted + np.arange(len(parted)), place), able[which]


def _hits(part: Docs, words: Words, data: np.ndarray, known: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(first word, phrase) of all phrases in a slice of texts, found through the index of each shard."""
    h, doc = word_hashes(data, words), words.docs()
    over = known.hashes.shape[1] - 1
    places, phrases = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a in range(0, len(h), SHARD_WORDS):
        z = min(a + SHARD_WORDS + over, len(h))
        p, f = _shard_hits(doc[a:z], h[a:z], known)
        places.append(p + a)
        phrases.append(f)
    place, phrase = np.concatenate(places), np.concatenate(phrases)
    same = np.ones(len(place), bool)
    for i, (p, f) in enumerate(zip(place, phrase)):
        for k, w in enumerate(known.words[f]):
            at = words.start[p + k]
            if data[at : at + words.length[p + k]].tobytes() != w:
                same[i] = False
                break
    return place[same], phrase[same]


def _search(known):
    """(doc_id, text_md5, text) to FOUND, for the phrases of a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = known.value
        for batch in batches:
            numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows, dtype=np.int64)), batch.column(2)], ["row", "text"])
            for part in slices(iter([numbered]), SLICE):
                data = LOWER[part.data]
                words = split_words(part, BREAKS)
                place, phrase = _hits(part, words, data, phrases)
                n = len(words.start)
                cover = np.zeros(n + 1, np.int64)
                np.add.at(cover, place, 1)
                np.add.at(cover, place + phrases.sizes[phrase], -1)
                hit = np.cumsum(cover)[:n] > 0
                doc = words.docs()
                begins, ends = hit.copy(), hit.copy()  # spans end with their document
                if n:
                    near = hit[1:] & hit[:-1] & (doc[1:] == doc[:-1])
                    begins[1:] &= ~near
                    ends[:-1] &= ~near
                first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
                base = words.first[doc[first]] if n else first
                rows = np.searchsorted(doc[first], np.arange(len(part.ids) + 1)).astype(np.int32)
                span = pa.StructArray.from_arrays([pa.array(first - base), pa.array(last - base)], ["start", "end"])
                pairs = sorted({(int(d), i) for d, f in set(zip(doc[place].tolist(), phrase.tolist())) for i in phrases.items[f]})
                item_rows = np.searchsorted(np.array([d for d, _ in pairs], np.int64), np.arange(len(part.ids) + 1)).astype(np.int32)
                kept = batch.slice(int(part.ids[0]), len(part.ids))
                yield pa.RecordBatch.from_arrays(
                    [kept.column(0), kept.column(1), pa.array(np.diff(words.first)), pa.ListArray.from_arrays(pa.array(rows), span),
                     pa.ListArray.from_arrays(pa.array(item_rows), pa.array([i for _, i in pairs], pa.string()))],
                    ["doc_id", "text_md5", "n_words", "spans", "items"],
                )

    return run


# ---------------------------------------------------------------- tables


def windows(items: DataFrame, width: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(phrase, items): the different windows of ``width`` words of the items' texts, shorter texts whole, and who has them."""
    lower = F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), lambda w: w != "")
    rows = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"), words.alias("w")).where(F.size("w") > 0)
    first = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))).alias("i")
    cut = rows.select("item", "w", first).select("item", F.array_join(F.slice("w", F.col("i"), F.lit(width)), " ").alias("phrase"))
    return cut.groupBy("phrase").agg(F.sort_array(F.collect_set("item")).alias("items"))


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW, block: int = BLOCK, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_md5, n_words, spans (merged, of words that test windows cover: start, end
    behind the last), items (ids of test items with windows in it, as sorted texts).

    Words are runs of digits, letters and bytes beyond ASCII, A-Z in lower case. Windows are ``width`` consecutive
    words of an item, a shorter item is one window. Null texts have no words; null item ids are the empty name;
    items that repeat an id are one item. Rows that repeat come back as they are, null ids too. Other columns are
    ignored; no items, or none with words, give no spans; no rows give no rows.

    Windows go to the tasks in blocks of no more than about ``block``, one pass over the texts for each.
    """
    spark = docs.sparkSession
    table = stored(windows(items, width, item_col, item_text_col), "test-windows")
    n = table.count()
    blocks = 1 if n <= block else 2 * -(-n // block)
    part = F.pmod(F.xxhash64("phrase"), F.lit(blocks))
    rows = plain(docs, id_col, text_col).select("doc_id", F.md5("text").alias("text_md5"), "text")
    found = []
    for b in range(blocks):
        some = [(r["phrase"], r["items"]) for r in table.where(part == b).select("phrase", "items").toLocalIterator()]
        known = spark.sparkContext.broadcast(phrases_of(some, width))
        found.append(rows.mapInArrow(_search(known), FOUND))
    if len(found) == 1:
        return found[0]
    # More than one block: spans of equal texts under equal ids are brought together and merged again.
    hits = None
    for f in found:
        f = f.where("size(spans) > 0").select("doc_id", "text_md5", "spans", "items").distinct()
        hits = f if hits is None else hits.unionByName(f)
    merged = hits.groupBy("doc_id", "text_md5").agg(
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("all"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("found")
    )
    join = F.expr(
        "aggregate(all, cast(array() AS array<struct<start:bigint,end:bigint>>), (done, x) -> CASE"
        " WHEN size(done) > 0 AND element_at(done, -1).end >= x.start THEN concat(slice(done, 1, size(done) - 1),"
        " array(struct(element_at(done, -1).start AS start, greatest(element_at(done, -1).end, x.end) AS end)))"
        " ELSE concat(done, array(x)) END)"
    )
    merged = stored(merged.select("doc_id", "text_md5", join.alias("joined"), "found"), "test-spans")
    all_ = rows.select(
        "doc_id", "text_md5", F.size(F.filter(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1), lambda w: w != "")).cast("long").alias("n_words")
    ).alias("r")
    same = F.col("r.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("r.text_md5") == F.col("m.text_md5"))
    return all_.join(merged.alias("m"), same, "left").select(
        "r.doc_id", "r.text_md5", "r.n_words",
        F.coalesce("joined", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
        F.coalesce("found", F.array().cast("array<string>")).alias("items"),
    )


def clean_texts(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): the texts of documents without the bytes from the first to the last word of each span; null
    texts are empty, texts without spans stay as they are."""
    cut = found.where("size(spans) > 0").select("doc_id", "text_md5", "spans").distinct().alias("c")
    rows = plain(docs, id_col, text_col).withColumn("text_md5", F.md5("text")).alias("r")
    same = F.col("r.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("r.text_md5") == F.col("c.text_md5"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if spans:
                    raw = text.encode()
                    words = split_words(Docs(np.zeros(1, np.int64), np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), BREAKS)
                    ends = words.start + words.length
                    at, out = 0, []
                    for s in spans:
                        out.append(raw[at : words.start[s["start"]]])
                        at = int(ends[s["end"] - 1])
                    text = b"".join([*out, raw[at:]]).decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.join(cut, same, "left").select("r.doc_id", "r.text", "c.spans").mapInArrow(run, "doc_id long, text string")
