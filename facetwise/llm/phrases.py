"""Phrase collocations by Rabin-Karp fingerprints.

A word is a 64-bit symbol, a phrase the polynomial of its symbols after that of its language, modulo 2^64. Prefix
sums of symbols times powers give the fingerprint of every n-gram of a slice of texts at once. Phrases are counted
by length: an n-gram is counted only where both of its parts of n - 1 words may be frequent. A shuffle adds up
fingerprints and keeps, for each, the smallest hash of a document that holds it: the pointer by which frequent
phrases, and only these, are turned into words again.

Collisions are excluded, not hoped away. Words are held against their text: a fingerprint for which two different
words (or languages) were seen is listed, its words get other symbols, and words are counted again. Longer phrases
are counted by their own fingerprint together with that of all but their last word; both equal means an equal last
symbol, so equal words from the left on.

What may be frequent is told by bitmaps of fingerprints, of 2^27 bits at most. They only spare work: a bit that
stands for several phrases lets more be counted, never fewer.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from facetwise.llm.common import LOWER, MASKS, Docs, Words, mixed, slices, split_words, stored, word_hashes

UNKNOWN = "und"
#: Pieces end here; words stand between these, spaces and tabs.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BREAKS = ENDS.copy()
BREAKS[[0x20, 0x09]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes of text at a time, and entries that a task adds up before it gives them away.
SLICE = 2 << 20
ENTRIES = 1 << 20
MAX_BITS = 27
SHARES = 32
#: Words that share a fingerprint with another; more of them than this stop the job.
MAX_COLLIDED = 100_000
WORDS = "fp long, n long, lang string, word string"
COUNTS = "fp long, prefix long, n long, doc long"
PHRASES = "size int, fp long, prefix long, lang string, phrase string"


# ---------------------------------------------------------------- inside tasks


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Grams:
    """The words of some texts as symbols, and the fingerprints of all their n-grams."""

    def __init__(self, docs: Docs, lang: np.ndarray, collided: np.ndarray, bits: int):
        self.docs = docs._replace(data=LOWER[docs.data])
        data = self.docs.data
        self.words: Words = split_words(self.docs, BREAKS)
        doc = self.doc = self.words.docs()
        ended = np.cumsum(ENDS[data], dtype=np.int64)
        self.piece = (ended[self.words.start] if len(doc) else np.empty(0, np.int64)) + doc
        self.lang = lang[doc]
        h = word_hashes(data, self.words) & np.uint64((1 << bits) - 1)
        for i in np.flatnonzero(np.isin(self.lang * BASE + h, collided)) if len(collided) else ():
            a = self.words.start[i]
            h[i] = mixed(h[i : i + 1] + np.uint64(1 + zlib.crc32(data[a : a + self.words.length[i]].tobytes())))[0]
        n = len(h)
        self.up = _powers(BASE, n + 8)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(UNBASE, n), dtype=np.uint64)])

    def prints(self, n: int) -> np.ndarray:
        """The fingerprint of the ``n`` words from each word on, as far as there are so many."""
        m = max(len(self.doc) - n + 1, 0)
        return (self.sums[n : n + m] - self.sums[:m]) * self.up[n - 1 : n - 1 + m] + self.lang[:m] * self.up[n]

    def inside(self, n: int) -> np.ndarray:
        m = max(len(self.doc) - n + 1, 0)
        return self.piece[:m] == self.piece[n - 1 : n - 1 + m]

    def same_words(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words have equal bytes, pair by pair, eight bytes of all pairs at a time."""
        start, length = self.words.start, self.words.length
        padded = np.concatenate([self.docs.data, np.zeros(8, np.uint8)])
        lanes = np.ndarray((len(self.docs.data) + 1,), "<u8", buffer=padded, strides=(1,))
        same = length[a] == length[b]
        todo, at = np.flatnonzero(same & (a != b)), 0
        while len(todo):
            left = MASKS[np.minimum(length[a[todo]] - at, 8)]
            equal = (lanes[start[a[todo]] + at] & left) == (lanes[start[b[todo]] + at] & left)
            same[todo[~equal]] = False
            at += 8
            todo = todo[equal & (length[a[todo]] > at)]
        return same

    def texts(self, at: np.ndarray, n: int) -> pa.Array:
        """The ``n`` words from each given word on, joined by one space."""
        which = (at[:, None] + np.arange(n)).ravel()
        start, size = self.words.start[which], self.words.length[which] + 1
        ends = np.cumsum(size)
        take = np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        data = np.append(self.docs.data, np.uint8(32))[np.minimum(take, len(self.docs.data))]
        data[ends - 1] = 32
        stop = ends[n - 1 :: n] - 1  # the space after the last word is left out below
        begin = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
        keep = np.ones(len(data), bool)
        keep[stop] = False
        offsets = np.concatenate([[0], np.cumsum(stop - begin)]).astype(np.int64)
        raw = pa.Array.from_buffers(pa.large_string(), len(stop), [None, pa.py_buffer(offsets), pa.py_buffer(data[keep])])
        return raw.cast(pa.string())


class Bitmap(NamedTuple):
    """Bits by the leading bits of 64-bit numbers."""

    bits: np.ndarray
    width: int

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = (keys >> np.uint64(64 - self.width)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _cut(part: Docs, limit: int) -> Iterator[Docs]:
    """A long text in parts that end where a piece ends; no n-gram is cut."""
    if len(part.ids) > 1 or len(part.data) <= 2 * limit:
        yield part
        return
    at, n = 0, len(part.data)
    while at < n:
        rest = ENDS[part.data[at + limit : at + 2 * limit]]
        end, step = at + limit, limit
        while end < n and not rest.any():
            end += step
            rest = ENDS[part.data[end : end + step]]
        end = min(end + int(rest.argmax()) + 1, n) if end < n else n
        yield Docs(part.ids, part.data[at:end], np.array([0, end - at]))
        at = end


def _parts(batches: Iterator[pa.RecordBatch], collided: np.ndarray, bits: int, limit: int) -> Iterator[tuple[Grams, np.ndarray, pa.Array]]:
    """The n-grams of (doc, lang, text) batches: with the documents' pointers and languages."""
    for batch in batches:
        langs = batch.column(1).dictionary_encode()
        codes = [np.uint64(xxhash.xxh64_intdigest(x.as_py())) for x in langs.dictionary]
        if len(set(codes)) < len(codes):
            raise ValueError("two languages share a hash")
        code = np.array(codes, np.uint64)[langs.indices.to_numpy(zero_copy_only=False)] if codes else np.empty(0, np.uint64)
        pointers = batch.column(0).to_numpy(zero_copy_only=False)
        rows = pa.array(np.arange(batch.num_rows, dtype=np.int64))
        numbered = pa.RecordBatch.from_arrays([rows, batch.column(2)], ["row", "text"])
        for whole in slices(iter([numbered]), limit):
            for part in _cut(whole, limit):
                yield Grams(part, code[part.ids], collided, bits), pointers[part.ids], batch.column(1).take(pa.array(part.ids))


def _added(fp, prefix, n, doc):
    """Entries with equal fingerprints as one: their sum, and the smallest pointer."""
    order = np.lexsort((doc, prefix, fp))
    fp, prefix, n, doc = fp[order], prefix[order], n[order], doc[order]
    new = np.ones(len(fp), bool)
    new[1:] = (fp[1:] != fp[:-1]) | (prefix[1:] != prefix[:-1])
    at = np.flatnonzero(new)
    return fp[at], prefix[at], np.add.reduceat(n, at) if len(at) else n, doc[at]


def _counted(size: int, known: Bitmap, collided, bits, limit):
    """Entries (fingerprint, that of all but the last word, count, pointer) of n-grams whose parts may be frequent."""

    def batch_of(entries) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in entries], ["fp", "prefix", "n", "doc"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n_held = 0
        for g, pointers, _ in _parts(batches, collided, bits, limit):
            shorter = g.prints(size - 1)
            may = known.holds(shorter)
            at = np.flatnonzero(may[:-1] & may[1:] & g.inside(size)) if len(shorter) > 1 else np.empty(0, np.int64)
            entries = _added(g.prints(size)[at], shorter[at], np.ones(len(at), np.int64), pointers[g.doc[at]])
            held.append(entries)
            n_held += len(entries[0])
            if n_held > ENTRIES:
                held = [_added(*(np.concatenate(x) for x in zip(*held)))]
                n_held = len(held[0][0])
                if n_held > ENTRIES // 2:
                    yield batch_of(held[0])
                    held, n_held = [], 0
        if n_held:
            yield batch_of(_added(*(np.concatenate(x) for x in zip(*held))))

    return run


def _words(collided, bits, limit):
    """Different words of each slice with their counts and texts, and under an empty word all words of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["fp", "n", "lang", "word"]
        for g, _, langs in _parts(batches, collided, bits, limit):
            if not len(g.doc):
                continue
            fp, first, back, n = np.unique(g.prints(1), return_index=True, return_inverse=True, return_counts=True)
            odd = np.flatnonzero(~g.same_words(first[back], np.arange(len(back))))  # other words under the fingerprint
            n = n - np.bincount(back[odd], minlength=len(n))
            fp, at = np.concatenate([fp, fp[back[odd]]]), np.concatenate([first, odd])
            n = np.concatenate([n, np.ones(len(odd), np.int64)]).astype(np.int64)
            lang = langs.take(pa.array(g.doc[at]))
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(n), lang, g.texts(at, 1)], names)
            code, first, n = np.unique(g.lang, return_index=True, return_counts=True)
            lang = langs.take(pa.array(g.doc[first]))
            empty = pa.array([""] * len(code), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n.astype(np.int64)), lang, empty], names)

    return run


def _phrases(known: dict[int, Bitmap], pointed: Bitmap, collided, bits, limit):
    """Phrases that may be frequent, in words, from documents that may be pointed at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, pointers, langs in _parts(batches, collided, bits, limit):
            there = pointed.holds(pointers.view(np.uint64))[g.doc]
            if not there.any():
                continue
            for size, bitmap in known.items():
                fp = g.prints(size)
                at = np.flatnonzero(there[: len(fp)] & g.inside(size) & bitmap.holds(fp))
                prefix = g.prints(size - 1)[at]
                _, first = np.unique(np.stack([fp[at], prefix]), axis=1, return_index=True)
                at, prefix = at[first], prefix[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), size, np.int32)), pa.array(fp[at].view(np.int64)), pa.array(prefix.view(np.int64)),
                     langs.take(pa.array(g.doc[at])), g.texts(at, size)], PHRASE_NAMES,
                )

    return run


PHRASE_NAMES = [c.split()[0] for c in PHRASES.split(", ")]


# ---------------------------------------------------------------- tables


def _bitmap(keys: DataFrame) -> Bitmap:
    """Bits for 64-bit keys, some 16 for each, at most 2^MAX_BITS; 4 KB of bits are made in each group."""
    n = keys.count()
    width = min(max(int(n).bit_length() + 4, 16), MAX_BITS)
    place = F.shiftrightunsigned("key", 64 - width) + 1
    made = keys.toDF("key").groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bits = np.zeros((1 << width) // 8, np.uint8)
    for r in made.toLocalIterator():
        bits[(r["part"] - 1) * 4096 :][:4096] = np.frombuffer(r["bits"], np.uint8)[: len(bits)]
    return Bitmap(bits, width)


def _word_counts(rows: DataFrame, min_count: int, bits: int, limit: int) -> tuple[DataFrame, np.ndarray]:
    """Frequent words and the totals by language (empty word), and the fingerprints whose words have other symbols."""
    collided = np.empty(0, np.uint64)
    while True:
        found = rows.mapInArrow(_words(collided, bits, limit), WORDS).groupBy("fp", F.col("word") == "").agg(
            F.sum("n").alias("n"), F.min("lang").alias("lang"), F.max("lang").alias("lang_2"),
            F.min("word").alias("word"), F.max("word").alias("word_2"),
        )
        clash = (F.col("word") != F.col("word_2")) | (F.col("lang") != F.col("lang_2"))
        kept = stored(found.where((F.col("n") >= min_count) | (F.col("word") == "") | clash), "phrase-words")
        rows_left = kept.where(clash).select("fp", "word").limit(MAX_COLLIDED + 1).collect()
        bad = [r["fp"] for r in rows_left]
        if not bad:
            return kept.select("lang", "word", "n", "fp"), collided
        if len(bad) + len(collided) > MAX_COLLIDED or any(not r["word"] for r in rows_left):
            raise ValueError("too many words, or two languages, share fingerprints")
        collided = np.concatenate([collided, np.array(bad, np.int64).view(np.uint64)])


def phrase_counts(docs: DataFrame, max_words: int = 4, min_count: int = 30, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang", bits: int = 64, limit: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``max_words`` words that stand ``min_count`` times or more: (lang, size, phrase, a); and the
    words of each language: (lang, n).

    Texts in lower case (A-Z) are cut at .,;:!? and line ends, then at spaces and tabs; a phrase lies within one
    such piece. Null texts are empty, null languages ``und``; ids only tell documents apart and may be null or
    repeat. Rows that repeat count each time. Other columns are ignored; no rows give no rows.
    """
    rows = docs.select(
        F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("doc"),
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    # Pointers of 32 leading bits: what they point at is looked up by its fingerprint anyway.
    rows = rows.withColumn("doc", F.col("doc").bitwiseAND(F.lit(-1 << 32)))
    words, collided = _word_counts(rows, min_count, bits, limit)
    totals = words.where("word = ''").select("lang", "n")
    words = words.where("word <> ''")

    known = {1: _bitmap(words.select("fp"))}
    tables = []
    for size in range(2, max_words + 1):
        entries = rows.mapInArrow(_counted(size, known[size - 1], collided, bits, limit), COUNTS)
        frequent = entries.groupBy("fp", "prefix").agg(F.sum("n").alias("a"), F.min("doc").alias("doc")).where(F.col("a") >= min_count)
        frequent = stored(frequent.withColumn("size", F.lit(size)), f"phrases-{size}")
        tables.append(frequent)
        known[size] = _bitmap(frequent.select("fp"))
    out = words.select("lang", F.lit(1).alias("size"), F.col("word").alias("phrase"), F.col("n").alias("a"))
    if tables:
        frequent = tables[0]
        for t in tables[1:]:
            frequent = frequent.unionByName(t)
        pointed = _bitmap(frequent.select("doc").distinct())
        found = rows.mapInArrow(_phrases({k: v for k, v in known.items() if k > 1}, pointed, collided, bits, limit), PHRASES).distinct()
        longer = frequent.join(found, ["size", "fp", "prefix"]).select("lang", "size", "phrase", "a")
        out = out.unionByName(longer)
    return stored(out, "phrases"), stored(totals, "phrase-totals")


# ---------------------------------------------------------------- scores


def _looked_up(df: DataFrame, text: str, count: str, phrases: DataFrame, hot: DataFrame) -> DataFrame:
    """``df`` with the count of the phrase in column ``text``. The few phrases that are part of very many come
    from a broadcast list; rows that met it are dealt by their own phrase, where they meet nothing."""
    few = hot.select("lang", F.col("phrase").alias(text), F.col("a").alias("_hot"))
    met = df.join(F.broadcast(few), ["lang", text], "left")
    met = met.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(text)).otherwise(F.concat(F.lit("\n"), "phrase")))
    all_ = phrases.select("lang", F.col("phrase").alias("_key"), F.col("a").alias("_a"))
    return met.join(all_, ["lang", "_key"], "left").withColumn(count, F.coalesce("_hot", "_a")).drop("_hot", "_a", "_key")


def collocations(docs: DataFrame, max_words: int = 4, min_count: int = 30, contained: int = 80, top: int = 2000, hot: int = 1000, **columns) -> DataFrame:
    """The best ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    a, l, r are the counts of a phrase and of its two parts at the cut where the score, floor(2,000,000 a / (l + r)),
    is lowest (the first such cut); n counts the words of the language. A phrase whose words stand inside a longer
    frequent one with at least ``contained`` percent of its count is left out. Ties: larger a, then the phrase.
    What counts as what, and odd rows, see ``phrase_counts``. ``hot``: a phrase with more than one in so many
    words of the corpus is looked up by broadcast; there are at most ``hot`` such phrases of each size.
    """
    phrases, totals = phrase_counts(docs, max_words, min_count, **columns)
    words = totals.agg(F.sum("n")).first()[0] or 0
    very = phrases.where(F.col("a") * hot > words)

    split = phrases.where("size > 1").withColumn("w", F.split("phrase", " "))
    cut = split.select("lang", "phrase", "size", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    part = lambda begin, length: F.array_join(F.slice("w", begin, length), " ")
    cut = cut.select("lang", "phrase", "size", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    cut = _looked_up(_looked_up(cut, "first", "l", phrases, very), "rest", "r", phrases, very)
    cut = cut.withColumn("score", F.expr("2000000 * CAST(a AS DECIMAL(20, 0)) div (l + r)").cast("long"))
    lowest = cut.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best"))

    inner = split.where("size > 2").select(
        "lang", F.col("a").alias("outer"),
        F.explode(F.expr(
            "flatten(transform(sequence(2, size - 1), s -> transform(sequence(1, size - s + 1), i -> array_join(slice(w, i, s), ' '))))"
        )).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    wide = lambda c, by: F.lit(by).cast("decimal(3,0)") * F.col(c).cast("decimal(20,0)")
    free = lowest.join(inner, ["lang", "phrase"], "left").where(F.col("outer").isNull() | (wide("outer", 100) < wide("a", contained)))
    # The best of each share of a language's phrases first, so that the last ranking reads SHARES * top rows at most.
    order = F.desc("score"), F.desc("a"), "phrase"
    ranked = free.select("lang", "phrase", "a", "best.l", "best.r", "best.score", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)).alias("share"))
    for by in (["lang", "share"], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
