"""Target-distribution importance resampling with segment deduplication.

Documents are drawn so that the words they hold come near those of a target. A feature is a run of words, hashed
to a bucket; a bucket's gain is the log of its share in the target over its share in the corpus; a document's
weight is the mean gain of its features, and Gumbel noise from its id turns weights into a draw without
replacement.

Line ends cut texts into segments, and corpora repeat segments. Each different segment's features are hashed once
and stored; corpus sums are these times the segment's occurrences, documents add up the gains of their segments.
Runs that cross a line end belong to no segment and are counted for each document apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from facetwise.llm.common import LOWER, Docs, Words, blob, column_bytes, plain, slices, split_words, stored
from facetwise.llm.licenses import BREAKS

#: A segment that is more than one in so many segments is looked up by broadcast: so many at most.
HOT = 1000
COPIES_AT_ONCE = 4096


# ---------------------------------------------------------------- inside tasks


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


CRC = _crc_table()


def crc32s(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span of bytes, one byte of all spans at a time."""
    c = np.full(len(start), 0xFFFFFFFF, np.uint32)
    todo, at = np.flatnonzero(length > 0), 0
    while len(todo):
        x = c[todo]
        c[todo] = CRC[(x ^ data[start[todo] + at]) & np.uint32(255)] ^ (x >> np.uint32(8))
        at += 1
        todo = todo[length[todo] > at]
    return ~c


class _Joined:
    """Words in lower case, joined by one space, so that a run of words is a span of bytes."""

    def __init__(self, docs: Docs):
        data = LOWER[docs.data]
        self.words: Words = split_words(docs, BREAKS)
        start, size = self.words.start, self.words.length + 1
        ends = np.cumsum(size)
        take = np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        self.data = np.append(data, np.uint8(32))[np.minimum(take, len(data))]
        self.data[ends - 1] = 32
        self.start, self.end = ends - size, ends - 1
        self.doc = self.words.docs()

    def buckets(self, at: np.ndarray, n: int, buckets: int) -> np.ndarray:
        return (crc32s(self.data, self.start[at], self.end[at + n - 1] - self.start[at]) % np.uint32(buckets)).astype(np.uint32)

    def runs(self, n: int) -> np.ndarray:
        """Words from which ``n`` words of one text run."""
        m = max(len(self.doc) - n + 1, 0)
        return np.flatnonzero(self.doc[:m] == self.doc[n - 1 : n - 1 + m])


def _numbered(batch: pa.RecordBatch, column: int) -> Iterator[Docs]:
    """Slices of a column of texts, with row numbers for ids."""
    rows = pa.array(np.arange(batch.num_rows, dtype=np.int64))
    return slices(iter([pa.RecordBatch.from_arrays([rows, batch.column(column)], ["row", "text"])]))


def _by_row(doc: np.ndarray, values: np.ndarray, rows: int) -> list[bytes]:
    """The values of each row as bytes, rows in order."""
    order = np.argsort(doc, kind="stable")
    values, ends = values[order], np.cumsum(np.bincount(doc, minlength=rows))
    return [blob(x) for x in np.split(values, ends[:-1])] if rows else []


def _segment_features(max_n: int, buckets: int):
    """(seg, raw, target, line) to (seg, raw, target, words, features), the buckets of all runs in a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _numbered(batch, 3):
                j = _Joined(part)
                at = [j.runs(n) for n in range(1, max_n + 1)]
                values = np.concatenate([j.buckets(a, n, buckets) for n, a in enumerate(at, 1)])
                features = _by_row(np.concatenate([j.doc[a] for a in at]), values, len(part.ids))
                kept = batch.slice(int(part.ids[0]), len(part.ids))
                words = pa.array(np.diff(j.words.first).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [kept.column(0), kept.column(1), kept.column(2), words, pa.array(features, pa.binary())], ["seg", "raw", "target", "words", "features"]
                )

    return run


def _crossing_features(max_n: int, buckets: int):
    """(doc_id, key, raw, target, text) to the buckets of runs with a line end inside, where there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _numbered(batch, 4):
                j = _Joined(part)
                line = np.cumsum(part.data == 10)[j.words.start] if len(j.doc) else np.empty(0, np.int64)
                at = [(n, a[line[a] != line[a + n - 1]]) for n in range(2, max_n + 1) for a in [j.runs(n)]]
                values = np.concatenate([j.buckets(a, n, buckets) for n, a in at])
                features = _by_row(np.concatenate([j.doc[a] for _, a in at]), values, len(part.ids))
                kept = batch.slice(int(part.ids[0]), len(part.ids))
                out = pa.RecordBatch.from_arrays([*kept.columns[:4], pa.array(features, pa.binary())], ["doc_id", "key", "raw", "target", "features"])
                yield out.filter(pa.array([len(x) > 0 for x in features], pa.bool_()))

    return run


def _sums(buckets: int):
    """(raw, target, features) to the sums of a task by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            features = column_bytes(batch.column(2), np.uint32)
            if not features:
                continue
            flat, size = np.concatenate(features), np.array([len(x) for x in features])
            for row in (0, 1):
                np.add.at(total[row], flat, np.repeat(batch.column(row).to_numpy(zero_copy_only=False), size))
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["bucket", "s", "t"])

    return run


def _gains(gain: np.ndarray, kept: list[str]):
    """The number and the gains of each row's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = column_bytes(batch.column("features"), np.uint32)
            n = np.array([len(x) for x in features], np.int64)
            all_ = np.concatenate([np.zeros(1, np.int64), np.cumsum(gain[np.concatenate([np.empty(0, np.uint32), *features])])])
            ends = np.cumsum(n)
            columns = [*(batch.column(c) for c in kept), pa.array(n), pa.array(all_[ends] - all_[ends - n])]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "n_features", "gain"])

    return run


# ---------------------------------------------------------------- tables


def _digest(c: str):
    return F.unhex(F.md5(F.col(c)))


def _bucket_gains(features: list[DataFrame], buckets: int) -> np.ndarray:
    """The gain of each bucket; ``buckets`` numbers reach the driver."""
    sums = None
    for f in features:
        part = f.select("raw", "target", "features").mapInArrow(_sums(buckets), "bucket long, s long, t long")
        sums = part if sums is None else sums.unionByName(part)
    sums = stored(sums.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "resampling-buckets")
    all_ = sums.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("S"), F.coalesce(F.sum("t"), F.lit(0)).alias("T")).first()
    d = lambda c: F.col(c).cast("double")
    share = (d("t") + 1.0) * F.lit(float(all_["S"] + buckets)) / ((d("s") + 1.0) * F.lit(float(all_["T"] + buckets)))
    out = np.zeros(buckets, np.int64)
    for r in sums.select("bucket", F.floor(F.lit(1000.0) * F.log(share)).alias("gain")).collect():
        out[r["bucket"]] = r["gain"]
    return out


def weights(docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = 10_000, id_col: str = "doc_id",
            text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, key, copies, n_words, n_features, weight) of each different pair of id and text; key is the text's MD5.

    Words are runs of digits, letters and bytes beyond ASCII, A-Z in lower case. Features: all runs of 1 to ``max_n``
    words, joined by one space; the bucket is their CRC-32 modulo ``buckets``. Gain: floor(1000 ln((t+1)(S+buckets) /
    ((s+1)(T+buckets)))); weight: the floored mean of a document's gains, 0 without features.
    Null texts are empty. Rows that repeat both id and text are one row with their number as copies; they count as
    often in the sums. Null ids are kept. Other columns are ignored. An empty target has no features: all its counts
    are 0. No rows give no rows.
    """
    rows = plain(docs, id_col, text_col).withColumn("key", _digest("text"))
    wanted = target.select(F.coalesce(F.col(f"`{target_col}`").cast("string"), F.lit("")).alias("text"))
    counted = lambda df, raw, t: df.select(F.explode(F.split("text", "\n", -1)).alias("line"), F.lit(raw).cast("long").alias("raw"), F.lit(t).cast("long").alias("target"))
    lines = counted(rows, 1, 0).unionByName(counted(wanted, 0, 1)).where("line <> ''")
    lines = lines.groupBy("line").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    segments = lines.select(_digest("line").alias("seg"), "raw", "target", "line").mapInArrow(
        _segment_features(max_n, buckets), "seg binary, raw long, target long, words long, features binary"
    )
    segments = stored(segments, "resampling-segments")
    tables, crossing = [segments], None
    if max_n > 1:
        both = rows.select("doc_id", "key", F.lit(1).cast("long").alias("raw"), F.lit(0).cast("long").alias("target"), "text").unionByName(
            wanted.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("raw"), F.lit(1).cast("long").alias("target"), "text")
        )
        crossing = both.mapInArrow(_crossing_features(max_n, buckets), "doc_id long, key binary, raw long, target long, features binary")
        crossing = stored(crossing, "resampling-crossing")
        tables.append(crossing)
    gain = _bucket_gains(tables, buckets)

    worth = segments.where("raw > 0").mapInArrow(_gains(gain, ["seg", "raw", "words"]), "seg binary, raw long, words long, n_features long, gain long")
    worth = stored(worth, "resampling-gains")
    n_segments = worth.agg(F.sum("raw")).first()[0] or 0
    few = worth.where(F.col("raw") * HOT > n_segments).select("seg", F.col("words").alias("w"), F.col("n_features").alias("f"), F.col("gain").alias("g"))

    # Every document keeps its first line, so that it is there and its copies are counted.
    place = rows.select("doc_id", "key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where("pos = 0 OR line <> ''")
    place = place.select("doc_id", "key", (F.col("pos") == 0).cast("long").alias("copies"), _digest("line").alias("seg"))
    met = place.join(F.broadcast(few), "seg", "left")
    met = met.withColumn("seg", F.when(F.col("f").isNull(), F.col("seg")).otherwise(F.col("key")))  # dealt by document, to meet nothing
    met = met.join(worth.drop("raw"), "seg", "left").select(
        "doc_id", "key", "copies", *(F.coalesce(a, b, F.lit(0)).alias(b) for a, b in (("w", "words"), ("f", "n_features"), ("g", "gain")))
    )
    if crossing is not None:
        more = crossing.where("raw > 0").mapInArrow(_gains(gain, ["doc_id", "key"]), "doc_id long, key binary, n_features long, gain long")
        met = met.unionByName(more.select("doc_id", "key", F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("words"), "n_features", "gain"))
    sums = met.groupBy("doc_id", "key").agg(*(F.sum(c).alias(c) for c in ("copies", "words", "n_features", "gain")))
    return sums.select(
        "doc_id", "key", "copies", F.expr("words div copies").alias("n_words"), F.expr("n_features div copies").alias("n_features"),
        F.expr("CASE WHEN n_features = 0 THEN 0L ELSE (gain - pmod(gain, n_features)) div n_features END").alias("weight"),
    )


def _ahead(counts: DataFrame) -> DataFrame:
    """(score, n) to (score, ahead): how many rows have a larger score, by ranges of 256 scores. There are as many
    ranges as the scores, which are logarithms, allow: some hundreds."""
    counts = counts.withColumn("range", F.expr("(score - pmod(score, 256)) div 256"))
    before = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy("range").agg(F.sum("n").alias("all")).select("range", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("outer"))
    within = Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    inner = counts.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return inner.join(F.broadcast(ranges), "range").select("score", (F.col("outer") + F.col("inner")).alias("ahead"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: str = "2024", **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank, text_md5.

    score is the weight plus floor(-1000 ln(-ln((h + 0.5) / 2^32))), h the first 8 hex digits of the SHA-256 of
    seed:doc_id (a null id: nothing after the colon). Of the N documents with ``min_words`` words the floor(percent N / 100)
    with the highest scores are drawn, ties to the smaller id, a null id first; rank counts from 1, null for those not drawn.
    Features, options and odd rows: see ``weights``. Rows that repeat id and text stay as many rows with ranks one
    after the other.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(weights(docs, target, **options).withColumn("score", (F.col("weight") + noise).cast("long")), "resampling-scores")
    able = scored.where(F.col("n_words") >= min_words)
    counts = able.groupBy("score").agg(F.sum("copies").alias("n"))
    drawn = (able.agg(F.sum("copies")).first()[0] or 0) * percent // 100
    own = Window.partitionBy("score").orderBy("doc_id", "key").rowsBetween(Window.unboundedPreceding, -1)
    # Scores nobody is drawn with need no order.
    ahead = _ahead(stored(counts, "resampling-counts")).where(F.col("ahead") < drawn)
    first = able.join(ahead, "score").select(
        "doc_id", "key", (F.col("ahead") + F.coalesce(F.sum("copies").over(own), F.lit(0))).alias("first")
    )
    same = F.col("s.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("s.key") == F.col("f.key"))
    ranked = scored.alias("s").join(first.alias("f"), same, "left").select("s.*", "f.first")
    # Copies as rows again, some thousands at a time.
    some = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES_AT_ONCE).cast("long"))).alias("low")
    ranked = ranked.select("*", some).select("*", F.explode(F.sequence("low", F.least(F.col("low") + COPIES_AT_ONCE, F.col("copies")) - 1)).alias("copy"))
    rank = F.col("first") + F.col("copy") + 1
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"), F.lower(F.hex("key")).alias("text_md5"))


def drawn_documents(docs: DataFrame, ranked: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``resample`` drew, all columns. Of rows that repeat id and text all come where one is drawn."""
    drawn = ranked.where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("_drawn_id"), F.col("text_md5").alias("_drawn_text")).distinct()
    text = F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    return docs.join(drawn, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_drawn_id")) & (text == F.col("_drawn_text")), "left_semi")
