"""What the corpus operators share: inputs, stored tables, and words as arrays inside tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Stands for a null id inside arrays; the smallest long.
NO_ID = np.iinfo(np.int64).min
SLICE_BYTES = 4 << 20


# ---------------------------------------------------------------- tables


def plain_columns(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """The id as doc_id (long) and the text as text (null becomes empty)."""
    return [
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    ]


def plain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, so that no other column can clash."""
    return docs.select(*plain_columns(id_col, text_col))


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only on a single machine without it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="facetwise-llm-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: work done once, lineage cut."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def buckets_of(spark: SparkSession, factor: int = 4) -> int:
    """Buckets for hashed keys: some for each shuffle partition, so a bucket is a part of a task."""
    return factor * int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- words inside tasks


class Docs(NamedTuple):
    """Some documents of one batch: ids, and their UTF-8 bytes end to end."""

    ids: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """The words of some documents: bytes from ``start`` of ``length``; ``first[d]`` is the index of
    document d's first word, with one more entry at the end."""

    start: np.ndarray
    length: np.ndarray
    first: np.ndarray

    def docs(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[Docs]:
    """Documents of (doc_id, text) batches, about ``limit`` bytes at a time; a longer one comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
        texts = batch.column(1).cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(ids):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            end = min(end, len(ids))
            yield Docs(ids[at:end], data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
            at = end


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def split_words(docs: Docs, separators: np.ndarray = SPACES) -> Words:
    """Maximal runs of bytes that are no separators; no word crosses two documents."""
    n = len(docs.data)
    bounds = docs.offsets
    if not n:
        return Words(np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(bounds), np.int64))
    inside = ~separators[docs.data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = np.unique(bounds[(bounds > 0) & (bounds < n)])
    begins[cuts] |= inside[cuts]
    ends[cuts - 1] |= inside[cuts - 1]
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(ends) + 1 - start, np.searchsorted(start, bounds, "left"))


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time for all words at once."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    h = mixed(words.length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    todo, at = np.arange(len(words.start)), 0
    while len(todo):
        left = np.minimum(words.length[todo] - at, 8)
        h[todo] = mixed(h[todo] ^ (lanes[words.start[todo] + at] & MASKS[left]))
        at += 8
        todo = todo[words.length[todo] > at]
    return h


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive word hashes (across documents too: the caller masks)."""
    if len(h) < width:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
    return mixed(out)


def group_sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each value for them."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return (keys[at], *(np.add.reduceat(v[order], at) if len(keys) else v for v in values))


def ids_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def column_bytes(column: pa.ChunkedArray | pa.Array, dtype) -> list[np.ndarray]:
    """The arrays that ``blob`` wrote, one for each row."""
    return [np.frombuffer(v.as_buffer(), dtype) for v in column]
