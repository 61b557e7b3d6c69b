"""Embedding near duplicates: pairs of vectors by collision-counting projections.

Vectors of one label are projected on many random lines. Five of them, cut into intervals, make a block;
sixteen such tables make it all but certain that close vectors share a block. Inside a block vectors are
sorted along one line, each asks for those in a window around itself, and on the other lines it is
counted how often a pair lies within a window of each other. Pairs counted often enough for the wanted
recall are compared in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from facetwise.llm import graph
from facetwise.llm.common import mixed, stored

MIN_COSINE = 0.93
TABLES, LINES_PER_TABLE = 16, 5
COUNTED = 24
RECALL = 0.9999
#: Interval, window of the counted lines, and window of the sorted line, in distances at the threshold.
INTERVAL, WINDOW, SORTED_WINDOW = 4.0, 1.5, 4.2
#: Rows of a block; a larger one is cut, and each two of its parts meet in a block of their own.
BLOCK = 2048
PAIRS_AT_ONCE = 1 << 18


def needed_count(lines: int, within: float, recall: float) -> int:
    """The largest count that a pair at the threshold reaches with this probability."""
    p = math.erf(within / math.sqrt(2))
    below = 0.0
    for k in range(lines + 1):
        below += math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if below > 1 - recall:
            return k
    return lines


class Lines(NamedTuple):
    """Directions and offsets, the same in every task, and the distance at the threshold."""

    table: np.ndarray
    offset: np.ndarray
    counted: np.ndarray
    distance: float
    least: int


def lines(dim: int, min_cosine: float, recall: float = RECALL) -> Lines:
    rng = np.random.default_rng([dim, 93])
    distance = math.sqrt(max(2 - 2 * min_cosine, 1e-12))
    return Lines(
        rng.standard_normal((dim, TABLES * LINES_PER_TABLE)),
        rng.random(TABLES * LINES_PER_TABLE),
        rng.standard_normal((dim, COUNTED)),
        distance,
        needed_count(COUNTED, WINDOW, recall),
    )


def blocks_of(unit: np.ndarray, label: np.ndarray, of: Lines) -> np.ndarray:
    """The block of each vector in each table, as hashes (rows, tables)."""
    cells = np.floor(unit @ of.table / (INTERVAL * of.distance) + of.offset).astype(np.int64)
    h = mixed(label.view(np.uint64) + np.uint64(unit.shape[1]))[:, None] + mixed(np.arange(1, TABLES + 1).astype(np.uint64))
    cells = cells.reshape(len(unit), TABLES, LINES_PER_TABLE).view(np.uint64)
    for k in range(LINES_PER_TABLE):
        h = mixed(h ^ cells[:, :, k])
    return h


def _units(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow on the way to the norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, class columns), and one row per different usable vector: smallest id and copies."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"), F.col(f"`{label_col}`").cast("long").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
        & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    )
    rows = rows.withColumn("usable", usable).withColumns(
        {"h1": F.when(F.col("usable"), F.xxhash64("v")), "h2": F.when(F.col("usable"), F.xxhash64(F.lit(2), "v"))}
    )
    one = rows.where("usable").groupBy("label", "h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")
    )
    return rows.select("vec_id", "label", "h1", "h2"), one


def links(one: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(a, b, copies_a, copies_b) for representatives a < b with cosine of ``min_cosine`` or more, once each."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.diff(batch.column("v").cast(pa.large_list(pa.float64())).offsets.to_numpy())
            for dim in np.unique(dims).tolist():
                some = batch.filter(pa.array(dims == dim))
                raw = some.column("v").flatten().to_numpy().reshape(-1, dim)
                h = blocks_of(_units([r.tobytes() for r in raw]), some.column("label").to_numpy(), lines(dim, min_cosine))
                short = [x.astype(np.uint32).tobytes() for x in h]
                blobs = pa.array([r.tobytes() for r in raw], pa.binary())
                for t in range(TABLES):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[:, t].view(np.int64)), pa.array(np.full(len(h), t, np.int32)), some.column("rep"), some.column("copies"), blobs, pa.array(short, pa.binary())],
                        ["block", "t", "rep", "copies", "v", "blocks"],
                    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            keys = batch.column("block").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            rest = batch.slice(cut)
            yield from _pairs(batch.slice(0, cut), min_cosine)
        if rest is not None:
            yield from _pairs(rest, min_cosine)

    kinds = "block long, t int, rep long, copies long, v binary, blocks binary"
    rows = one.select("rep", "copies", "label", "v").mapInArrow(spread, kinds).withColumn("part", F.lit(-1))
    large = stored(rows.groupBy("block").count().where(F.col("count") > BLOCK), "large-blocks")
    if not large.isEmpty():
        # Rows of a large block fall into parts by hash, and part i meets part j in a block of its own.
        parts = F.ceil(F.col("count") / (BLOCK // 2)).cast("int")
        own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
        joined = rows.drop("part").join(large.withColumn("parts", parts), "block", "left")
        small = joined.where("parts IS NULL").withColumn("part", F.lit(-1)).drop("count", "parts")
        cut = joined.where("parts IS NOT NULL").withColumn("part", own)
        cut = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        cut = cut.withColumn("block", F.xxhash64("block", F.least("part", "with"), F.greatest("part", "with")))
        # A pair within one part meets in its block with itself only.
        cut = cut.withColumn("part", F.when(F.col("part") == F.col("with"), F.lit(-1)).otherwise(F.col("part")))
        rows = small.unionByName(cut.drop("count", "parts", "with"))
    met = rows.repartition("block").sortWithinPartitions("block")
    return met.mapInArrow(compare, "a long, b long, copies_a long, copies_b long")


def _pairs(batch: pa.RecordBatch, min_cosine: float) -> Iterator[pa.RecordBatch]:
    """Links among the rows of whole blocks."""
    if not batch.num_rows:
        return
    keys = batch.column("block").to_numpy()
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    group = np.cumsum(new) - 1
    shared = np.flatnonzero(np.bincount(group)[group] > 1)
    if not len(shared):
        return
    batch, group = batch.take(pa.array(shared)), group[shared]
    raw = [v.as_py() for v in batch.column("v")]
    for size in {len(r) for r in raw}:
        of = lines(size // 8, min_cosine)
        own = np.array([i for i, r in enumerate(raw) if len(r) == size])
        yield from _dense_pairs(batch.take(pa.array(own)), group[own], _units([raw[i] for i in own]), of, min_cosine)


def _dense_pairs(batch, group, unit, of: Lines, min_cosine: float) -> Iterator[pa.RecordBatch]:
    along = unit @ of.counted
    order = np.lexsort((along[:, 0], group))
    batch, group, unit, along = batch.take(pa.array(order)), group[order], unit[order], along[order]
    rep, copies, part, t = (batch.column(c).to_numpy() for c in ("rep", "copies", "part", "t"))
    mine = np.array([np.frombuffer(b.as_buffer(), np.uint32) for b in batch.column("blocks")])
    # Sorted by block and line: whom each asks for are those up to the window's end after it.
    scale = 1 + 2 * np.abs(along[:, 0]).max() + SORTED_WINDOW * of.distance
    key = group * scale + along[:, 0]
    stop = np.searchsorted(key, key + SORTED_WINDOW * of.distance, "right")
    n = stop - np.arange(len(stop)) - 1
    total, at = np.concatenate([[0], np.cumsum(n)]), 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS_AT_ONCE, "right")) - 1)
        i = np.repeat(np.arange(at, end), n[at:end])
        j = i + 1 + np.arange(len(i)) - (total[i] - total[at])
        at = end
        count = np.zeros(len(i), np.uint8)
        for k in range(COUNTED):
            count += np.abs(along[i, k] - along[j, k]) <= WINDOW * of.distance
        ok = (count >= of.least) & ((part[i] < 0) | (part[i] != part[j]))
        i, j = i[ok], j[ok]
        ok = np.einsum("ij,ij->i", unit[i], unit[j]) >= min_cosine
        i, j = i[ok], j[ok]
        # A pair is reported by the first table whose block it shares.
        ok = (mine[i] == mine[j]).argmax(axis=1) == t[i]
        i, j = i[ok], j[ok]
        swap = rep[i] > rep[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rep[i], rep[j], copies[i], copies[j])], ["a", "b", "copies_a", "copies_b"])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 min_cosine: float = MIN_COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id
    that links reach, its own included), kept (it is that one).

    Vectors are linked if labels are equal and not null and their cosine is ``min_cosine`` or more. Equal
    vectors of a label are one class and never compared; each counts as a link of the others. Null, empty
    or zero vectors, and those with null or non-finite components, link with nothing, nor do rows without
    id or label; vectors of different length never link. Rows that repeat an id are vectors of their own.
    Other columns are ignored; no rows give no rows.
    """
    rows, one = classes(vectors, id_col, vector_col, label_col)
    one = stored(one, "vector-classes")
    found = stored(links(one, min_cosine), "vector-links")
    ends = found.select(F.col("a").alias("rep"), F.col("copies_b").alias("n")).union(found.select("b", "copies_a"))
    counts = ends.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = graph.components(found.select("a", "b")).withColumnRenamed("node", "rep")
    of_class = (
        one.select("label", "h1", "h2", "rep", "copies").join(counts, "rep", "left").join(parts, "rep", "left")
        .select("label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component_id", "rep").alias("component_id"))
    )
    joined = rows.join(of_class, ["label", "h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        F.expr("vec_id <=> coalesce(component_id, vec_id)").alias("kept"),
    )
