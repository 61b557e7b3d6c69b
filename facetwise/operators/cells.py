"""A stored index of vectors: rows laid out by cell, searches that read few cells, and exact joins that
skip the cells out of reach.

Under the path of an index: ``centres`` (cell, centre), written once; ``rows/batch=../cell=..``, the
registry rows of each batch; ``reach/batch=..`` (cell, radius, n), which is written last and so tells that
a batch is whole. Rows have item_id, item_group and embedding; a batch written again replaces itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from facetwise import kernels
from facetwise.operators.vectors import MATCH_SCHEMA, _items, build_index, by_blocks, query_vectors
from facetwise.session import write_through

FIRST_BATCH = "first"
VISIT_SCHEMA = "query_id string, query_group string, embedding array<double>, _g int"


class Cells(NamedTuple):
    """What a search knows of an index: at most one row per cell. An empty cell has a radius of -1."""

    centres: np.ndarray
    radii: np.ndarray
    counts: np.ndarray
    batches: list[str]


class Joined(NamedTuple):
    """``found``: query_id, item_id, item_group, score, rank; ``visits``: query_id, cell, n (pairs scored)."""

    found: DataFrame
    visits: DataFrame


def write_index(registry: DataFrame, path: str, cells: int = 100, seed: int = 42, item_id: str = "column_name", group: str = "dataset_id") -> None:
    """Centres learnt from all vectors, then every row stored by cell. Rows without a direction go to cell -1, which no
    search reads."""
    _, centres = build_index(registry, cells, seed)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    registry.sparkSession.createDataFrame(rows, "cell int, centre array<double>").write.parquet(f"{path}/centres")
    add_to_index(registry, path, FIRST_BATCH, item_id, group)


def add_to_index(registry: DataFrame, path: str, batch: str, item_id: str = "column_name", group: str = "dataset_id") -> None:
    """New rows go to the cells whose centres they are nearest to; stored rows are not read."""
    spark = registry.sparkSession
    rows = _items(registry, item_id, group).withColumn("embedding", F.col("embedding").cast("array<double>"))
    kinds = "item_id string, item_group string, embedding array<double>, cell int, angle double"
    placed = rows.mapInArrow(kernels.cell_finder(_centres(spark, path)), kinds)
    placed.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows/batch={batch}")
    # The folder of an empty batch holds no file that a schema could be read from.
    stored = spark.read.schema(kinds).parquet(f"{path}/rows/batch={batch}")
    reach = stored.where("cell >= 0").groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n"))
    reach.write.mode("overwrite").parquet(f"{path}/reach/batch={batch}")


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # one row per cell
    return np.array([r["centre"] for r in rows], dtype=np.float64)


def read_cells(spark: SparkSession, path: str) -> Cells:
    centres = _centres(spark, path)
    radii, counts = np.full(len(centres), -1.0), np.zeros(len(centres), np.int64)
    reach = spark.read.schema("cell int, radius double, n bigint, batch string").parquet(f"{path}/reach")
    whole = [r["batch"] for r in reach.select("batch").distinct().collect()]
    for r in reach.groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).collect():
        radii[r["cell"]], counts[r["cell"]] = r["radius"], r["n"]
    return Cells(centres, radii, counts, whole)


def index_rows(spark: SparkSession, path: str, known: Cells, cells: Sequence[int] | None = None) -> DataFrame:
    """Rows of whole batches -> item_id, item_group, embedding, cell; of some cells only their folders are read."""
    kinds = "item_id string, item_group string, embedding array<double>, batch string, cell int"
    rows = spark.read.schema(kinds).parquet(f"{path}/rows").where(F.col("batch").isin(known.batches) & (F.col("cell") >= 0))
    if cells is not None:
        rows = rows.where(F.col("cell").isin([int(c) for c in cells]))
    return rows.select("item_id", "item_group", "embedding", "cell")


def _best(found: DataFrame, k: int) -> DataFrame:
    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def _plain(queries: DataFrame) -> DataFrame:
    return queries.where("embedding is not null").select(
        F.col("query_id").cast("string"), F.col("query_group").cast("string"), F.col("embedding").cast("array<double>")
    )


def search_index(spark: SparkSession, path: str, vector: Sequence[float], k: int = 10, probes: int = 10) -> DataFrame:
    """The ``k`` best rows of the ``probes`` cells nearest to one vector -> item_id, item_group, score, rank."""
    known = read_cells(spark, path)
    angles = kernels.angles(np.array([vector], dtype=np.float64), known.centres)[0]
    nearest = [int(c) for c in np.argsort(angles, kind="stable") if known.radii[c] >= 0][:probes]
    items = index_rows(spark, path, known, nearest).drop("cell")
    one = query_vectors(spark, [vector]).head()
    run = kernels.batch_matcher([one["query_id"]], [None], np.array([vector], dtype=np.float64), k, "any")
    return _best(items.mapInArrow(run, MATCH_SCHEMA), k).drop("query_id")


def probe_index(queries: DataFrame, path: str, k: int = 10, probes: int = 10, relation: str = "any") -> DataFrame:
    """Approximate: each query meets the rows of its ``probes`` nearest cells -> query_id, item_id, item_group, score,
    rank. Query ids are unique."""
    spark = queries.sparkSession
    known = read_cells(spark, path)
    visits = _plain(queries).mapInArrow(kernels.cell_visitor(known.centres, known.radii, probes, False), VISIT_SCHEMA)
    return _best(by_blocks(visits, index_rows(spark, path, known).withColumnRenamed("cell", "_g"), k, relation), k)


def join_index(queries: DataFrame, path: str, k: int = 5, relation: str = "any", min_score: float | None = None, first: int = 1) -> Joined:
    """The exact ``k`` best rows of the index for each query, of at least ``min_score``.

    Two rounds: a query meets its ``first`` nearest cells, which shows what its k-th best is at least; then
    only those further cells that may hold something as good. Query ids are unique. Queries without a
    direction find nothing.
    """
    spark = queries.sparkSession
    known = read_cells(spark, path)
    rows = _plain(queries)
    items = index_rows(spark, path, known).withColumnRenamed("cell", "_g")
    near = rows.mapInArrow(kernels.cell_visitor(known.centres, known.radii, first, False), VISIT_SCHEMA)
    # Both rounds' results are needed more than once, and the second round's cells follow from the first.
    head = write_through(_best(by_blocks(near, items, k, relation), k), "cells-first").select(*[c.split()[0] for c in MATCH_SCHEMA.split(", ")])
    last = head.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("_worst"))
    bound = F.greatest("_worst", F.lit(min_score).cast("double"))
    bounded = rows.join(last, "query_id", "left").select(*rows.columns, bound.alias("bound"))
    far = write_through(bounded.mapInArrow(kernels.cell_visitor(known.centres, known.radii, first, True), VISIT_SCHEMA), "cells-visits")
    found = _best(head.unionByName(by_blocks(far, items, k, relation)), k)
    if min_score is not None:
        found = found.where(F.col("score") >= min_score)
    sizes = spark.createDataFrame([(i, int(n)) for i, n in enumerate(known.counts)], "cell int, n bigint")
    visits = near.unionByName(far).select("query_id", F.col("_g").alias("cell")).join(F.broadcast(sizes), "cell")
    return Joined(found, visits.select("query_id", "cell", "n"))


def probes_for(queries: DataFrame, path: str, k: int = 10, recall: float = 0.95, relation: str = "any") -> int:
    """How many cells ``probe_index`` must read to find ``recall`` of the exact ``k`` best of some sample queries.

    The exact matches tell: each lies in one cell, at some place in the order of its query's cells. The caller bounds
    the sample; at least one, at most all cells.
    """
    spark = queries.sparkSession
    known = read_cells(spark, path)
    found = join_index(queries, path, k, relation).found.select("query_id", "item_id")
    homes = index_rows(spark, path, known).select("item_id", "cell")
    placed = found.join(homes, "item_id").join(_plain(queries), "query_id").select("embedding", "cell")
    counted = placed.mapInArrow(kernels.cell_places(known.centres, known.radii), "place int").groupBy("place").count().collect()
    at = np.zeros(len(known.centres) + 1, np.int64)
    for r in counted:
        at[r["place"]] = r["count"]
    return max(1, int(np.searchsorted(np.cumsum(at), recall * at.sum())))
