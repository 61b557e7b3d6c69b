"""Column descriptions, embeddings, cosine search and related datasets.

A registry has one row per described column: dataset_id, column_name,
description, embedding (array of float).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, NGram, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window as W, functions as F

from facetwise import kernels
from facetwise.functions.values import dtype, is_number, per_column, present
from facetwise.operators.schema import first_values

DIMENSIONS = 384
# Query vectors sent to every task: at most this many rows (12 MB at 384 dimensions).
MAX_BROADCAST_QUERIES = 4096
# Vectors of a block: a task holds one block of each side (50 MB of items at 384 dimensions) and few scores.
QUERY_BLOCK = 4096
ITEM_BLOCK = 16384
MATCH_SCHEMA = "query_id string, item_id string, item_group string, score double"
RELATED_SCORE = 0.85


def column_descriptions(df: DataFrame, dataset: str, order_by: Sequence[str]) -> DataFrame:
    """-> dataset_id, column_name, dtype, description."""
    names = df.columns

    def measures(name):
        ranged = is_number(dtype(df, name), booleans=True)
        value = present(df, name) if ranged else F.lit(None)
        return {
            "dtype": F.lit(dtype(df, name).simpleString()),
            "lo": F.min(value).cast("string"),
            "hi": F.max(value).cast("string"),
        }

    samples = first_values(df, names, order_by, 3, True)
    listed = F.array_join(F.coalesce("samples", F.array().cast("array<string>")), ", ")
    base = F.format_string("%s (%s): sample values: %s", "column_name", "dtype", listed)
    with_range = F.concat(base, F.lit("; range "), F.col("lo"), F.lit("–"), F.col("hi"))
    return (
        per_column(df, names, measures)
        .join(F.broadcast(samples), "column_name", "left")
        .select(F.lit(dataset).alias("dataset_id"), "column_name", "dtype", F.coalesce(with_range, base).alias("description"))
    )


def hashed_ngrams(df: DataFrame, text: str, output: str, n: int = 3) -> DataFrame:
    """The default embedder: hashed character n-grams, unit length, 384 dimensions, JVM only."""
    lowered = F.concat(F.lit(" "), F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(" "))
    chars = df.withColumn("_chars", F.split(lowered, ""))
    grams = NGram(n=n, inputCol="_chars", outputCol="_grams").transform(chars)
    counts = HashingTF(numFeatures=DIMENSIONS, inputCol="_grams", outputCol="_counts").transform(grams)
    unit = Normalizer(p=2.0, inputCol="_counts", outputCol="_unit").transform(counts)
    return unit.withColumn(output, vector_to_array("_unit", "float32")).drop("_chars", "_grams", "_counts", "_unit")


def embed(df: DataFrame, text: str, embedder=hashed_ngrams, output: str = "embedding") -> DataFrame:
    """Adds an embedding of a text column. ``embedder(df, text, output)`` may be any model."""
    return embedder(df, text, output)


def _items(registry: DataFrame, item_id: str, group: str) -> DataFrame:
    return registry.where("embedding is not null").select(
        F.col(item_id).cast("string").alias("item_id"), F.col(group).cast("string").alias("item_group"), "embedding"
    )


def best_matches(queries: DataFrame, items: DataFrame, k: int, relation: str = "any", limit: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """The ``k`` items most similar to each query -> query_id, item_id, item_group, score, rank.

    ``queries``: query_id, query_group, embedding; ``items``: item_id, item_group,
    embedding. ``relation`` is "any", "same" or "other" group. Every task keeps ``k`` rows per
    query and batch, never all pairs. With relation "same" queries only meet items of their own group,
    block by block. Else few queries (counted first) travel to the items, which are then not shuffled;
    more are matched block by block.
    """
    queries = queries.where("embedding is not null").select(
        F.col("query_id").cast("string"), F.col("query_group").cast("string"), "embedding"
    )
    head = [] if relation == "same" else queries.limit(limit + 1).collect()
    if relation != "same" and not head:
        return items.sparkSession.createDataFrame([], MATCH_SCHEMA + ", rank int")
    if relation != "same" and len(head) <= limit:
        matrix = np.array([r["embedding"] for r in head], dtype=np.float64)
        run = kernels.batch_matcher([r["query_id"] for r in head], [r["query_group"] for r in head], matrix, k, relation)
        found = items.mapInArrow(run, MATCH_SCHEMA)
    else:
        found = _blocked(queries, items, k, relation)
    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def _blocked(queries: DataFrame, items: DataFrame, k: int, relation: str) -> DataFrame:
    """Block against block: memory per task is bounded by the block sizes, however large a group
    is. With relation "same" only blocks of one group meet."""
    part = (lambda group: F.coalesce(F.col(group), F.lit(""))) if relation == "same" else (lambda group: F.lit(""))
    return by_blocks(queries.withColumn("_g", part("query_group")), items.withColumn("_g", part("item_group")), k, relation)


def by_blocks(queries: DataFrame, items: DataFrame, k: int, relation: str) -> DataFrame:
    """Queries meet the items of the same ``_g``, block against block -> the ``k`` best of every block."""

    def blocks(frame, size, alias):
        return frame.groupBy("_g").agg(F.ceil(F.count(F.lit(1)) / size).cast("bigint").alias(alias))

    sizes = blocks(queries, QUERY_BLOCK, "_nq").join(blocks(items, ITEM_BLOCK, "_ni"), "_g")
    zero = F.lit(0).cast("bigint")

    def dealt(frame, ident, own, count, other, others):
        """Every row goes to one block of its own side and meets all blocks of the other."""
        # Both sides may come from one table: fresh column identities keep them apart.
        fresh = frame.select(*[F.col(c).alias(c) for c in frame.columns])
        return (
            fresh.join(sizes, "_g")
            .withColumn(own, F.pmod(F.xxhash64(ident), F.col(count)))
            .withColumn(other, F.explode(F.sequence(zero, F.col(others) - 1)))
            .drop("_nq", "_ni")
        )

    left = dealt(queries, "query_id", "_q", "_nq", "_i", "_ni")
    right = dealt(items, "item_id", "_i", "_ni", "_q", "_nq")
    pairs = left.groupBy("_g", "_q", "_i").cogroup(right.groupBy("_g", "_q", "_i"))
    return pairs.applyInArrow(kernels.block_matcher(k, relation), MATCH_SCHEMA)


def query_vectors(spark, vectors: Sequence[Sequence[float]], group: str | None = None) -> DataFrame:
    rows = [(str(i), group, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "query_id string, query_group string, embedding array<double>")


def nearest(registry: DataFrame, vector: Sequence[float], k: int = 10, item_id: str = "column_name", group: str = "dataset_id") -> DataFrame:
    """The ``k`` registry rows most similar to a vector -> item_id, item_group, score, rank."""
    one = query_vectors(registry.sparkSession, [vector])
    return best_matches(one, _items(registry, item_id, group), k).drop("query_id")


def search_columns(registry: DataFrame, datasets: DataFrame, text: str, k: int = 10, embedder=hashed_ngrams) -> DataFrame:
    """Text search over described columns -> dataset_id, dataset_name, column_name, score, rank."""
    if not text.strip():
        raise ValueError("empty search text")
    if k < 1:
        raise ValueError("at least one column")
    spark = registry.sparkSession
    vector = embed(spark.createDataFrame([(text,)], "text string"), "text", embedder).head()["embedding"]
    # Column names repeat between datasets: the item is the pair.
    items = registry.withColumn("_item", F.to_json(F.struct("dataset_id", "column_name")))
    # Only datasets that exist count, and before the cut.
    items = items.join(datasets.select("dataset_id"), "dataset_id", "left_semi")
    found = nearest(items, vector, k, "_item")
    found = found.withColumn("column_name", F.get_json_object("item_id", "$.column_name"))
    # At most k rows meet the catalog.
    return (
        F.broadcast(found)
        .join(datasets.select(F.col("dataset_id"), F.col("name").alias("dataset_name")), found["item_group"] == F.col("dataset_id"))
        .select("dataset_id", "dataset_name", "column_name", "score", "rank")
    )


def knn_join(local: DataFrame, registry: DataFrame, k: int = 5, min_score: float = RELATED_SCORE, item_id: str = "column_name", group: str = "dataset_id") -> DataFrame:
    """Each local row's ``k`` nearest rows of other groups, then the cut -> local_id, item_id,
    item_group, score, rank."""
    queries = local.select(F.col(item_id).alias("query_id"), F.col(group).alias("query_group"), "embedding")
    found = best_matches(queries, _items(registry, item_id, group), k, "other")
    return found.where(F.col("score") >= min_score).withColumnRenamed("query_id", "local_id")


def related(matches: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Matches per dataset, most similar first -> dataset_id, similarity, matches, columns(, name).

    At most ``k`` matches per local column exist, so the collected lists are bounded.
    """
    grouped = matches.groupBy(F.col("item_group").alias("dataset_id")).agg(
        F.avg("score").alias("similarity"),
        F.count(F.lit(1)).alias("matches"),
        F.array_sort(
            F.collect_list(F.struct((-F.col("score")).alias("neg"), F.col("local_id").alias("local"), F.col("item_id").alias("remote")))
        ).alias("columns"),
    )
    if names is not None:
        grouped = grouped.join(names.select("dataset_id", "name"), "dataset_id")
    return grouped.orderBy(F.desc("similarity"), F.desc("matches"), "dataset_id")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """All rows of both, the new one where keys agree. Of several new ones the largest by ``order_by``
    stays, then the one largest as JSON, so the result doesn't depend on the layout."""
    both = old.withColumn("_version", F.lit(0)).unionByName(new.withColumn("_version", F.lit(1)))
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in old.columns]))
    latest = W.partitionBy(*keys).orderBy(F.desc("_version"), *[F.desc(c) for c in order_by], whole.desc())
    return both.withColumn("_rank", F.row_number().over(latest)).where("_rank = 1").drop("_rank", "_version")


def build_index(registry: DataFrame, cells: int = 100, seed: int = 42):
    """Cosine cells over a registry -> (registry with cell, centres). Write the first with
    ``partitionBy("cell")`` and a search reads only the cells it probes."""
    points = registry.where("embedding is not null").withColumn("_v", array_to_vector(F.col("embedding").cast("array<double>")))
    # A zero vector has no direction.
    points = points.where(F.exists("embedding", lambda x: x != 0))
    model = KMeans(k=cells, seed=seed, distanceMeasure="cosine", featuresCol="_v", predictionCol="cell").fit(points.select("_v"))
    return model.transform(points).drop("_v"), np.array(model.clusterCenters())


def probe(index: DataFrame, centres: np.ndarray, vector: Sequence[float], k: int = 10, cells: int = 10, item_id: str = "column_name", group: str = "dataset_id") -> DataFrame:
    """Approximate ``nearest``: only the ``cells`` nearest cells are read."""
    scores = kernels.unit_rows(centres) @ np.asarray(vector, dtype=float)
    wanted = [int(i) for i in np.argsort(-np.nan_to_num(scores, nan=-np.inf))[:cells]]
    return nearest(index.where(F.col("cell").isin(wanted)), vector, k, item_id, group)
