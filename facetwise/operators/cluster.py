"""Row clusters: choice of k, assignment, profiles and labels."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from facetwise import kernels
from facetwise.functions.values import col, number, number_columns, per_column
from facetwise.operators.prep import impute_median, moments, z_score
from facetwise.operators.schema import sample_rows
from facetwise.session import write_through

MIN_ROWS = 50
MIN_COLUMNS = 3
DEFAULT_K = 4
SMALL_DROP = 0.2
#: A fit ends after so many steps, or when no centre moves further than this.
STEPS = 20
TOLERANCE = 1e-4


def gate(df: DataFrame) -> str | None:
    """Why the table cannot be clustered, or None."""
    if df.limit(MIN_ROWS).count() < MIN_ROWS:
        return "Fewer than 50 rows"
    if len(number_columns(df)) < MIN_COLUMNS:
        return "Fewer than 3 numeric columns"
    return None


class Model(NamedTuple):
    """Centres as rows, in scaled columns, and the cost of the points in the last step that moved them."""

    centres: np.ndarray
    cost: float


def _scaled(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """The features of an imputed table: one column per name, scaled."""
    learnt = moments(df, names)
    return [z_score(df, n, *learnt[n]).alias(f"_s{i}") for i, n in enumerate(names)]


def _starts(points: DataFrame, ks: Sequence[int] | None, k_max: int, seed: int) -> dict[int, np.ndarray]:
    """The centres from which the fit of each k begins (k-means||), from all points."""
    vectors = VectorAssembler(inputCols=points.columns, outputCol="_scaled").transform(points).select("_scaled")
    vectors.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if ks is None:
            ks = range(2, min(k_max, vectors.count() - 1) + 1)
        # One after another: side by side each would hold the distances of all points.
        draw = KMeans(seed=seed, featuresCol="_scaled", solver="row", maxIter=0)
        return {k: np.array(draw.copy({draw.k: k}).fit(vectors).clusterCenters()) for k in ks}
    finally:
        vectors.unpersist(True)


def _moved(blocks: DataFrame, models: dict[int, Model]) -> dict[int, Model]:
    """Every centre in the middle of the points nearest to it, all models in one pass; one without points stays."""
    step = blocks.mapInArrow(kernels.centre_sums([m.centres for m in models.values()]), "model int, centre int, part int, total double")
    # One row per model, centre and column.
    rows = step.groupBy("model", "centre", "part").agg(F.sum("total").alias("total")).collect()
    out = {}
    for at, (k, (centres, _)) in enumerate(models.items()):
        totals = np.zeros((centres.shape[1] + 2, len(centres)))
        for r in rows:
            if r["model"] == at:
                totals[r["part"], r["centre"]] = r["total"]
        *sums, n, cost = totals
        out[k] = Model(np.where(n[:, None] > 0, np.array(sums).T / np.maximum(n, 1)[:, None], centres), float(cost.sum()))
    return out


def choose_k(costs: DataFrame, k: int = DEFAULT_K, drop: float = SMALL_DROP) -> DataFrame:
    """From (k, inertia): marks the first k that improves on k - 1 by less than ``drop``; if none
    does, ``k`` when it was tried, else the largest -> k, inertia, drop_share, chosen.

    There is one row per tried k.
    """
    by_k = W.partitionBy(F.lit(0)).orderBy("k")
    before = F.lag("inertia").over(by_k)
    with_drop = costs.withColumn("drop_share", F.when(before > 0, (before - F.col("inertia")) / before))
    everything = W.partitionBy(F.lit(0))
    first_small = F.min(F.when(F.col("drop_share") < drop, F.col("k"))).over(everything)
    asked = F.max(F.when(F.col("k") == k, F.col("k"))).over(everything)
    largest = F.max("k").over(everything)
    return with_drop.withColumn("chosen", F.col("k") == F.coalesce(first_small, asked, largest))


def _models(df: DataFrame, features: Sequence[Column], ks: Sequence[int] | None, k_max: int, seed: int, fit_rows: int | None, key: Sequence[str]) -> dict[int, Model]:
    """Fitted models per k (2..k_max when not given), all on the same points: steps of all models in one pass each,
    until no centre of a model moves by more than ``TOLERANCE`` or ``STEPS`` are done."""
    points = (sample_rows(df, key, fit_rows, seed) if fit_rows else df).select(*features)
    models = {k: Model(centres, 0.0) for k, centres in _starts(points, ks, k_max, seed).items()}
    blocks = points.mapInArrow(kernels.point_packer, "points binary").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        moving = models
        for _ in range(STEPS):
            if not moving:
                break
            moved = _moved(blocks, moving)
            far = {k: np.square(m.centres - moving[k].centres).sum(axis=1).max() > TOLERANCE**2 for k, m in moved.items()}
            models = models | moved
            moving = {k: m for k, m in moved.items() if far[k]}
        return models
    finally:
        blocks.unpersist()


def _costs(spark, models: dict[int, Model]) -> DataFrame:
    return spark.createDataFrame([(k, m.cost) for k, m in models.items()], "k int, inertia double")


def _nearest(features: Sequence[Column], centres: np.ndarray) -> Column:
    """The place of the nearest centre, the first one of equals."""

    @F.pandas_udf("int")
    def near(points: pd.DataFrame) -> pd.Series:
        columns = [points[c].to_numpy(dtype=np.float64) for c in points]
        return pd.Series(kernels.centre_distances(columns, centres).argmin(axis=0))

    return near(F.struct(*features))


def elbow(df: DataFrame, k_max: int = 6, drop: float = SMALL_DROP, seed: int = 42, columns: Sequence[str] | None = None, fit_rows: int | None = None, key: Sequence[str] = (), k: int = DEFAULT_K) -> DataFrame:
    """Cost of k = 2..k_max and the choice -> k, inertia, drop_share, chosen.

    Fits on all rows; ``fit_rows`` (with a ``key``) fits on a seeded sample of that size instead.
    """
    names = list(columns) if columns is not None else number_columns(df)
    table = impute_median(df, names)
    models = _models(table, _scaled(table, names), None, k_max, seed, fit_rows, key)
    return choose_k(_costs(df.sparkSession, models), k, drop)


def cluster(df: DataFrame, k: int | None = None, seed: int = 42, columns: Sequence[str] | None = None, fit_rows: int | None = None, key: Sequence[str] = (), k_max: int = 6) -> DataFrame:
    """The imputed table with a ``cluster`` for every row. ``k`` is found as by ``elbow`` when not
    given, and the model already fitted for it is used."""
    names = list(columns) if columns is not None else number_columns(df)
    table = impute_median(df, names)
    features = _scaled(table, names)
    models = _models(table, features, None if k is None else [k], k_max, seed, fit_rows, key)
    if k is None:
        k = choose_k(_costs(df.sparkSession, models)).where("chosen").head()["k"]
    return table.withColumn("cluster", _nearest(features, models[k].centres))


def cluster_sizes(clustered: DataFrame) -> DataFrame:
    """-> cluster, n."""
    return clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def cluster_profile(clustered: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean of every column per cluster -> cluster, column_name, position, mean."""
    return per_column(clustered, names, lambda n: {"mean": F.avg(number(clustered, n))}, keys=["cluster"])


def deviations(clustered: DataFrame, names: Sequence[str]) -> DataFrame:
    """Means against the overall mean, relative to its size -> cluster, column_name, position, mean, deviation.

    One grouped pass: overall means come from the cluster sums (one row per cluster and column).
    """
    return _sized_deviations(clustered, names).drop("n")


def _sized_deviations(clustered: DataFrame, names: Sequence[str]) -> DataFrame:
    """``deviations`` with the rows of each cluster as ``n``."""
    sums = per_column(
        clustered,
        names,
        lambda n: {"_sum": F.sum(number(clustered, n)), "_n": F.count(number(clustered, n)), "_rows": F.count(F.lit(1))},
        keys=["cluster"],
    )
    over_clusters = W.partitionBy("column_name")
    overall = F.sum("_sum").over(over_clusters) / F.sum("_n").over(over_clusters)
    mean = F.col("_sum") / F.col("_n")
    return sums.select(
        "cluster",
        "column_name",
        "position",
        mean.alias("mean"),
        ((mean - overall) / F.greatest(F.abs(overall), F.lit(1e-9))).alias("deviation"),
        F.col("_rows").alias("n"),
    )


def _human(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, "[_-]", " ")))


def cluster_labels(deviation: DataFrame) -> DataFrame:
    """-> cluster, label: the columns furthest above and below; ties go to the first column."""
    high = F.min(F.struct((-F.col("deviation")).alias("d"), "position", "column_name"))
    low = F.min(F.struct(F.col("deviation").alias("d"), "position", "column_name"))
    found = deviation.groupBy("cluster").agg(high.alias("_h"), low.alias("_l"))
    up, down = F.col("_h.column_name"), F.col("_l.column_name")
    label = F.when(up == down, F.concat(F.lit("Distinct "), _human(up))).otherwise(
        F.concat(F.lit("High "), _human(up), F.lit(", low "), _human(down))
    )
    return found.select("cluster", label.alias("label"))


def cluster_report(clustered: DataFrame, names: Sequence[str], examples: int = 3) -> DataFrame:
    """-> cluster, n, label, example (means of the first columns, for the largest cluster)."""
    # One pass over the rows; sizes, labels and means are read from its few rows.
    deviation = write_through(_sized_deviations(clustered, names), "deviations")
    sizes = deviation.groupBy("cluster").agg(F.max("n").alias("n"))
    first = names[:examples]
    means = deviation.where(F.col("column_name").isin(list(first))).groupBy("cluster").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("position", "column_name", "mean"))),
                lambda s: F.concat(s["column_name"], F.lit("="), F.format_number(s["mean"], 2)),
            ),
            ", ",
        ).alias("example")
    )
    # One row per cluster from here on.
    largest = F.max(F.struct(F.col("n"), (-F.col("cluster")).alias("c"))).over(W.partitionBy(F.lit(0)))
    joined = sizes.join(cluster_labels(deviation), "cluster").join(means, "cluster")
    return joined.withColumn("_top", largest).select(
        "cluster", "n", "label", F.when(F.col("_top.c") == -F.col("cluster"), F.col("example")).alias("example")
    )
