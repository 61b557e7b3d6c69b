"""Anomalous rows: isolation forest scores, z-scores and reasons."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from facetwise import kernels
from facetwise.functions.values import col, number_columns
from facetwise.operators.prep import drop_sparse, gap_shares, impute_median, moments, z_score
from facetwise.operators.quantiles import long_quantiles
from facetwise.operators.schema import sample_rows
from facetwise.session import write_through

MIN_ROWS = 10
TREES = 100
TREE_ROWS = 256
CONTAMINATION = 0.05
MAX_MISSING = 0.5
TREE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, depth double"


def gate(df: DataFrame) -> str | None:
    """Why the table cannot be searched, or None."""
    if df.limit(MIN_ROWS).count() < MIN_ROWS:
        return "Fewer than 10 rows"
    if not number_columns(df):
        return "No numeric columns"
    if not number_columns(drop_sparse(df)):
        return "All numeric columns have >50% missing"
    return None


def features(df: DataFrame, key: Sequence[str], keep_key: bool = False) -> tuple[DataFrame, list[str]]:
    """Key and imputed numeric columns that are at most half empty. Key columns are
    not features unless ``keep_key``."""
    names = [c for c in number_columns(df) if keep_key or c not in key]
    shares = gap_shares(df, names)
    names = [c for c in names if shares[c] <= MAX_MISSING]
    narrow = df.select(*[col(c) for c in dict.fromkeys([*key, *names])])
    return impute_median(narrow, names, shares), names


def fit_forest(table: DataFrame, names: Sequence[str], key: Sequence[str], trees: int = TREES, seed: int = 42, rows: int | None = None) -> DataFrame:
    """Isolation trees as a node table. Trees are grown in parallel, each in its own task on 256 rows: its
    own draw from a seeded pool of 256 rows a tree, whatever the number of columns."""
    drawn = sample_rows(table, key, trees * TREE_ROWS, seed)
    cells = drawn.select(*[col(n).cast("double").alias(f"f{i}") for i, n in enumerate(names)], F.xxhash64(*[col(k) for k in key]).alias("_k"))
    values = F.to_json(F.struct(*[F.col(f"f{i}") for i in range(len(names))]))
    # Bounded by the pool's size, not by the table's.
    numbered = cells.withColumn("_n", F.row_number().over(W.orderBy("_k", values))).drop("_k")
    pool = write_through(numbered, "forest-pool")
    dealt = pool.select("_n", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("_tree"))
    order = W.partitionBy("_tree").orderBy(F.xxhash64(F.lit(seed), F.col("_tree"), F.col("_n")), "_n")
    own = dealt.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= TREE_ROWS).drop("_rank")
    return own.join(pool, "_n").groupBy("_tree").applyInPandas(kernels.tree_grower(len(names), seed), TREE_SCHEMA)


def score(table: DataFrame, names: Sequence[str], forest: DataFrame) -> DataFrame:
    """Adds ``score`` in (-1, 0); lower is more anomalous. The forest has at most 511 nodes a
    tree and travels to the tasks as arrays."""
    rows = table.limit(TREE_ROWS).count()
    packed = kernels.pack_forest(forest.toPandas(), rows)

    @F.pandas_udf("double")
    def isolation(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(kernels.forest_score(rows.to_numpy(dtype=np.float64), packed))

    # Scores are cut in the 12th digit, so that no summation order moves a row over the threshold.
    return table.withColumn("score", F.round(isolation(F.struct(*[col(n).cast("double") for n in names])), 12))


def z_scores(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """Adds ``z``: an array of (column_name, z) in column order, over all rows' mean and deviation."""
    learnt = moments(table, names)
    cells = [F.struct(F.lit(n).alias("column_name"), z_score(table, n, *learnt[n]).alias("z")) for n in names]
    return table.withColumn("z", F.array(*cells))


def explain(table: DataFrame) -> DataFrame:
    """From ``z``: severity, the two most extreme columns, and a reason."""
    ranked = F.array_sort(
        F.transform("z", lambda c, i: F.struct((-F.abs(c["z"])).alias("neg"), i.alias("i"), c["column_name"].alias("name"), c["z"].alias("z")))
    )
    best = table.withColumn("_first", F.get(ranked, F.lit(0))).withColumn("_second", F.get(ranked, F.lit(1)))
    reason = F.when(
        F.col("_second").isNotNull(), F.concat(F.lit("Most extreme: "), F.col("_first.name"), F.lit(", "), F.col("_second.name"))
    ).otherwise(F.concat(F.lit("Most extreme: "), F.col("_first.name")))
    return (
        best.withColumn("severity", -F.col("_first.neg"))
        .withColumn("col_1", F.col("_first.name"))
        .withColumn("z_1", F.col("_first.z"))
        .withColumn("col_2", F.coalesce("_second.name", F.lit("")))
        .withColumn("z_2", F.coalesce("_second.z", F.lit(0.0)))
        .withColumn("reason", reason)
        .drop("_first", "_second")
    )


def scored_rows(df: DataFrame, key: Sequence[str], trees: int = TREES, seed: int = 42) -> tuple[DataFrame, list[str]]:
    """Key, features and score of every row, written once because the cut and the ranking both read it."""
    table, names = features(df, key)
    forest = fit_forest(table, names, key, trees, seed)
    return write_through(score(table, names, forest), "scores"), names


def flag_anomalies(scored: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """Adds ``is_anomaly``: score strictly below its own quantile."""
    cut = long_quantiles(scored.select(F.col("score").alias("value")), [], [contamination]).select("quantile")
    return scored.withColumn("is_anomaly", F.col("score") < cut.scalar())


def anomalies(df: DataFrame, key: Sequence[str], contamination: float = CONTAMINATION, trees: int = TREES, seed: int = 42) -> DataFrame:
    """The anomalous rows -> key, features, score."""
    scored, _ = scored_rows(df, key, trees, seed)
    return flag_anomalies(scored, contamination).where("is_anomaly").drop("is_anomaly")


def anomaly_counts(flagged: DataFrame) -> DataFrame:
    """-> anomaly_count, anomaly_pct."""
    return flagged.agg(
        F.count_if("is_anomaly").alias("anomaly_count"),
        (F.avg(F.col("is_anomaly").cast("double")) * 100.0).alias("anomaly_pct"),
    )


def top_anomalies(df: DataFrame, key: Sequence[str], n: int = 20, contamination: float = CONTAMINATION, trees: int = TREES, seed: int = 42) -> DataFrame:
    """The ``n`` most anomalous rows with reasons -> key, score, severity, col_1, z_1, col_2, z_2, reason."""
    scored, names = scored_rows(df, key, trees, seed)
    # z_scores learns from all rows before the cut.
    flagged = flag_anomalies(z_scores(scored, names), contamination).where("is_anomaly")
    worst = flagged.orderBy("score", *[col(k) for k in key]).limit(n)
    return explain(worst).select(*[col(k) for k in key], "score", "severity", "col_1", "z_1", "col_2", "z_2", "reason")
