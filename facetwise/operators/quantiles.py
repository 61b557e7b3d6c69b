"""Exact quantiles of many columns, with or without grouping keys.

``percentile`` keeps every distinct value of a group in one task's memory. Here
the work stays spread out, in two scans:

1. A cheap mergeable sketch brackets each wanted quantile. Sketches are merged
   in two levels (salt, then total); the smallest lower and the largest upper
   end over the salts bracket the quantile of the union.
2. Rows outside the brackets are only counted. Rows inside are counted per
   value (equal values collapse before the shuffle) and per equal-width slice
   of their bracket, so that only the slice holding the wanted rank is sorted.

Ranks are checked against exact counts, so a bracket can never yield a wrong
value. Interpolation is linear between the two neighbouring ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from facetwise.functions.values import col, melt, number

SALTS = 64
SLICES = 4096


def _brackets(long: DataFrame, groups: list[str], probs: Sequence[float], accuracy: int) -> DataFrame:
    """Per group: ``n`` and two end points per probability, ``_e0.._e{2m-1}``."""
    error = 1.0 / accuracy
    margin = 5 * error
    # Below this many rows the margin is less than a few ranks: take the whole range.
    small = int(20 / (margin - error))
    lows = [max(p - margin, 0.0) for p in probs]
    highs = [min(p + margin, 1.0) for p in probs]
    sketched = (
        long.withColumn("_salt", F.spark_partition_id() % SALTS)
        .groupBy(*groups, "_salt")
        .agg(
            F.count("value").alias("n"),
            F.min("value").alias("lo"),
            F.max("value").alias("hi"),
            F.percentile_approx("value", lows + highs, accuracy).alias("ends"),
        )
    )
    merged = sketched.groupBy(*groups).agg(
        F.sum("n").alias("n"),
        F.min("lo").alias("_min"),
        F.max("hi").alias("_max"),
        *[F.min(F.col("ends")[i]).alias(f"_a{i}") for i in range(len(probs))],
        *[F.max(F.col("ends")[len(probs) + i]).alias(f"_b{i}") for i in range(len(probs))],
    )
    whole = F.col("n") < small
    ends = []
    for i in range(len(probs)):
        low = F.col("_min") if lows[i] == 0.0 else F.when(whole, F.col("_min")).otherwise(F.col(f"_a{i}"))
        high = F.col("_max") if highs[i] == 1.0 else F.when(whole, F.col("_max")).otherwise(F.col(f"_b{i}"))
        ends += [low.alias(f"_e{2 * i}"), high.alias(f"_e{2 * i + 1}")]
    return merged.select(*groups, "n", *ends)


def long_quantiles(
    long: DataFrame,
    groups: Sequence[str],
    probs: Sequence[float],
    accuracy: int = 1000,
    few_groups: bool = False,
) -> DataFrame:
    """Quantiles of ``value`` per ``groups`` -> groups, prob, n, quantile.

    ``few_groups`` promises that the groups are bounded (one per column, say),
    which makes the bracket table safe to broadcast.
    """
    groups = list(groups)
    probs = [float(p) for p in probs]
    if not groups:
        one = long.withColumn("_all", F.lit(0))
        return long_quantiles(one, ["_all"], probs, accuracy, few_groups=True).drop("_all")

    # Adding zero folds -0.0 into 0.0.
    long = long.where(F.col("value").isNotNull()).select(*groups, (F.col("value") + F.lit(0.0)).alias("value"))
    brackets = _brackets(long, groups, probs, accuracy)
    ends_of = brackets.select(
        *[F.col(g).alias(f"_g_{g}") for g in groups], *[f"_e{i}" for i in range(2 * len(probs))]
    )
    located = long.join(
        F.broadcast(ends_of) if few_groups else ends_of,
        on=[F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups],
    )

    v = F.col("value")
    ends = [F.col(f"_e{i}") for i in range(2 * len(probs))]
    above = sum((F.when(v > e, 1).otherwise(0) for e in ends), F.lit(0))
    on_end = F.lit(False)
    inside = F.lit(False)
    for e in ends:
        on_end = on_end | (v == e)
    for i in range(len(probs)):
        inside = inside | ((v > ends[2 * i]) & (v < ends[2 * i + 1]))
    below_v = F.greatest(F.lit(None).cast("double"), *[F.when(e < v, e) for e in ends])
    above_v = F.least(F.lit(None).cast("double"), *[F.when(e > v, e) for e in ends])
    share = F.try_divide(v - below_v, above_v - below_v)
    # A cell is an end point itself (odd) or the open stretch before it (even).
    counts = (
        located.select(
            *groups,
            (2 * above + F.when(on_end, 1).otherwise(0)).alias("_cell"),
            F.when(~on_end & inside, F.least(F.floor(share * SLICES), F.lit(SLICES - 1)))
            .otherwise(F.lit(0))
            .cast("int")
            .alias("_slice"),
            F.when(on_end | inside, v).alias("_value"),
        )
        .groupBy(*groups, "_cell", "_slice", "_value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )

    # At most (4 * probs + 1) * SLICES rows per group reach this window.
    in_order = W.partitionBy(*groups).orderBy("_cell", "_slice")
    cells = (
        counts.groupBy(*groups, "_cell", "_slice")
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_before", F.sum("_n").over(in_order.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("_before", F.coalesce(F.col("_before"), F.lit(0)))
        .withColumn("n", F.sum("_n").over(W.partitionBy(*groups)))
    )
    wanted = F.array(
        *[
            F.struct(
                F.lit(p).alias("prob"),
                side.alias("_side"),
                rank((F.col("n") - 1) * F.lit(p)).cast("bigint").alias("_rank"),
            )
            for p in probs
            for side, rank in ((F.lit(0), F.floor), (F.lit(1), F.ceil))
        ]
    )
    targets = (
        cells.select(*groups, "_cell", "_slice", "_n", "_before", "n", F.inline(wanted))
        .where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
        .select(
            *[F.col(g).alias(f"_g_{g}") for g in groups],
            F.col("_cell").alias("_tc"),
            F.col("_slice").alias("_ts"),
            "prob",
            "_side",
            (F.col("_rank") - F.col("_before")).alias("_rank"),
            "n",
        )
    )
    at_target = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups]
    at_target += [F.col("_cell") == F.col("_tc"), F.col("_slice") == F.col("_ts")]
    within = W.partitionBy(*groups, "_cell", "_slice", "prob", "_side").orderBy(F.col("_value").asc_nulls_first())
    hit = (
        counts.join(F.broadcast(targets) if few_groups else targets, on=at_target)
        .withColumn("_upto", F.sum("_n").over(within.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n")))
    )
    value = F.coalesce(F.col("_value"), F.raise_error(F.lit("quantile outside its bracket")).cast("double"))
    low = F.max(F.when(F.col("_side") == 0, value))
    high = F.max(F.when(F.col("_side") == 1, value))
    position = (F.first("n") - 1) * F.col("prob")
    # Equal neighbours skip the arithmetic, so that infinities survive it.
    linear = F.when(low == high, low).otherwise(low + (high - low) * (position - F.floor(position)))
    return hit.groupBy(*groups, "prob").agg(F.first("n").alias("n"), linear.alias("quantile"))


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    keys: Sequence[str] = (),
    accuracy: int = 1000,
) -> DataFrame:
    """Exact linear quantiles -> keys, column_name, prob, n, quantile."""
    long = melt(df, columns, lambda name: number(df, name), keys)
    return long_quantiles(long, [*keys, "column_name"], probs, accuracy, few_groups=not keys)


def medians(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Exact medians -> keys, column_name, median."""
    return quantiles(df, columns, [0.5], keys).select(*keys, "column_name", F.col("quantile").alias("median"))


def scalar_values(frame: DataFrame, key: str, value: str) -> dict[str, float]:
    """A table with one row per column or probability as a dict (bounded by the schema)."""
    return {row[0]: row[1] for row in frame.select(key, value).collect()}
