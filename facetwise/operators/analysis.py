"""Grouping, ranking, bucketing and period questions over one table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from facetwise.functions.values import col, number, present
from facetwise.operators.charts import with_bin
from facetwise.operators.quantiles import long_quantiles, medians

SIMPLE = {"count", "sum", "mean", "min", "max"}


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys where null equals null; keys come from the left."""
    renamed = right.select(*[col(k).alias(f"_right_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    condition = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(f"_right_{i}")) for i, k in enumerate(keys)])
    return left.join(renamed, condition, how).drop(*[f"_right_{i}" for i in range(len(keys))])


def _measure(df: DataFrame, name: str, fn: str) -> Column:
    if fn not in SIMPLE:
        raise ValueError(f"unknown aggregate: {fn}")
    value = present(df, name)
    return {"count": F.count, "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[fn](value)


def group_agg(df: DataFrame, keys: Sequence[str], measures: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``measures`` maps output names to (column, count|sum|mean|median|min|max) -> keys, outputs."""
    simple = {a: m for a, m in measures.items() if m[1] != "median"}
    middle = {a: m for a, m in measures.items() if m[1] == "median"}
    aggs = [_measure(df, name, fn).alias(alias) for alias, (name, fn) in simple.items()]
    result = df.groupBy(*[col(k) for k in keys]).agg(*(aggs or [F.count(F.lit(1)).alias("_rows")]))
    if middle:
        names = list(dict.fromkeys(name for name, _ in middle.values()))
        found = medians(df, names, keys).groupBy(*[col(k) for k in keys]).agg(
            *[
                F.max(F.when(F.col("column_name") == name, F.col("median"))).alias(alias)
                for alias, (name, _) in middle.items()
            ]
        )
        result = join_on_keys(result, found, keys)
    return result.select(*[col(k) for k in keys], *[col(a) for a in measures])


def value_counts(df: DataFrame, name: str, n: int | None = None) -> DataFrame:
    """-> value, n; most frequent first, missing left out."""
    counts = df.groupBy(present(df, name).alias("value")).agg(F.count(F.lit(1)).alias("n")).where("value is not null")
    return counts if n is None else counts.orderBy(F.desc("n"), "value").limit(n)


def top_n(df: DataFrame, by: str, n: int, ties: Sequence[str], per: Sequence[str] = (), ascending: bool = False) -> DataFrame:
    """The ``n`` rows with the largest (smallest) ``by``, overall or per group."""
    first = col(by).asc_nulls_last() if ascending else col(by).desc_nulls_last()
    order = [first, *[col(t) for t in ties]]
    if not per:
        return df.orderBy(*order).limit(n)
    ranked = W.partitionBy(*[col(k) for k in per]).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= n)


def bottom_n(df: DataFrame, by: str, n: int, ties: Sequence[str], per: Sequence[str] = ()) -> DataFrame:
    return top_n(df, by, n, ties, per, ascending=True)


def count_where(df: DataFrame, predicate: Column) -> DataFrame:
    """-> n, rows."""
    return df.agg(F.count_if(predicate).alias("n"), F.count(F.lit(1)).alias("rows"))


def rate_by(df: DataFrame, keys: Sequence[str], outcome: Column) -> DataFrame:
    """Share of rows with the outcome -> keys, n, rate."""
    hit = F.when(outcome, 1.0).otherwise(0.0)
    return df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("rate"))


def bucket_equal_width(df: DataFrame, name: str, buckets: int, metric: Column) -> DataFrame:
    """Equal-width buckets of a column with a metric each -> bucket, n, metric."""
    binned = with_bin(df, name, buckets, "bucket").where("bucket is not null")
    return binned.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), metric.alias("metric"))


def with_quantile_bucket(df: DataFrame, value: Column, buckets: int, alias: str = "bucket") -> DataFrame:
    """Adds a quantile bucket 1..buckets: edges by linear quantiles, right ends included, equal
    values always share a bucket."""
    probs = [i / buckets for i in range(1, buckets)]
    x = value.cast("double")
    x = F.when(~F.isnan(x), x)
    found = long_quantiles(df.select(x.alias("value")), [], probs)
    at = [F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(f"e{i}") for i, p in enumerate(probs)]
    edges = found.agg(F.struct(*at).alias("edges")).scalar()
    above = sum((F.when(x > F.col(f"_edges.e{i}"), 1).otherwise(0) for i in range(len(probs))), F.lit(1))
    return df.withColumn("_edges", edges).withColumn(alias, F.when(x.isNotNull(), above)).drop("_edges")


def bucket_quantile(df: DataFrame, value: Column, buckets: int, metric: Column) -> DataFrame:
    """Quantile buckets with a metric each -> bucket, n, lo, hi, metric."""
    bucketed = with_quantile_bucket(df.withColumn("_x", value), F.col("_x"), buckets).where("bucket is not null")
    return bucketed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"), metric.alias("metric")
    )


def ratio_buckets(df: DataFrame, top: str, bottom: str, outcome: Column, buckets: int = 4) -> DataFrame:
    """Buckets of top / bottom with the rate of an outcome -> bucket, n, lo, hi, metric."""
    ratio = F.try_divide(number(df, top), number(df, bottom))
    return bucket_quantile(df, ratio, buckets, F.avg(F.when(outcome, 1.0).otherwise(0.0)))


def by_period(df: DataFrame, ts: str, period: str, measures: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Aggregates per calendar period -> keys, period, outputs."""
    start = F.date_trunc(period, col(ts)).cast("timestamp_ntz").alias("period")
    return df.groupBy(*[col(k) for k in keys], start).agg(*[m.alias(a) for a, m in measures.items()])


def share_of_total(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """-> keys, total, share. The grand total is a scalar over the group totals, so there is no
    window over all groups and no second scan."""
    totals = df.groupBy(*[col(k) for k in keys]).agg(F.sum(number(df, value)).alias("total"))
    return totals.withColumn("share", F.try_divide(F.col("total"), totals.agg(F.sum("total")).scalar()))


def change_by_period(periods: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds previous value, change, pct and direction to a table with one row per period (and key)."""
    before = F.lag(col(value)).over(W.partitionBy(*[col(k) for k in keys]).orderBy("period"))
    return (
        periods.withColumn("previous", before)
        .withColumn("change", col(value) - F.col("previous"))
        .withColumn("pct", F.try_divide(F.col("change") * 100.0, F.col("previous")))
        .withColumn(
            "direction",
            F.when(F.col("change") > 0, "increase").when(F.col("change") < 0, "decrease").when(F.col("change") == 0, "flat"),
        )
    )


def compare_groups(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean per group next to the overall mean -> keys, n, mean, overall, gap."""
    groups = df.groupBy(*[col(k) for k in keys]).agg(
        F.count(number(df, value)).alias("n"), F.sum(number(df, value)).alias("_sum")
    )
    overall = groups.agg(F.try_divide(F.sum("_sum"), F.sum("n"))).scalar()
    means = groups.withColumn("mean", F.try_divide(F.col("_sum"), F.col("n"))).withColumn("overall", overall)
    return means.withColumn("gap", F.col("mean") - F.col("overall")).drop("_sum")


def derived_sums(df: DataFrame, keys: Sequence[str], derived: Column) -> DataFrame:
    """Sums of a computed value per group -> keys, n, total."""
    return df.groupBy(*[col(k) for k in keys]).agg(F.count(derived).alias("n"), F.sum(derived).alias("total"))
