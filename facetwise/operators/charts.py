"""Chart-ready aggregates. Drawing is left to the reader."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from facetwise.functions.values import as_text, col, number, per_column
from facetwise.operators.correlation import best_pair, best_partner, correlations
from facetwise.operators.quantiles import medians
from facetwise.operators.schema import sample_rows

# Widening of the value range, so that the smallest value falls inside the first bin.
EDGE_SHARE = 0.001


def hist_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """-> column_name, n, mean, median, min, max of present values."""
    base = per_column(
        df,
        columns,
        lambda name: {
            "n": F.count(number(df, name)),
            "mean": F.avg(number(df, name)),
            "min": F.min(number(df, name)),
            "max": F.max(number(df, name)),
        },
    )
    return base.join(F.broadcast(medians(df, columns)), "column_name", "left").select(
        "column_name", "n", "mean", "median", "min", "max"
    )


def _range_row(df: DataFrame, name: str) -> DataFrame:
    """One row with a struct (lo, hi, first): bin range, and the widened first edge."""
    x = number(df, name)
    low, high = F.min(x), F.max(x)
    same = low == high

    def pad(edge):
        return F.when(edge != 0, F.abs(edge) * EDGE_SHARE).otherwise(F.lit(EDGE_SHARE))

    lo = F.when(same, low - pad(low)).otherwise(low)
    hi = F.when(same, high + pad(high)).otherwise(high)
    first = F.when(same, lo).otherwise(low - (high - low) * EDGE_SHARE)
    return df.agg(F.struct(lo.alias("lo"), hi.alias("hi"), first.alias("first")).alias("range"))


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin 1..bins with edges (left, right]: a guess by division, then put right by the edges."""
    step = (hi - lo) / bins

    def edge(i):
        return F.when(i >= bins, hi).otherwise(lo + i * step)

    guess = F.greatest(F.least(F.ceil((x - lo) / step), F.lit(bins)), F.lit(1))
    return (
        F.when(x.isNull(), F.lit(None))
        .when((guess > 1) & (x <= edge(guess - 1)), guess - 1)
        .when((guess < bins) & (x > edge(guess)), guess + 1)
        .otherwise(guess)
        .cast("int")
    )


def _binned(df: DataFrame, name: str, bins: int, alias: str) -> DataFrame:
    ranged = df.withColumn("_range", _range_row(df, name).scalar())
    return ranged.withColumn(alias, _bin(number(df, name), F.col("_range.lo"), F.col("_range.hi"), bins))


def with_bin(df: DataFrame, name: str, bins: int, alias: str = "bin") -> DataFrame:
    """Adds the equal-width bin of a column; missing values get none."""
    return _binned(df, name, bins, alias).drop("_range")


def histogram(df: DataFrame, name: str, bins: int = 20) -> DataFrame:
    """Equal-width bins, empty ones included -> bin, lo, hi, n. Two scans of one column."""
    counts = (
        _binned(df.select(col(name)), name, bins, "_bin")
        .groupBy("_bin")
        .agg(F.count(F.lit(1)).alias("n"), F.first("_range").alias("range"))
    )
    # At most bins + 1 rows from here on.
    low, high, i = F.col("range.lo"), F.col("range.hi"), F.col("bin")
    step = (high - low) / bins
    frame = (
        counts.agg(F.first("range").alias("range"))
        .select("range", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
        .select(
            "bin",
            F.when(i == 1, F.col("range.first")).otherwise(low + (i - 1) * step).alias("lo"),
            F.when(i == bins, high).otherwise(low + i * step).alias("hi"),
        )
        .where("lo is not null")
    )
    return frame.join(F.broadcast(counts.select("_bin", "n")), F.col("bin") == F.col("_bin"), "left").select(
        "bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n")
    )


def top_categories(df: DataFrame, name: str, n: int = 10) -> DataFrame:
    """Most frequent values as text -> value, n."""
    value = F.coalesce(as_text(df, name), F.lit("nan"))
    return (
        df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)
    )


def choose_pair(df: DataFrame, mentioned: Sequence[str] = ()) -> tuple[str, str]:
    """Two columns to plot: those mentioned, or one and its best partner, or the best pair."""
    from facetwise.functions.values import number_columns

    if len(mentioned) >= 2:
        return mentioned[0], mentioned[1]
    names = number_columns(df)
    if mentioned:
        found = best_partner(correlations(df), mentioned[0]).head()
        if found:
            return mentioned[0], found["partner"]
    else:
        found = best_pair(correlations(df)).head()
        if found:
            return found["col_a"], found["col_b"]
    return names[0], names[1]


def scatter(df: DataFrame, x: str, y: str, key: Sequence[str], n: int = 1000, seed: int = 0) -> DataFrame:
    """A seeded sample of points with r over all rows -> keys, x, y, r."""
    r = correlations(df, [x, y]).select("r")
    points = sample_rows(df.select(*[col(k) for k in dict.fromkeys([*key, x, y])]), key, n, seed)
    return points.select(
        *[col(k) for k in key], number(df, x).alias("x"), number(df, y).alias("y"), r.scalar().alias("r")
    )


def series(df: DataFrame, x: str, y: str, n: int | None = None, order_by: Sequence[str] | None = None) -> DataFrame:
    """All points, or the first ``n``, in the order given (by x when none is) -> x, y."""
    order = [col(k) for k in (order_by or [x])]
    ordered = df.orderBy(*order)
    return (ordered if n is None else ordered.limit(n)).select(col(x).alias("x"), col(y).alias("y"))


# Name parts that mark a column as the metric of a table.
METRIC_MARKS = ("rate", "pct", "percent", "approval")


def metric_column(names: Sequence[str]) -> str | None:
    """The first column named like a rate, else the second column."""
    for name in names:
        if any(mark in name.lower() for mark in METRIC_MARKS):
            return name
    return names[1] if len(names) > 1 else None


def extremes(df: DataFrame, label: str | None = None, metric: str | None = None) -> DataFrame:
    """Rows with the highest and lowest metric -> metric, high_label, high, low_label, low."""
    metric = metric or metric_column(df.columns)
    label = label or next((c for c in df.columns if c != metric), metric)
    x, name = number(df, metric), col(label).cast("string")
    # Ties go to the smallest label.
    high = F.min(F.when(x.isNotNull(), F.struct((-x).alias("v"), name.alias("label"))))
    low = F.min(F.when(x.isNotNull(), F.struct(x.alias("v"), name.alias("label"))))
    return df.agg(high.alias("_h"), low.alias("_l")).select(
        F.lit(metric).alias("metric"),
        F.col("_h.label").alias("high_label"),
        (-F.col("_h.v")).alias("high"),
        F.col("_l.label").alias("low_label"),
        F.col("_l.v").alias("low"),
    )
