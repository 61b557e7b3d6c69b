"""Pearson correlation of all numeric column pairs, and views on it."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from facetwise import kernels
from facetwise.functions.values import finite, missing, number, number_columns, per_column, union_all

STRONG = 0.5
# More pairs than this make generated code too large.
SUMS_PER_PASS = 150
PAIR_SCHEMA = "pair int, col_a string, col_b string, r double"


def _full_pairs(df: DataFrame, pairs: list, means: dict[str, float]) -> DataFrame:
    """r for pairs of gap-free columns: all pairs share n, the sums and the squares, so a pair
    costs one multiply-add a row. Values are shifted by their means, which keeps the sums small."""
    names = list(dict.fromkeys(name for _, pair in pairs for name in pair))
    at = {name: i for i, name in enumerate(names)}
    shifted = df.select(*[(number(df, c) - F.lit(float(means[c]))).alias(f"x{i}") for c, i in at.items()])
    sums = [F.count(F.lit(1)).cast("double").alias("n")]
    sums += [F.sum(f"x{i}").alias(f"s{i}") for i in at.values()]
    sums += [F.sum(F.col(f"x{i}") * F.col(f"x{i}")).alias(f"q{i}") for i in at.values()]
    sums += [F.sum(F.col(f"x{at[a]}") * F.col(f"x{at[b]}")).alias(f"p{i}") for i, (a, b) in pairs]

    def moment(cross, one, other):
        return F.col(cross) - F.col(one) * F.col(other) / F.col("n")

    rows = []
    for i, (a, b) in pairs:
        one, other = at[a], at[b]
        spread = F.sqrt(moment(f"q{one}", f"s{one}", f"s{one}")) * F.sqrt(moment(f"q{other}", f"s{other}", f"s{other}"))
        rows.append(_row(i, a, b, finite(F.try_divide(moment(f"p{i}", f"s{one}", f"s{other}"), spread))))
    return shifted.agg(*sums).select(F.inline(F.array(*rows)))


def _gram_pairs(df: DataFrame, pairs: list, means: dict[str, float]) -> DataFrame:
    """r for any pairs, missing values removed pair by pair: every task multiplies its Arrow batches
    into sums for all pairs, so wide tables and tables with gaps take one scan."""
    names = list(dict.fromkeys(name for _, pair in pairs for name in pair))
    at = {name: i for i, name in enumerate(names)}
    shifted = df.select(*[(number(df, c) - F.lit(float(means[c]))).alias(f"x{i}") for c, i in at.items()])
    sums = shifted.mapInArrow(kernels.pair_sums([(i, at[a], at[b]) for i, (a, b) in pairs]), kernels.PAIR_SUMS)
    totals = sums.groupBy("pair").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])

    def spread(squares, total):
        left = F.col(squares) - F.col(total) * F.col(total) / F.col("n")
        # What rounding leaves of a constant is not spread.
        return F.sqrt(F.when(left > F.col(squares) * 1e-13, left))

    together = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    r = F.try_divide(together, spread("sxx", "sx") * spread("syy", "sy"))
    # One row per pair on both sides.
    labels = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in pairs], "pair int, col_a string, col_b string")
    return labels.join(totals.select("pair", finite(r).alias("r")), "pair", "left")


def _row(i: int, a: str, b: str, r: Column) -> Column:
    return F.struct(F.lit(i).alias("pair"), F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), r.alias("r"))


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Upper triangle of the matrix -> pair (column order), col_a, col_b, r (null for constants).

    ``corr`` raises a division error on constants in ANSI mode, so r is put
    together from sums. A first pass, one row per column, finds the means and
    which columns have gaps or are constant.
    """
    names = list(columns) if columns is not None else number_columns(df)
    pairs = list(enumerate(combinations(names, 2)))
    if not pairs:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    seen = per_column(
        df,
        names,
        lambda name: {
            "mean": F.avg(number(df, name)),
            "gaps": F.count_if(missing(df, name)),
            "constant": F.coalesce(F.min(number(df, name)) == F.max(number(df, name)), F.lit(True)),
        },
    ).collect()
    constant = {r["column_name"] for r in seen if r["constant"]}
    gappy = any(r["gaps"] for r in seen)
    means = {r["column_name"]: r["mean"] for r in seen}

    flat = [(i, a, b, None) for i, (a, b) in pairs if {a, b} & constant]
    live = [p for p in pairs if not set(p[1]) & constant]
    frames = []
    if flat:
        frames.append(df.sparkSession.createDataFrame(flat, PAIR_SCHEMA))
    if live:
        inline = not gappy and len(live) <= SUMS_PER_PASS
        frames.append((_full_pairs if inline else _gram_pairs)(df, live, means))
    return union_all(frames)


def _by_strength(corr: DataFrame) -> DataFrame:
    return corr.where("r is not null").orderBy(F.desc(F.abs("r")), "pair")


def strong_pairs(corr: DataFrame, cut: float = STRONG, n: int = 5) -> DataFrame:
    """The strongest pairs with abs(r) above ``cut`` -> col_a, col_b, r, pair."""
    return _by_strength(corr).where(F.abs("r") > cut).limit(n)


def pair_report(corr: DataFrame, cut: float = STRONG, n: int = 5) -> DataFrame:
    """-> col_a, col_b, r, abs_r, direction."""
    return strong_pairs(corr, cut, n).select(
        "col_a",
        "col_b",
        "r",
        F.abs("r").alias("abs_r"),
        F.when(F.col("r") >= 0, "positive").otherwise("negative").alias("direction"),
    )


def mirrored(corr: DataFrame) -> DataFrame:
    """Both directions of every pair -> feature, partner, r, pair."""
    one = corr.select(F.col("col_a").alias("feature"), F.col("col_b").alias("partner"), "r", "pair")
    two = corr.select(F.col("col_b").alias("feature"), F.col("col_a").alias("partner"), "r", "pair")
    return one.unionByName(two)


def heatmap(df: DataFrame, cols: int | None = None, digits: int = 3) -> DataFrame:
    """The full rounded matrix of all numeric columns (or the first ``cols``) -> a, b, r."""
    names = number_columns(df)[:cols]
    corr = correlations(df, names)
    # The diagonal is 1, or null for a constant column, like any other pair.
    spread = df.agg(
        F.array(
            *[F.struct(F.lit(n).alias("feature"), F.stddev_pop(number(df, n)).alias("s")) for n in names]
        ).alias("_rows")
    ).select(F.inline("_rows"))
    diagonal = spread.select("feature", F.col("feature").alias("partner"), F.when(F.col("s") > 0, 1.0).alias("r"))
    cells = mirrored(corr).select("feature", "partner", "r").unionByName(diagonal)
    return cells.select(F.col("feature").alias("a"), F.col("partner").alias("b"), F.round("r", digits).alias("r"))


def wide_heatmap(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """Long heatmap cells as one row per column."""
    return cells.groupBy("a").pivot("b", list(names)).agg(F.first("r"))


def top_pairs(corr: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` strongest pairs, whatever their strength."""
    return _by_strength(corr).limit(n)


def importance(corr: DataFrame, n: int = 10) -> DataFrame:
    """Mean abs(r) of a column with the others -> feature, score.

    A column's own cell counts as zero in the mean; pairs without r are left out.
    """
    score = F.coalesce(F.sum(F.abs("r")), F.lit(0.0)) / (F.count("r") + 1)
    first_seen = F.min("pair")
    return (
        mirrored(corr)
        .groupBy("feature")
        .agg(score.alias("score"), first_seen.alias("_pair"))
        .orderBy(F.desc("score"), "_pair", "feature")
        .limit(n)
        .select("feature", "score")
    )


def best_pair(corr: DataFrame) -> DataFrame:
    """The single strongest pair with r other than zero -> col_a, col_b, r."""
    return _by_strength(corr.where("r <> 0")).limit(1).select("col_a", "col_b", "r")


def best_partner(corr: DataFrame, column: str) -> DataFrame:
    """The column most related to ``column`` -> partner, r."""
    related = mirrored(corr).where((F.col("feature") == column) & (F.col("r") != 0))
    return related.orderBy(F.desc(F.abs("r")), "pair").limit(1).select("partner", "r")


def best_partners(corr: DataFrame) -> DataFrame:
    """The most related partner of every column -> feature, partner, r."""
    strongest = W.partitionBy("feature").orderBy(F.desc(F.abs("r")), "pair")
    return (
        mirrored(corr)
        .where("r <> 0")
        .withColumn("_rank", F.row_number().over(strongest))
        .where("_rank = 1")
        .select("feature", "partner", "r")
    )
