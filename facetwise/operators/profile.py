"""Profile aggregates: missing cells, duplicates, summaries, distinct counts, flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from facetwise.functions.values import (
    as_text,
    chunks,
    col,
    dtype,
    finite,
    is_number,
    melt,
    missing as is_missing,
    number,
    number_columns,
    per_column,
    present,
    text_columns,
    union_all,
)
from facetwise.operators.quantiles import quantiles
from facetwise.operators.schema import first_values, truncate

HIGH_MISSING_PCT = 30.0
LOW_CARDINALITY = 10
HIGH_SKEW = 2.0


def _pct(part, whole):
    return F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0))


def shape(df: DataFrame) -> DataFrame:
    """-> rows, cols."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("cols", F.lit(len(df.columns)).cast("bigint"))


def missing_all(df: DataFrame) -> DataFrame:
    """Every column -> column_name, position, missing, rows, pct. One pass."""
    counted = per_column(
        df,
        df.columns,
        lambda name: {"missing": F.count_if(is_missing(df, name)), "rows": F.count(F.lit(1))},
    )
    return counted.withColumn("pct", _pct(F.col("missing"), F.col("rows")))


def missing(df: DataFrame) -> DataFrame:
    """Columns with missing values, most first -> column_name, missing, pct."""
    return (
        missing_all(df)
        .where("missing > 0")
        .orderBy(F.desc("pct"), "position")
        .select("column_name", "missing", "pct")
    )


def high_missing(df: DataFrame, cut: float = HIGH_MISSING_PCT) -> DataFrame:
    """Columns with more than ``cut`` percent missing (strict)."""
    return missing(df).where(F.col("pct") > cut)


def missing_cells(df: DataFrame) -> DataFrame:
    """Over the whole table -> missing, cells, pct."""
    return (
        missing_all(df)
        .agg(F.sum("missing").alias("missing"), F.sum("rows").alias("cells"))
        .withColumn("pct", _pct(F.col("missing"), F.greatest(F.col("cells"), F.lit(1))))
    )


def missing_notes(df: DataFrame, min_pct: float = 1.0, n: int = 8) -> DataFrame:
    """Sentences on the emptiest columns -> column_name, missing, note."""
    return (
        missing_all(df)
        .where((F.col("missing") > 0) & (F.col("pct") >= min_pct))
        .orderBy(F.desc("missing"), "position")
        .limit(n)
        .select(
            "column_name",
            "missing",
            F.format_string(
                "Column '%s' has %s%% missing values (%s rows).",
                F.col("column_name"),
                F.format_number("pct", 1),
                F.format_number("missing", 0),
            ).alias("note"),
        )
    )


def most_missing(df: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` columns with most missing values -> column_name, missing."""
    return (
        missing_all(df)
        .where("missing > 0")
        .orderBy(F.desc("missing"), "position")
        .limit(n)
        .select("column_name", "missing")
    )


def duplicates(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row -> rows, duplicate_rows, pct.

    Missing equals missing. The first shuffle carries only an 8-byte row hash;
    whole rows are compared only where a hash occurs more than once, which also
    makes the count exact.
    """
    names = df.columns
    # Columns a hash or grouping cannot take as they are become text; NaN and -0.0 are folded.
    flat = df.select(
        *[
            (
                present(df, n) + F.lit(0.0)
                if isinstance(dtype(df, n), T.DoubleType)
                else as_text(df, n)
                if isinstance(dtype(df, n), (T.FloatType, T.MapType, T.ArrayType, T.StructType))
                else col(n)
            ).alias(f"c{i}")
            for i, n in enumerate(names)
        ]
    )
    hashed = flat.withColumn("_h", F.xxhash64(*flat.columns))
    per_hash = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("n"))
    repeated = per_hash.where("n > 1").select("_h")
    exact = (
        hashed.join(repeated, "_h", "left_semi")
        .groupBy("_h", *flat.columns)
        .agg((F.count(F.lit(1)) - 1).alias("extra"))
        .agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicate_rows"))
    )
    return (
        df.agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("duplicate_rows", exact.scalar())
        .withColumn("pct", _pct(F.col("duplicate_rows"), F.col("rows")))
        .select("rows", "duplicate_rows", "pct")
    )


def _moments(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """count, mean, std, min, max per numeric column. One pass."""
    return per_column(
        df,
        names,
        lambda name: {
            "count": F.count(number(df, name)),
            "mean": F.avg(number(df, name)),
            "std": F.stddev_samp(number(df, name)),
            "min": F.min(number(df, name)),
            "max": F.max(number(df, name)),
        },
    )


_NO_SUMMARY = "column_name string, mean double, std double, min double, max double, median double"


def numeric_summary(df: DataFrame) -> DataFrame:
    """Numeric columns -> column_name, mean, std, min, max, median (infinity as null)."""
    names = number_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], _NO_SUMMARY)
    middle = quantiles(df, names, [0.5]).select("column_name", F.col("quantile").alias("median"))
    joined = _moments(df, names).join(F.broadcast(middle), "column_name", "left")
    measures = ("mean", "std", "min", "max", "median")
    return joined.select("column_name", *[finite(F.col(m)).alias(m) for m in measures])


def _quartiles(df: DataFrame, names: Sequence[str]) -> DataFrame:
    spread = {0.25: "q25", 0.5: "q50", 0.75: "q75"}
    return (
        quantiles(df, names, list(spread))
        .groupBy("column_name")
        .agg(*[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(a) for p, a in spread.items()])
    )


def value_counts_all(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """-> column_name, value (text, null for missing), n. One shuffle for all columns."""
    parts = [melt(df, part, lambda name: as_text(df, name)) for part in chunks(names)]
    return union_all(parts).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def frequent_texts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Text columns -> column_name, unique, top, freq (ties: smallest value)."""
    counts = value_counts_all(df, names).where("value is not null")
    return counts.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("unique"),
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("value"))).alias("_best"),
    ).select(
        "column_name",
        "unique",
        F.col("_best.value").alias("top"),
        (-F.col("_best.neg")).alias("freq"),
    )


def describe_all(df: DataFrame) -> DataFrame:
    """All columns -> column_name, count, unique, top, freq, mean, std, min, q25, q50, q75, max."""
    numbers = number_columns(df)
    others = [c for c in df.columns if c not in numbers]
    counts = per_column(df, df.columns, lambda name: {"count": F.count(present(df, name))}).drop("position")
    if numbers:
        numeric = _moments(df, numbers).drop("position", "count").join(F.broadcast(_quartiles(df, numbers)), "column_name")
    else:
        numeric = df.sparkSession.createDataFrame(
            [], "column_name string, mean double, std double, min double, max double, q25 double, q50 double, q75 double"
        )
    if others:
        tops = frequent_texts(df, others)
    else:
        tops = df.sparkSession.createDataFrame([], "column_name string, unique bigint, top string, freq bigint")
    return (
        counts.join(F.broadcast(numeric), "column_name", "left")
        .join(F.broadcast(tops), "column_name", "left")
        .select("column_name", "count", "unique", "top", "freq", "mean", "std", "min", "q25", "q50", "q75", "max")
    )


def column_summary(df: DataFrame, max_chars: int = 200) -> DataFrame:
    """-> column_name, dtype, non_null, nulls, then unique/top/top_count or min/max/mean.

    ``top`` counts missing cells as the text "nan", ``unique`` leaves them out.
    """
    numbers = number_columns(df)
    others = [c for c in df.columns if c not in numbers]
    base = per_column(
        df,
        df.columns,
        lambda name: {
            "dtype": F.lit(dtype(df, name).simpleString()),
            "non_null": F.count(present(df, name)),
            "nulls": F.count_if(is_missing(df, name)),
            "min": F.min(number(df, name)) if name in numbers else F.min(F.lit(None).cast("double")),
            "max": F.max(number(df, name)) if name in numbers else F.max(F.lit(None).cast("double")),
            "mean": F.avg(number(df, name)) if name in numbers else F.avg(F.lit(None).cast("double")),
        },
    )
    if others:
        counts = value_counts_all(df, others)
        tops = counts.groupBy("column_name").agg(
            F.count("value").alias("unique"),
            F.min(F.struct((-F.col("n")).alias("neg"), F.coalesce("value", F.lit("nan")).alias("value"))).alias("_best"),
        )
        tops = tops.select(
            "column_name",
            "unique",
            truncate(F.col("_best.value"), max_chars).alias("top"),
            (-F.col("_best.neg")).alias("top_count"),
        )
    else:
        tops = df.sparkSession.createDataFrame([], "column_name string, unique bigint, top string, top_count bigint")
    return base.join(F.broadcast(tops), "column_name", "left").select(
        "column_name", "dtype", "non_null", "nulls", "unique", "top", "top_count", "min", "max", "mean"
    )


def column_stats(df: DataFrame, name: str, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """One column -> mean, std, min, max (as text), nulls, samples. Unknown columns are an error."""
    if name not in df.columns:
        raise ValueError(f"column not found: {name}")
    numeric = is_number(dtype(df, name), booleans=True)
    value = number(df, name) if numeric else present(df, name)
    nothing = F.max(F.lit(None).cast("double"))
    stats = df.agg(
        (F.avg(value) if numeric else nothing).alias("mean"),
        (F.stddev_samp(value) if numeric else nothing).alias("std"),
        F.min(value).cast("string").alias("min"),
        F.max(value).cast("string").alias("max"),
        F.count_if(is_missing(df, name)).alias("nulls"),
    )
    samples = first_values(df, [name], order_by, n, True).select("samples")
    return stats.withColumn("samples", samples.scalar())


def top_values(df: DataFrame, cols: int | None = None, n: int = 8) -> DataFrame:
    """The ``n`` most frequent values of all non-numeric columns (or the first ``cols``), missing
    counted as "nan" -> column_name, value, n, rank."""
    names = [c for c in df.columns if c not in number_columns(df)][:cols]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, value string, n bigint, rank int")
    counts = value_counts_all(df, names).withColumn("value", F.coalesce("value", F.lit("nan")))
    # A rank filter on row_number lets Spark keep only n rows per task before the shuffle.
    ranked = W.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= n)


def distinct_counts(df: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct values with missing as one value -> column_name, distinct.

    Exact counts go through (column, value) pairs, so no task holds all values
    of a column; ``approx`` trades that shuffle for a sketch.
    """
    if approx:
        return per_column(
            df,
            df.columns,
            lambda name: {
                "distinct": F.approx_count_distinct(present(df, name))
                + F.coalesce(F.max(is_missing(df, name).cast("int")), F.lit(0))
            },
        ).drop("position")
    found = value_counts_all(df, df.columns).groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct"))
    # An empty table has no pairs; its columns still get a row.
    names = F.explode(F.array(*[F.lit(c) for c in df.columns])).alias("column_name")
    all_names = df.sparkSession.range(1).select(names)
    return all_names.join(F.broadcast(found), "column_name", "left").select(
        "column_name", F.coalesce("distinct", F.lit(0)).alias("distinct")
    )


def skew_measures(df: DataFrame):
    """Aggregates of the adjusted sample skewness, for ``per_column``."""

    def measures(name):
        x = number(df, name)
        n = F.count(x)
        factor = F.try_divide(F.sqrt(n * (n - 1.0)), n - 2.0)
        # Three values are the least the adjusted form is defined for.
        return {"rows": F.count(F.lit(1)), "skew": F.when(n >= 3, F.skewness(x) * factor)}

    return measures


def skews(df: DataFrame) -> DataFrame:
    """Adjusted sample skewness -> column_name, rows, skew. One pass."""
    return per_column(df, number_columns(df), skew_measures(df))


def _flag_rows(frame: DataFrame, flag: str, detail: str) -> DataFrame:
    return frame.select("column_name", F.lit(flag).alias("flag"), F.col(detail).cast("double").alias("detail"))


def flags(df: DataFrame, distinct: DataFrame | None = None) -> DataFrame:
    """Distribution flags -> column_name, flag, detail."""
    distinct = distinct_counts(df) if distinct is None else distinct
    seen = distinct.withColumn("rows", df.agg(F.count(F.lit(1))).scalar()).where("rows > 0")
    frames = [
        _flag_rows(seen.where("distinct = 1"), "constant", "distinct"),
        _flag_rows(seen.where("distinct = rows"), "possible_id", "rows"),
        _flag_rows(
            seen.where((F.col("distinct") < LOW_CARDINALITY) & F.col("column_name").isin(text_columns(df))),
            "low_cardinality",
            "distinct",
        ),
    ]
    if number_columns(df):
        skewed = skews(df).where((F.col("rows") >= 3) & (F.abs(finite(F.col("skew"))) > HIGH_SKEW))
        frames.append(_flag_rows(skewed, "high_skew", "skew"))
    return union_all(frames)
