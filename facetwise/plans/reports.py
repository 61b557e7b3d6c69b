"""The combined profile of a table, and its model results, as fact rows.

Facts are long: dataset, section, column_name, metric, value_double,
value_string. Profiles of many tables can be unioned, stored by section and
compared by Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from facetwise.functions.values import finite, missing, number, number_columns, per_column, text_columns, union_all
from facetwise.operators import anomaly, cluster, timeseries
from facetwise.operators.correlation import correlations, strong_pairs
from facetwise.operators.profile import (
    HIGH_MISSING_PCT,
    HIGH_SKEW,
    LOW_CARDINALITY,
    distinct_counts,
    duplicates,
    skew_measures,
)
from facetwise.operators.quantiles import medians

FACT_COLUMNS = ("dataset", "section", "column_name", "metric", "value_double", "value_string")
# Sections that are lists of findings, and the metric that stands for one entry.
LIST_SECTIONS = {"missing": "count", "correlation": "r", "flag": None, "numeric": "mean"}


def _facts(frame: DataFrame, dataset: str, section: str, column: Column, metrics: dict[str, Column], text: Column | None = None) -> DataFrame:
    nothing = F.lit(None).cast("string")
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value_double"))
            for name, value in metrics.items()
        ]
    )
    return frame.select(
        F.lit(dataset).alias("dataset"),
        F.lit(section).alias("section"),
        column.alias("column_name"),
        (text if text is not None else nothing).alias("value_string"),
        F.inline(rows),
    ).select(*FACT_COLUMNS)


def _fact(keep: Column, section: str, metric: str, value: Column, whole_table: bool = False) -> Column:
    fact = F.struct(
        F.lit(section).alias("section"),
        (F.lit("") if whole_table else F.col("column_name")).alias("column_name"),
        F.lit(metric).alias("metric"),
        value.cast("double").alias("value_double"),
    )
    return F.when(keep, fact)


def _column_rows(df: DataFrame) -> DataFrame:
    """One row per column with everything the profile tells about it."""
    numbers = number_columns(df)
    skew_of = skew_measures(df)

    def measures(name):
        x = number(df, name) if name in numbers else F.lit(None).cast("double")
        return {
            "rows": F.count(F.lit(1)),
            "missing": F.count_if(missing(df, name)),
            "mean": F.avg(x),
            "std": F.stddev_samp(x),
            "min": F.min(x),
            "max": F.max(x),
            "skew": skew_of(name)["skew"] if name in numbers else F.avg(x),
        }

    rows = per_column(df, df.columns, measures).join(F.broadcast(distinct_counts(df)), "column_name")
    if not numbers:
        return rows.withColumn("median", F.lit(None).cast("double"))
    middle = medians(df, numbers).select("column_name", "median")
    return rows.join(F.broadcast(middle), "column_name", "left")


def profile(df: DataFrame, dataset: str) -> DataFrame:
    """Shape, missing, duplicates, strong correlations, flags and numeric summary of a table.

    Scans: one for counts and moments of all columns, one for (column, value)
    pairs, two for exact medians, two for correlations, two for duplicates.
    """
    numbers, texts = number_columns(df), text_columns(df)
    rows, gone, distinct = F.col("rows"), F.col("missing"), F.col("distinct")
    pct = gone * 100.0 / rows
    first = F.col("position") == 0
    some, holes = rows > 0, gone > 0
    is_number, is_text = F.col("column_name").isin(numbers), F.col("column_name").isin(texts)
    skewed = is_number & (rows >= 3) & (F.abs(finite(F.col("skew"))) > HIGH_SKEW)
    facts = [
        _fact(first, "shape", "rows", rows, True),
        _fact(first, "shape", "cols", F.lit(len(df.columns)), True),
        _fact(holes, "missing", "count", gone),
        _fact(holes, "missing", "pct", pct),
        _fact(holes, "missing", "high", (pct > HIGH_MISSING_PCT).cast("int")),
        _fact(some & (distinct == 1), "flag", "constant", distinct),
        _fact(some & (distinct == rows), "flag", "possible_id", rows),
        _fact(some & is_text & (distinct < LOW_CARDINALITY), "flag", "low_cardinality", distinct),
        _fact(skewed, "flag", "high_skew", F.col("skew")),
        *[_fact(is_number, "numeric", m, finite(F.col(m))) for m in ("mean", "std", "min", "max", "median")],
    ]
    listed = _column_rows(df).select(F.explode(F.array_compact(F.array(*facts))).alias("f")).select(
        F.lit(dataset).alias("dataset"), "f.*", F.lit(None).cast("string").alias("value_string")
    )
    repeated = {"count": F.col("duplicate_rows"), "pct": F.col("pct")}
    frames = [listed, _facts(duplicates(df), dataset, "duplicates", F.lit(""), repeated)]
    if len(numbers) >= 2:
        strong = strong_pairs(correlations(df))
        frames.append(_facts(strong, dataset, "correlation", F.col("col_a"), {"r": F.col("r")}, F.col("col_b")))
    return union_all(frames)


def section_counts(facts: DataFrame) -> DataFrame:
    """Findings per list section of a profile -> dataset, section, entries."""
    entry = F.lit(False)
    for section, metric in LIST_SECTIONS.items():
        here = F.col("section") == section
        entry = entry | (here if metric is None else here & (F.col("metric") == metric))
    return facts.where(entry).groupBy("dataset", "section").agg(F.count(F.lit(1)).alias("entries"))


def badge(facts: DataFrame) -> DataFrame:
    """One verdict per dataset -> dataset, badge."""
    dup = F.max(F.when((F.col("section") == "duplicates") & (F.col("metric") == "pct"), F.col("value_double")))
    gaps = F.count_if((F.col("section") == "missing") & (F.col("metric") == "count"))
    return facts.groupBy("dataset").agg(
        F.when(dup > 1, "Needs attention").when(gaps > 0, "Review missing").otherwise("Looks good").alias("badge")
    )


def _reason(df: DataFrame, dataset: str, section: str, reason: str) -> DataFrame:
    row = [(dataset, section, "", "skipped", None, reason)]
    return df.sparkSession.createDataFrame(
        row, "dataset string, section string, column_name string, metric string, value_double double, value_string string"
    )


def model_facts(df: DataFrame, dataset: str, key: Sequence[str]) -> DataFrame:
    """Anomalies, clusters and forecast of a table, or why there are none."""
    frames = []
    reason = anomaly.gate(df)
    if reason:
        frames.append(_reason(df, dataset, "anomalies", reason))
    else:
        worst = anomaly.top_anomalies(df, key)
        row = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
        frames.append(
            _facts(worst, dataset, "anomalies", row, {"score": F.col("score"), "severity": F.col("severity")}, F.col("reason"))
        )
    reason = cluster.gate(df)
    if reason:
        frames.append(_reason(df, dataset, "clusters", reason))
    else:
        report = cluster.cluster_report(cluster.cluster(df), number_columns(df))
        frames.append(_facts(report, dataset, "clusters", F.col("cluster").cast("string"), {"n": F.col("n")}, F.col("label")))
    ahead, reason = timeseries.forecast_table(df)
    if ahead is None:
        frames.append(_reason(df, dataset, "forecast", reason))
    else:
        values = {"value": F.col("value"), "lower": F.col("lower"), "upper": F.col("upper")}
        frames.append(_facts(ahead, dataset, "forecast", F.col("ts").cast("string"), values, F.col("kind")))
    return union_all(frames)
