"""Missing-value preparation and scaling.

What is learnt from the data here is one number per column, so it is fetched
once and put into the plan as constants.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from facetwise.functions.values import col, missing, number, number_columns, per_column, present, text_columns
from facetwise.operators.profile import frequent_texts
from facetwise.operators.quantiles import medians, scalar_values


def gap_shares(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Share of missing values per column (0 for an empty table). One pass."""
    if not columns:
        return {}
    found = per_column(df, columns, lambda name: {"share": F.avg(missing(df, name).cast("double"))})
    return {name: share or 0.0 for name, share in scalar_values(found, "column_name", "share").items()}


def drop_sparse(df: DataFrame, max_missing: float = 0.5, columns: Sequence[str] | None = None) -> DataFrame:
    """Leaves out numeric columns with a larger share missing (strictly) than ``max_missing``."""
    shares = gap_shares(df, list(columns) if columns is not None else number_columns(df))
    return df.select(*[col(c) for c in df.columns if shares.get(c, 0.0) <= max_missing])


def impute_median(df: DataFrame, columns: Sequence[str] | None = None, shares: dict[str, float] | None = None) -> DataFrame:
    """Numeric columns as doubles, missing values replaced by the exact median."""
    names = list(columns) if columns is not None else number_columns(df)
    # Only columns with gaps need a median.
    shares = gap_shares(df, names) if shares is None else shares
    holed = [name for name in names if shares[name] > 0]
    middle = scalar_values(medians(df, holed), "column_name", "median") if holed else {}
    filled = {
        name: F.coalesce(number(df, name), F.lit(middle[name])) if middle.get(name) is not None else number(df, name)
        for name in names
    }
    return df.select(*[filled.get(c, col(c)).alias(c) for c in df.columns])


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation (1 where it is 0) per column."""
    found = per_column(
        df, columns, lambda name: {"mean": F.avg(number(df, name)), "std": F.stddev_pop(number(df, name))}
    ).collect()
    return {r["column_name"]: (r["mean"] or 0.0, r["std"] or 1.0) for r in found}


def z_score(df: DataFrame, name: str, mean: float, std: float):
    return (number(df, name) - F.lit(float(mean))) / F.lit(float(std))


def scale(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric columns as (x - mean) / population deviation; a constant column becomes 0."""
    names = list(columns) if columns is not None else number_columns(df)
    if not names:
        return df
    learnt = moments(df, names)
    return df.select(*[z_score(df, c, *learnt[c]).alias(c) if c in learnt else col(c) for c in df.columns])


def learnt_fills(df: DataFrame, fills: Sequence[tuple]) -> dict[str, object]:
    """The values that ``("fill", column, how[, value])`` rules put in, by column; null where a column knows none. One job for
    all means, one for all medians, one for the modes of all text columns."""
    wanted: dict[str, list[str]] = {"constant": [], "mean": [], "median": [], "mode": []}
    for rule in fills:
        if rule[2] not in wanted:
            raise ValueError(f"unknown fill: {rule[2]}")
        wanted[rule[2]].append(rule[1])
    found = {rule[1]: rule[3] for rule in fills if rule[2] == "constant"}
    if wanted["mean"]:
        found |= scalar_values(per_column(df, wanted["mean"], lambda n: {"mean": F.avg(number(df, n))}), "column_name", "mean")
    if wanted["median"]:
        found |= scalar_values(medians(df, wanted["median"]), "column_name", "median")
    texts = [n for n in wanted["mode"] if n in text_columns(df)]
    if texts:
        found |= scalar_values(frequent_texts(df, texts), "column_name", "top")
    for name in set(wanted["mode"]) - set(texts):
        counts = df.where(~missing(df, name)).groupBy(col(name).alias("v")).count()
        best = counts.orderBy(F.desc("count"), "v").limit(1).head()
        found[name] = best["v"] if best else None
    return {rule[1]: found.get(rule[1]) for rule in fills}


def filled(df: DataFrame, name: str, value) -> Column:
    """The column with a value where it is missing; without a value as it is, NaN as null."""
    return present(df, name) if value is None else F.coalesce(present(df, name), F.lit(value))


def apply_fixes(df: DataFrame, rules: Sequence[tuple]) -> DataFrame:
    """Cleaning steps in order: ``("trim", column)``, ``("fill", column, "mean" | "median" | "mode" | "constant"[, value])``,
    ``("drop_rows", [columns])``, ``("drop_column", column)``, ``("drop_duplicates", [columns])``. Fills that follow one
    another are learnt together, from the table as it is before the first of them."""
    at = 0
    while at < len(rules):
        kind = rules[at][0]
        if kind == "fill":
            end = at
            while end < len(rules) and rules[end][0] == "fill" and rules[end][1] not in [r[1] for r in rules[at:end]]:
                end += 1
            values = learnt_fills(df, rules[at:end])
            df = df.select(*[filled(df, c, values[c]).alias(c) if c in values else col(c) for c in df.columns])
            at = end
            continue
        rule = rules[at]
        if kind == "trim":
            df = df.withColumn(rule[1], F.trim(col(rule[1])))
        elif kind == "drop_rows":
            for name in rule[1] or df.columns:
                df = df.where(~missing(df, name))
        elif kind == "drop_column":
            df = df.select(*[col(c) for c in df.columns if c != rule[1]])
        elif kind == "drop_duplicates":
            df = df.dropDuplicates(rule[1] or df.columns)
        else:
            raise ValueError(f"unknown rule: {kind}")
        at += 1
    return df
