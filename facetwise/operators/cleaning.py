"""Cleaning: what is wrong with a table, what could be done about it, and what that would change.

A plan has one row per issue. Its facts come from one pass over the table, one job for all medians and one
for all frequent texts; what reaches the driver is one row per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from facetwise.functions.values import as_text, col, dtype, missing, number, number_columns, per_column, present, text_columns
from facetwise.operators.prep import apply_fixes, filled, learnt_fills
from facetwise.operators.profile import HIGH_MISSING_PCT, HIGH_SKEW, duplicates, skew_measures

#: Columns with a larger part missing are left out rather than filled.
SPARSE_PCT = 50.0
UNKNOWN = "unknown"
PLAN = "issue_id string, kind string, column_name string, affected long, pct double, action string, fill_number double, fill_text string"
#: Texts are trimmed before values are filled in, and rows are compared last.
ORDER = ("padded_text", "missing_values", "undated_rows", "empty_column", "sparse_column", "constant_column", "duplicate_rows")


def _facts(df: DataFrame) -> dict:
    skewed = skew_measures(df)
    nothing = F.lit(None).cast("double")

    def measures(name):
        numeric, text = name in number_columns(df), name in text_columns(df)
        value = as_text(df, name)
        return {
            "rows": F.count(F.lit(1)),
            "missing": F.count_if(missing(df, name)),
            "skew": skewed(name)["skew"] if numeric else nothing,
            "padded": F.count_if(F.trim(col(name)) != col(name)) if text else F.lit(0).cast("long"),
            "one": F.coalesce(F.min(value) == F.max(value), F.lit(False)),
        }

    return {r["column_name"]: r for r in per_column(df, df.columns, measures).collect()}


def cleaning_plan(df: DataFrame) -> DataFrame:
    """-> issue_id, kind, column_name, affected, pct, action, fill_number, fill_text, in the order of application.

    Kinds: padded_text (trim); missing_values (fill with the median of a skewed and the mean of another numeric column,
    with the most frequent text or boolean, or with "unknown" where more than 30 % of a text column are missing); undated_rows
    (missing dates, times and other values: drop the rows); empty_column, sparse_column (numeric, more than half
    missing) and constant_column (drop the column); duplicate_rows (keep one of each). An id is the kind
    and the column. An empty table has no issues.
    """
    facts, numbers, texts = _facts(df), number_columns(df), text_columns(df)
    found, fills = [], []

    def issue(kind, name, affected, action):
        found.append((kind, name, affected, 100.0 * affected / facts[df.columns[0]]["rows"], action))

    for name in df.columns:
        r = facts.get(name)
        if r is None or not r["rows"]:
            continue
        gaps, pct = r["missing"], 100.0 * r["missing"] / r["rows"]
        if r["padded"]:
            issue("padded_text", name, r["padded"], "trim")
        if gaps == r["rows"]:
            issue("empty_column", name, gaps, "drop_column")
        elif name in numbers and pct > SPARSE_PCT:
            issue("sparse_column", name, gaps, "drop_column")
        elif gaps and name in numbers:
            how = "median" if abs(r["skew"] or 0.0) > HIGH_SKEW else "mean"
            issue("missing_values", name, gaps, f"fill_{how}")
            fills.append(("fill", name, how))
        elif gaps and (name in texts or isinstance(dtype(df, name), T.BooleanType)):
            rare = name in texts and pct > HIGH_MISSING_PCT
            issue("missing_values", name, gaps, "fill_constant" if rare else "fill_mode")
            fills.append(("fill", name, "constant", UNKNOWN) if rare else ("fill", name, "mode"))
        elif gaps:
            issue("undated_rows", name, gaps, "drop_rows")
        elif r["one"] and r["rows"] > 1:
            issue("constant_column", name, r["rows"], "drop_column")
    if facts and next(iter(facts.values()))["rows"]:
        again = duplicates(df).head()
        if again["duplicate_rows"]:
            issue("duplicate_rows", None, again["duplicate_rows"], "drop_duplicates")
    # Texts count as they are after trimming, which comes first.
    trimmed = apply_fixes(df, [("trim", n) for k, n, *_ in found if k == "padded_text"])
    values = learnt_fills(trimmed, fills)
    rows = []
    for kind, name, affected, pct, action in sorted(found, key=lambda x: (ORDER.index(x[0]), df.columns.index(x[1]) if x[1] else 0)):
        value = values.get(name) if kind == "missing_values" else None
        is_number = isinstance(value, (int, float)) and not isinstance(value, bool)
        text = None if value is None or is_number else str(value).lower() if isinstance(value, bool) else str(value)
        rows.append((f"{kind}:{name}" if name else kind, kind, name, affected, pct, action, float(value) if is_number else None, text))
    return df.sparkSession.createDataFrame(rows, PLAN)


def fixes(df: DataFrame, plan: DataFrame, issue_ids: Sequence[str] | None = None) -> list[tuple]:
    """The rules of ``apply_fixes`` for some issues of a plan (all without ids), in its order, with the values
    the plan has learnt. Unknown ids are an error."""
    rows = plan.collect()
    unknown = set(issue_ids or ()) - {r["issue_id"] for r in rows}
    if unknown:
        raise ValueError(f"no such issues: {sorted(unknown)}")
    rules = []
    for r in rows:
        if issue_ids is not None and r["issue_id"] not in issue_ids:
            continue
        name = r["column_name"]
        if r["action"].startswith("fill"):
            value = r["fill_number"] if r["fill_text"] is None else r["fill_text"]
            if isinstance(dtype(df, name), T.BooleanType):
                value = value == "true"
            rules.append(("fill", name, "constant", value))
        else:
            rules.append({"drop_duplicates": ("drop_duplicates", []), "drop_rows": ("drop_rows", [name])}.get(r["action"], (r["action"], name)))
    return rules


def apply_cleaning(df: DataFrame, plan: DataFrame, issue_ids: Sequence[str] | None = None) -> DataFrame:
    """The table with the chosen issues of its plan mended."""
    return apply_fixes(df, fixes(df, plan, issue_ids))


def preview(df: DataFrame, rules: Sequence[tuple]) -> DataFrame:
    """What rules would change, without changing it -> column_name, rows_before, rows_after, missing_before, missing_after,
    mean_before, mean_after, stays. All rules in one pass, after one job for each kind of value to learn.

    Trimming and fills come before rows are dropped. Equal rows are counted by the plan, not here. Means are of numeric
    columns; a column that goes has no figures after.
    """
    for rule in rules:
        if rule[0] not in ("trim", "fill", "drop_rows", "drop_column", "drop_duplicates"):
            raise ValueError(f"unknown rule: {rule[0]}")
    trims = {r[1] for r in rules if r[0] == "trim"}
    gone = {r[1] for r in rules if r[0] == "drop_column"}
    trimmed = apply_fixes(df, [("trim", n) for n in trims])
    values = learnt_fills(trimmed, [r for r in rules if r[0] == "fill"])
    after = {n: filled(trimmed, n, values[n]) if n in values else present(trimmed, n) for n in df.columns}
    kept = F.lit(True)
    for rule in rules:
        if rule[0] == "drop_rows":
            for name in rule[1] or df.columns:
                kept = kept & after[name].isNotNull()
    nothing = F.lit(None).cast("double")

    def measures(name):
        numeric, stays = name in number_columns(df), name not in gone
        left = lambda agg, kind: agg.cast(kind) if stays else F.lit(None).cast(kind)
        return {
            "rows_before": F.count(F.lit(1)),
            "rows_after": F.count_if(kept),
            "missing_before": F.count_if(missing(df, name)),
            "missing_after": left(F.count_if(kept & after[name].isNull()), "long"),
            "mean_before": F.avg(number(df, name)) if numeric else nothing,
            "mean_after": left(F.avg(F.when(kept, after[name].cast("double"))), "double") if numeric else nothing,
            "stays": F.lit(stays),
        }

    return per_column(trimmed, df.columns, measures).drop("position")
