"""Cleaning plans: odd tables, choices by id, and previews that agree with what is applied."""

import pytest
from pyspark.sql import functions as F

from facetwise.operators import cleaning, prep

SCHEMA = "a double, b string, c boolean, d timestamp_ntz, e int, f string"


def table(spark):
    rows = [
        (1.0, " x", True, "2024-01-01", 7, None), (float("nan"), "x", None, None, 7, "u"), (None, None, True, "2024-01-02", 7, None),
        (3.0, "y ", False, "2024-01-03", 7, None), (3.0, "y ", False, "2024-01-03", 7, None),
    ]
    return spark.createDataFrame(rows, SCHEMA.replace("timestamp_ntz", "string")).withColumn("d", F.col("d").cast("timestamp_ntz"))


def test_plan_of_every_kind(spark):
    plan = {r["issue_id"]: r for r in cleaning.cleaning_plan(table(spark)).collect()}
    assert list(plan) == [
        "padded_text:b", "missing_values:a", "missing_values:b", "missing_values:c", "missing_values:f", "undated_rows:d", "constant_column:e", "duplicate_rows",
    ]
    assert plan["missing_values:a"]["fill_number"] == pytest.approx(7 / 3) and plan["missing_values:a"]["action"] == "fill_mean"
    assert plan["missing_values:b"]["fill_text"] == "x"  # after trimming x and y are as frequent
    assert plan["missing_values:c"]["fill_text"] == "false" and plan["missing_values:f"]["fill_text"] == "unknown"


def test_applied_by_id_and_previewed(spark):
    df = table(spark)
    plan = cleaning.cleaning_plan(df)
    whole = cleaning.apply_cleaning(df, plan)
    assert whole.columns == ["a", "b", "c", "d", "f"] and whole.count() == 3
    assert whole.where("a IS NULL OR b IS NULL OR c IS NULL OR d IS NULL OR f IS NULL").count() == 0
    some = cleaning.apply_cleaning(df, plan, ["padded_text:b"])
    assert sorted(r["b"] or "" for r in some.collect()) == ["", "x", "x", "y", "y"]
    with pytest.raises(ValueError):
        cleaning.apply_cleaning(df, plan, ["missing_values:nothing"])

    rules = [r for r in cleaning.fixes(df, plan) if r[0] != "drop_duplicates"]
    fixed = prep.apply_fixes(df, rules)
    for r in cleaning.preview(df, rules).collect():
        assert r["rows_before"] == 5 and r["rows_after"] == fixed.count()
        assert r["stays"] == (r["column_name"] in fixed.columns)
        if r["stays"]:
            assert r["missing_after"] == 0
    assert fixed.agg(F.avg("a")).first()[0] == pytest.approx(next(r["mean_after"] for r in cleaning.preview(df, rules).collect() if r["column_name"] == "a"))


def test_tables_without_rows_columns_or_known_values(spark):
    df = table(spark)
    assert cleaning.cleaning_plan(df.limit(0)).count() == 0
    assert cleaning.cleaning_plan(spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")).count() == 0
    gone = spark.createDataFrame([(None, None)] * 3, "x double, y string")
    assert [r["kind"] for r in cleaning.cleaning_plan(gone).collect()] == ["empty_column", "empty_column", "duplicate_rows"]
    assert prep.apply_fixes(gone, [("fill", "x", "mean"), ("fill", "y", "mode")]).where("x IS NULL AND y IS NULL").count() == 3
    with pytest.raises(ValueError):
        prep.apply_fixes(df, [("fill", "a", "guess")])
    with pytest.raises(ValueError):
        cleaning.preview(df, [("polish", "a")])
