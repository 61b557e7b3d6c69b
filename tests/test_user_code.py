"""User code in mergeable parts: hot keys, null keys, empty tables, any grouping of the states."""

import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from facetwise.operators import udf

# Workers cannot import the tests.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "k string, n bigint, mean double, seen bigint"


def partial(pdf):
    return pdf.groupby("k", dropna=False)["v"].agg(n="size", total="sum").reset_index().assign(seen=len(pdf))


def merge(states):
    grouped = states.groupby("k", dropna=False).agg(n=("n", "sum"), total=("total", "sum"), seen=("seen", "max")).reset_index()
    return grouped.assign(seen=grouped["seen"].clip(lower=len(states)))


def finish(states):
    return pd.DataFrame({"k": states["k"], "n": states["n"], "mean": states["total"] / states["n"], "seen": states["seen"]})


def run(frame, **kwargs):
    return udf.apply_merged(frame, ["k"], partial, merge, finish, "n bigint, total double, seen bigint", SCHEMA, **kwargs)


@pytest.mark.parametrize("widths", [(1024, 32), (3,), ()])
def test_a_hot_key_is_merged_from_parts(spark, widths):
    key = F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('k', id % 50) END")
    frame = spark.range(0, 6000, 1, 24).select(key.alias("k"), F.col("id").cast("double").alias("v"))
    found = {r["k"]: (r["n"], round(r["mean"], 6)) for r in run(frame, widths=widths).collect()}
    plain = {r["k"]: (r["n"], round(r["m"], 6)) for r in frame.groupBy("k").agg(F.count("*").alias("n"), F.avg("v").alias("m")).collect()}
    assert found == plain and found["hot"][0] == found[None][0] == 2000


def test_no_call_sees_a_whole_group(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        frame = spark.range(0, 8000, 1, 8).select(F.lit("hot").alias("k"), F.lit(1.0).alias("v"))
        row = run(frame).head()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (row["n"], row["mean"]) == (8000, 1.0) and row["seen"] <= 100


def test_many_keys_pass_through_in_portions(spark, monkeypatch):
    monkeypatch.setattr(udf, "HELD_STATES", 50)
    frame = spark.range(0, 600, 1, 4).select(F.concat(F.lit("k"), (F.col("id") % 200).cast("string")).alias("k"), F.lit(2.0).alias("v"))
    rows = run(frame, widths=(2,)).collect()
    assert len(rows) == 200 and all((r["n"], r["mean"]) == (3, 2.0) for r in rows)


def test_no_rows(spark):
    assert run(spark.createDataFrame([], "k string, v double")).collect() == []
