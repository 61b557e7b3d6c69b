"""Missing values, NaN, constants, ties and empty tables."""

import math

import pytest
from pyspark.sql import functions as F

from facetwise.functions.values import number_columns
from facetwise.operators import analysis, charts, correlation, prep, profile, quantiles, schema
from facetwise.plans import reports

NAN, INF = float("nan"), float("inf")


def by_name(frame, value, key="column_name"):
    return {r[key]: r[value] for r in frame.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, 1.0, True, "x"), (2, NAN, 1.0, False, "y"), (3, 0.0, 1.0, None, "x"), (4, -0.0, 1.0, True, None), (5, INF, 1.0, True, "x")]
    return spark.createDataFrame(rows, "id bigint, d double, one double, b boolean, s string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("id < 0")


def test_two_numeric_predicates(odd):
    assert number_columns(odd) == ["id", "d", "one"]
    assert number_columns(odd, booleans=True) == ["id", "d", "one", "b"]


def test_nan_and_null_are_missing(odd):
    assert by_name(profile.missing(odd), "missing") == {"d": 2, "b": 1, "s": 1}


def test_distinct_counts_missing_once_and_zero_once(odd):
    # d: missing, 0, infinity
    assert by_name(profile.distinct_counts(odd), "distinct") == {"id": 5, "d": 3, "one": 1, "b": 3, "s": 3}
    assert by_name(profile.distinct_counts(odd, approx=True), "distinct") == {"id": 5, "d": 3, "one": 1, "b": 3, "s": 3}


def test_strict_cuts(spark):
    rows = [(None if i < 30 else i, None if i < 31 else i, None if i < 51 else i, None, i) for i in range(100)]
    frame = spark.createDataFrame(rows, "at30 int, at31 int, at51 int, gone int, full int")
    assert set(by_name(profile.high_missing(frame), "missing")) == {"at31", "at51", "gone"}
    assert prep.drop_sparse(frame).columns == ["at30", "at31", "full"]
    flags = {(r["column_name"], r["flag"]) for r in profile.flags(frame).collect()}
    assert ("gone", "constant") in flags and ("full", "possible_id") in flags


def test_half_missing_is_kept(spark):
    frame = spark.createDataFrame([(None,), (1,)], "a int")
    assert prep.drop_sparse(frame).columns == ["a"]


def test_infinity_becomes_null_in_summary(odd):
    row = {r["column_name"]: r for r in profile.numeric_summary(odd).collect()}["d"]
    assert row["max"] is None and row["mean"] is None and row["min"] == 0.0 and row["median"] == 0.0


def test_duplicates_fold_missing_and_zero(spark):
    rows = [(1.0, NAN), (1.0, None), (0.0, 2.0), (-0.0, 2.0), (3.0, 3.0)]
    found = profile.duplicates(spark.createDataFrame(rows, "a double, b double")).head()
    assert (found["rows"], found["duplicate_rows"], found["pct"]) == (5, 2, 40.0)


def test_duplicates_with_one_hot_row(spark):
    frame = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("a"))
    assert profile.duplicates(frame).head()["duplicate_rows"] == 999


def test_empty_table(empty):
    assert profile.missing(empty).count() == 0
    assert by_name(profile.missing_all(empty), "pct")["id"] == 0.0
    assert profile.duplicates(empty).head()["pct"] == 0.0
    assert by_name(profile.distinct_counts(empty), "distinct")["id"] == 0
    assert profile.flags(empty).count() == 0
    assert by_name(profile.numeric_summary(empty), "median")["id"] is None
    assert charts.histogram(empty, "d").count() == 0
    assert correlation.strong_pairs(correlation.correlations(empty)).count() == 0
    assert analysis.group_agg(empty, ["s"], {"m": ("d", "median")}).count() == 0
    facts = reports.profile(empty, "nothing")
    assert {r["metric"]: r["value_double"] for r in facts.where("section = 'shape'").collect()} == {"rows": 0.0, "cols": 5.0}


def test_constant_columns(spark):
    frame = spark.range(50).select("id", F.lit(0.1).alias("c"), (F.col("id") * 2.0).alias("twice"))
    pairs = {(r["col_a"], r["col_b"]): r["r"] for r in correlation.correlations(frame).collect()}
    assert pairs[("id", "c")] is None and pairs[("id", "twice")] == pytest.approx(1.0)
    assert by_name(correlation.importance(correlation.correlations(frame)), "score", "feature")["c"] == 0.0
    assert prep.scale(frame, ["c"]).agg(F.max(F.abs("c"))).head()[0] == pytest.approx(0.0, abs=1e-12)
    bins = charts.histogram(frame, "c").collect()
    assert sum(r["n"] for r in bins) == 50 and len(bins) == 20
    assert max(r["hi"] for r in bins) == pytest.approx(0.1 * 1.001)


def test_correlation_removes_missing_pair_by_pair(spark):
    rows = [(1.0, 2.0, None), (2.0, 4.1, 1.0), (3.0, None, 1.0), (4.0, 8.3, 1.0), (NAN, 1.0, 1.0), (5.0, 9.7, 1.0)]
    frame = spark.createDataFrame(rows, "a double, b double, c double")
    found = {(r["col_a"], r["col_b"]): r["r"] for r in correlation.correlations(frame).collect()}
    whole = frame.where("a is not null and not isnan(a) and b is not null").agg(F.corr("a", "b")).head()[0]
    assert found[("a", "b")] == pytest.approx(whole)
    assert found[("a", "c")] is None and found[("b", "c")] is None


def test_wide_and_narrow_correlation_agree(spark, monkeypatch):
    frame = spark.range(500).select(*[(F.rand(seed=i) + F.col("id") * i / 500).alias(f"c{i}") for i in range(6)])
    frame = frame.persist()
    narrow = {r["pair"]: r["r"] for r in correlation.correlations(frame).collect()}
    monkeypatch.setattr(correlation, "SUMS_PER_PASS", 1)
    wide = {r["pair"]: r["r"] for r in correlation.correlations(frame).collect()}
    assert narrow.keys() == wide.keys() and len(narrow) == 15
    for pair in narrow:
        assert narrow[pair] == pytest.approx(wide[pair], abs=1e-9)


@pytest.mark.parametrize("accuracy", [20, 1000])
def test_quantiles_equal_percentile(spark, accuracy):
    values = spark.range(0, 5000, 1, 7).select(
        (F.col("id") % 3).alias("k"),
        # A third of the rows share one value; the rest is heavily skewed.
        F.when(F.col("id") % 3 == 1, 7.0).otherwise(F.pow(F.lit(1.005), F.col("id"))).alias("x"),
        F.when(F.col("id") % 2 == 0, F.col("id").cast("double")).alias("y"),
    )
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 0.999, 1.0]
    found = {(r["column_name"], r["prob"]): r["quantile"] for r in quantiles.quantiles(values, ["x", "y"], probs, accuracy=accuracy).collect()}
    for name in ("x", "y"):
        exact = values.agg(F.percentile(name, F.array(*[F.lit(p) for p in probs]))).head()[0]
        assert [found[(name, p)] for p in probs] == pytest.approx(exact)
    grouped = {(r["k"], r["prob"]): r["quantile"] for r in quantiles.quantiles(values, ["x"], [0.5], ["k"], accuracy).collect()}
    for r in values.groupBy("k").agg(F.percentile("x", F.lit(0.5)).alias("m")).collect():
        assert grouped[(r["k"], 0.5)] == pytest.approx(r["m"])


def test_quantile_buckets_keep_ties_together(spark):
    frame = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 1, 1, 2, 3, 4, 5]], "x double")
    found = analysis.with_quantile_bucket(frame, F.col("x"), 4).distinct().collect()
    assert len({r["x"] for r in found}) == len(found)


def test_first_values_skip_missing_and_keep_order(spark):
    frame = spark.createDataFrame([(i, None if i % 2 else f"v{i}") for i in range(20)], "k int, s string")
    samples = by_name(schema.first_values(frame, ["s"], ["k"], 3, True), "samples")
    assert samples["s"] == ["v0", "v2", "v4"]


def test_column_stats_of_small_tables(spark):
    frame = spark.createDataFrame([(1.0, "x"), (2.0, "y"), (None, "z")], "a double, b string")
    a = profile.column_stats(frame, "a", ["b"]).head()
    assert (a["nulls"], float(a["min"]), float(a["max"])) == (1, 1.0, 2.0)
    b = profile.column_stats(frame, "b", ["b"]).head()
    assert (b["mean"], b["min"], b["max"]) == (None, "x", "z")
    with pytest.raises(ValueError, match="column not found"):
        profile.column_stats(frame, "nope", ["b"])


def test_sample_is_exact_and_repeatable(spark):
    frame = spark.range(20000)
    one = {r["id"] for r in schema.sample_rows(frame, ["id"], 100, 3).collect()}
    two = {r["id"] for r in schema.sample_rows(frame.repartition(5), ["id"], 100, 3).collect()}
    assert len(one) == 100 and one == two
    assert schema.sample_rows(frame.limit(7), ["id"], 100).count() == 7
    few = frame.withColumn("k", F.col("id") % 3)
    assert schema.sample_rows(few, ["k"], 50).count() == 50
    assert sorted(schema.sample_rows(few, ["k"], 50).collect()) == sorted(schema.sample_rows(few.repartition(7), ["k"], 50).collect())
    with pytest.raises(ValueError):
        schema.sample_rows(few, [], 5)


def test_json_safe_nested(spark):
    frame = spark.sql("SELECT array(1.0D, double('NaN')) AS a, named_struct('x', double('Infinity')) AS s, X'6869' AS b, DATE'2024-01-02' AS d, 1.50BD AS m")
    row = schema.json_safe(frame).head()
    assert row["a"] == [1.0, None] and row["s"]["x"] is None and row["b"] == "hi" and row["d"] == "2024-01-02" and row["m"] == 1.5


def test_record_table_shapes(spark):
    records = spark.createDataFrame([("A", 1), ("B", 2)], "x string, y bigint")
    points = charts.series(records, "x", "y").collect()
    assert [(r["x"], r["y"]) for r in points] == [("A", 1), ("B", 2)]
    assert schema.to_key_value(records).count() == 4
    best = charts.extremes(records).head()
    assert (best["high_label"], best["high"], best["low_label"], best["low"]) == ("B", 2.0, "A", 1.0)
    assert charts.metric_column(["city", "approval_rate", "n"]) == "approval_rate"


def test_pair_report(spark):
    corr = spark.createDataFrame([(0, "A", "B", 0.91), (1, "C", "D", -0.72)], correlation.PAIR_SCHEMA)
    found = correlation.pair_report(corr).collect()
    assert [(r["col_a"], r["direction"]) for r in found] == [("A", "positive"), ("C", "negative")]


def test_badges(spark):
    rows = [("a", "duplicates", "", "pct", 1.5, None), ("a", "missing", "x", "count", 1.0, None),
            ("b", "duplicates", "", "pct", 1.0, None), ("b", "missing", "x", "count", 1.0, None), ("c", "duplicates", "", "pct", 0.0, None)]
    facts = spark.createDataFrame(rows, "dataset string, section string, column_name string, metric string, value_double double, value_string string")
    assert by_name(reports.badge(facts), "badge", "dataset") == {"a": "Needs attention", "b": "Review missing", "c": "Looks good"}


def test_documented_sales_questions(spark):
    rows = [(1, "2024-01-01", "Ann", "pen", 2, 10, 0.1, "North"), (2, "2024-01-02", "Bob", "ink", 1, 50, 0.0, "South"),
            (3, "2024-02-03", "Ann", "pad", 4, 5, 0.2, "North"), (4, "2024-02-04", "Cid", "pen", 3, 10, 0.1, "East")]
    sales = spark.createDataFrame(rows, "id long, date string, customer string, product string, quantity long, price long, discount double, region string")
    spent = analysis.derived_sums(sales, ["customer"], F.col("quantity") * F.col("price"))
    assert by_name(spent, "total", "customer") == {"Ann": 40, "Bob": 50, "Cid": 30}
    assert analysis.top_n(spent, "total", 1, ["customer"]).head()["customer"] == "Bob"
    assert by_name(analysis.share_of_total(sales, ["region"], "quantity"), "share", "region")["North"] == pytest.approx(0.6)
    assert math.isclose(analysis.compare_groups(sales, ["region"], "discount").where("region = 'East'").head()["gap"], 0.0, abs_tol=1e-12)
