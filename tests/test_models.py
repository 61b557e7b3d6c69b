"""Anomalies, clusters and time series."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from facetwise import kernels
from facetwise.operators import anomaly, cluster, timeseries
from facetwise.plans import reports


@pytest.fixture(scope="module")
def outliers(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.normal(size=3))) for i in range(200)]
    rows += [(1000 + i, *map(float, rng.normal(loc=12, size=3))) for i in range(10)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double")


def test_planted_outliers_are_found(outliers):
    worst = [r["id"] for r in anomaly.top_anomalies(outliers, ["id"]).collect()]
    assert len(worst) == 11 and sum(i >= 1000 for i in worst) == 10


def test_anomaly_share(outliers):
    scored, names = anomaly.scored_rows(outliers, ["id"])
    assert names == ["a", "b", "c"]
    counts = anomaly.anomaly_counts(anomaly.flag_anomalies(scored)).head()
    assert counts["anomaly_count"] == 11
    bounds = scored.agg(F.min("score"), F.max("score")).head()
    assert -1 < bounds[0] < bounds[1] < 0


def test_forest_repeats(outliers):
    table, names = anomaly.features(outliers, ["id"])
    one = anomaly.fit_forest(table, names, ["id"], trees=5).orderBy("tree", "node").collect()
    two = anomaly.fit_forest(table.repartition(3), names, ["id"], trees=5).orderBy("tree", "node").collect()
    assert one == two


def test_anomaly_gate(spark, outliers):
    assert anomaly.gate(outliers) is None
    assert anomaly.gate(outliers.limit(9)) == "Fewer than 10 rows"
    assert anomaly.gate(outliers.select(F.col("id").cast("string"))) == "No numeric columns"
    assert anomaly.gate(outliers.select(F.lit(None).cast("double").alias("x"))) == "All numeric columns have >50% missing"


def test_average_path():
    assert kernels.average_path([0, 1, 2]).tolist() == [0.0, 0.0, 1.0]
    assert float(kernels.average_path(256)) == pytest.approx(10.244, abs=1e-3)


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(2)
    centres = [(0, 0, 0), (20, 0, 5), (0, 20, 30)]
    rows = [(i, *(float(c + rng.normal()) for c in centres[i % 3])) for i in range(60)]
    return spark.createDataFrame(rows, "id int, high_x double, low_y double, z double")


def test_blobs_are_separated(blobs):
    names = ["high_x", "low_y", "z"]
    costs = cluster.elbow(blobs, columns=names).orderBy("k").collect()
    assert [r["k"] for r in costs] == [2, 3, 4, 5, 6] and sum(r["chosen"] for r in costs) == 1
    assert costs[1]["inertia"] < costs[0]["inertia"] * 0.8
    found = cluster.cluster(blobs, k=3, columns=names)
    pairs = found.select((F.col("id") % 3).alias("blob"), "cluster").distinct().collect()
    assert len(pairs) == 3
    assert sorted(r["n"] for r in cluster.cluster_sizes(found).collect()) == [20, 20, 20]
    report = cluster.cluster_report(found, names).collect()
    assert all("high x" in r["label"] or "low y" in r["label"] or " z" in r["label"] for r in report)
    assert sum(r["example"] is not None for r in report) == 1


def test_fits_share_their_passes_and_equal_the_library(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, *(float(x) for x in rng.uniform(0, 9, 3))) for i in range(600)]
    names = ["a", "b", "c"]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(3, "id")
    passes, moved = [], cluster._moved
    monkeypatch.setattr(cluster, "_moved", lambda blocks, models: passes.append(set(models)) or moved(blocks, models))
    costs = {r["k"]: r["inertia"] for r in cluster.elbow(df, columns=names).collect()}
    assert passes[0] == {2, 3, 4, 5, 6} and len(passes) <= 20

    scaled = df.select("id", *cluster._scaled(df, names))
    points = VectorAssembler(inputCols=scaled.columns[1:], outputCol="v").transform(scaled).select("id", "v")
    fits = {k: KMeans(k=k, seed=42, featuresCol="v").fit(points) for k in costs}
    assert costs == pytest.approx({k: m.summary.trainingCost for k, m in fits.items()})
    found = {r["id"]: r["cluster"] for r in cluster.cluster(df, k=3, columns=names).collect()}
    assert found == {r["id"]: r["prediction"] for r in fits[3].transform(points).collect()}


def test_elbow_rule(spark):
    def chosen(costs, k=4):
        frame = spark.createDataFrame(list(enumerate(costs, 2)), "k int, inertia double")
        return cluster.choose_k(frame, k).where("chosen").head()["k"]

    assert chosen([100.0, 70.0, 60.0, 30.0, 10.0]) == 4
    assert chosen([100.0, 70.0, 40.0, 20.0, 10.0]) == 4
    assert chosen([100.0, 70.0, 40.0, 20.0, 10.0], k=9) == 6


def test_cluster_gate(blobs):
    assert cluster.gate(blobs) is None
    assert cluster.gate(blobs.limit(49)) == "Fewer than 50 rows"
    assert cluster.gate(blobs.select("high_x", "z")) == "Fewer than 3 numeric columns"


def daily(spark, n, skip=()):
    rows = [(i, float(i)) for i in range(n) if i not in skip]
    return spark.createDataFrame(rows, "i int, value double").select(
        F.expr("cast(date_add(DATE'2024-01-01', i) AS timestamp_ntz)").alias("ts"), "value"
    )


def test_frequency_of_a_single_series(spark):
    row = timeseries.frequency(daily(spark, 20)).head()
    assert (row["kind"], row["step"], row["label"]) == ("fixed", timeseries.DAY, "daily")
    row = timeseries.frequency(daily(spark, 20, skip={3, 9})).head()
    assert (row["kind"], row["label"], row["median_gap"]) == ("irregular", "daily", timeseries.DAY)


def test_gaps_are_filled_in_time(spark):
    series = daily(spark, 20, skip={3, 9, 10})
    series = series.withColumn("value", F.when(~F.col("value").isin(0.0, 19.0), F.col("value")))
    full = timeseries.regularise(series, freq=timeseries.with_step(series, timeseries.DAY)).orderBy("ts").collect()
    assert [r["value"] for r in full] == [1.0] + [float(i) for i in range(1, 19)] + [18.0]


def test_irregular_series_keep_their_stamps(spark):
    series = daily(spark, 20, skip={3, 9}).withColumn("value", F.when(F.col("value") != 5, F.col("value")))
    full = timeseries.regularise(series).orderBy("ts").collect()
    assert len(full) == 18 and full[4]["value"] == 5.0


def test_date_columns(spark):
    rows = [(f"2024-01-{i + 1:02d}", f"{i + 1:02d}/01/2024" if i % 2 else "n/a", "2020", i) for i in range(12)]
    frame = spark.createDataFrame(rows, "iso string, half string, year string, n int")
    got = {r["column_name"]: (r["parsed"], r["qualifies"]) for r in timeseries.date_candidates(frame).collect()}
    assert got == {"iso": (12, True), "half": (6, False), "year": (0, False)}
    assert timeseries.find_date_column(frame) == "iso"
    assert timeseries.find_date_column(frame.select("n", "year")) is None


def test_arima_recovers_known_parameters():
    rng = np.random.default_rng(3)
    phis, thetas = [], []
    for _ in range(20):
        e = rng.normal(size=1200)
        w = np.zeros(1200)
        for t in range(1, 1200):
            w[t] = 0.6 * w[t - 1] + e[t] + 0.3 * e[t - 1]
        phi, theta, variance, _ = kernels.fit_arma(w)
        phis.append(phi)
        thetas.append(theta)
        assert variance == pytest.approx(1.0, abs=0.2)
    assert np.mean(phis) == pytest.approx(0.6, abs=0.05) and np.mean(thetas) == pytest.approx(0.3, abs=0.05)


def test_forecast_contract(spark):
    rng = np.random.default_rng(4)
    walk = np.cumsum(rng.normal(size=80))
    rows = [(k, i, float(v)) for k in ("a", "b") for i, v in enumerate(walk)] + [("short", i, 1.0) for i in range(5)]
    series = spark.createDataFrame(rows, "k string, i int, value double").select(
        "k", F.expr("cast(date_add(DATE'2024-01-01', i) AS timestamp_ntz)").alias("ts"), "value"
    )
    got = timeseries.forecast(series, 10, ["k"]).collect()
    ahead = [r for r in got if r["kind"] == "forecast"]
    assert sorted({r["k"] for r in ahead}) == ["a", "b"] and len(ahead) == 20
    assert all(r["lower"] < r["value"] < r["upper"] for r in ahead)
    assert min(str(r["ts"]) for r in ahead) == "2024-03-21 00:00:00"
    assert sum(r["kind"] == "history" and r["k"] == "a" for r in got) == 30


def residuals(w, phi, theta):
    e = np.zeros(len(w))
    for t in range(1, len(w)):
        e[t] = w[t] - phi * w[t - 1] - theta * e[t - 1]
    return e


def test_arma_fit_is_the_best_nearby_and_agrees_with_its_residuals():
    rng = np.random.default_rng(7)
    for n in (9, 30, 400):
        w = np.convolve(rng.normal(size=n + 2), [1.0, 0.7, 0.2], "valid")
        phi, theta, variance, last = kernels.fit_arma(w)
        own = residuals(w, phi, theta)
        assert variance == pytest.approx((own**2).sum() / (n - 1), rel=1e-9) and last == pytest.approx(own[-1], abs=1e-9)
        for a, b in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)):
            if max(abs(phi + a), abs(theta + b)) <= kernels.ARMA_BOUND:
                assert (residuals(w, phi + a, theta + b) ** 2).sum() >= (own**2).sum() - 1e-9
    assert kernels.fit_arma(np.zeros(20))[2] == 0


@pytest.mark.parametrize("size", [3, 50])
def test_forecast_of_blocks_equals_that_of_the_whole(spark, size):
    """Whatever the blocks, forecasts are those of a fit of the whole series; null keys are a series."""
    rng = np.random.default_rng(size)
    w = np.convolve(rng.normal(size=403), [1.0, 0.6, 0.3], "valid")
    series = {"a": np.cumsum(w), None: np.cumsum(w[::-1][:120]) + 5, "k": np.arange(11.0) ** 2, "short": np.arange(9.0)}
    rows = [(k, i, float(v)) for k, y in series.items() for i, v in enumerate(y)]
    frame = spark.createDataFrame(rows, "k0 string, i int, value double").select(
        F.col("k0").alias("seq"), F.expr("cast(date_add(DATE'2020-01-01', i) AS timestamp_ntz)").alias("ts"), "value"
    )
    got = timeseries.forecast(frame, 5, ["seq"], size=size).where("kind = 'forecast'").orderBy("ts").collect()
    assert len(got) == 15
    for k in ("a", None, "k"):
        mean, error = kernels.arima_forecast(series[k], 5)
        mine = [r for r in got if r["seq"] == k]
        assert [r["value"] for r in mine] == pytest.approx(mean.tolist(), abs=1e-6)
        assert [r["upper"] for r in mine] == pytest.approx((mean + kernels.NORMAL_975 * error).tolist(), abs=1e-6)


def test_long_series_is_many_tasks(spark):
    n = 200_000
    points = spark.range(n).select(F.timestamp_micros(F.col("id") * 1_000_000).cast("timestamp_ntz").alias("ts"), F.sin("id").alias("value"))
    packed, names = timeseries.blocks(points, size=1 << 14)
    assert packed.agg(F.sum("n")).first()[0] == n and packed.count() >= n >> 14
    assert packed.agg(F.max("n")).first()[0] <= 1 << 14


@pytest.mark.parametrize("size", [1, 3, 100])
def test_fill_through_blocks(spark, size):
    rng = np.random.default_rng(size)
    rows, want = [], {}
    for k in ("a", None, "none"):
        days = np.sort(rng.choice(400, 60, replace=False))
        value = np.where(rng.random(60) < (1.0 if k == "none" else 0.6), np.nan, rng.normal(size=60))
        rows += [(k, int(d), None if np.isnan(v) and d % 2 else float(v)) for d, v in zip(days, value)]
        known = ~np.isnan(value)
        for d, v in zip(days, np.interp(days, days[known], value[known]) if known.any() else value):
            want[k, int(d)] = v
    frame = spark.createDataFrame(rows, "key string, i int, value double").select(
        "key", "i", F.expr("cast(date_add(DATE'2020-01-01', i) AS timestamp_ntz)").alias("ts"), "value"
    )
    got = timeseries.fill(frame.drop("i"), ["key"], size=size).select("key", F.datediff("ts", F.lit("2020-01-01")).alias("i"), "value").collect()
    assert len(got) == len(want)
    for r in got:
        v = want[r["key"], r["i"]]
        assert r["value"] is None if np.isnan(v) else r["value"] == pytest.approx(v, abs=1e-12)
    assert timeseries.fill(frame.drop("i").limit(0), ["key"]).count() == 0


def test_gaps_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(timeseries, "BLOCK_POINTS", 3)
    days = [0, 1, 5, 6, 10, 40, 41, 80]
    frame = spark.createDataFrame([(k, d) for k in ("a", None) for d in days], "key string, i int").select(
        "key", F.expr("cast(date_add(DATE'2020-01-01', i) AS timestamp_ntz)").alias("ts")
    )
    got = timeseries.gaps(frame, ["key"]).groupBy("key").agg(F.sort_array(F.collect_list(F.col("gap") / timeseries.DAY)).alias("g")).collect()
    assert {r["key"]: r["g"] for r in got} == {k: sorted(np.diff(days).astype(float).tolist()) for k in ("a", None)}


def test_last_points(spark):
    series = daily(spark, 40)
    got = timeseries.last_points(series, 7).orderBy("rank").collect()
    assert [r["value"] for r in got] == [float(39 - i) for i in range(7)]


def test_model_facts_give_reasons(spark):
    small = spark.createDataFrame([(i, f"t{i}") for i in range(4)], "id int, t string")
    facts = reports.model_facts(small, "small", ["id"]).collect()
    assert {r["section"]: r["value_string"] for r in facts} == {
        "anomalies": "Fewer than 10 rows", "clusters": "Fewer than 50 rows", "forecast": "Not enough rows",
    }
