"""Registered queries: time series, anomalies and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetwise.operators import anomaly as G, cluster as U, timeseries as I
from facetwise.plans.inputs import EVENTS_SQL, events_with_gaps
from facetwise.plans.profile_queries import rounded
from facetwise.plans.registry import query, table

# --- time series ---

TEXT_DATES_SQL = """
td AS (SELECT o_orderkey, o_orderpriority, strftime(o_orderdate, '%m/%d/%Y') AS us_date,
              CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'soon' END AS rare_date,
              '2020' AS year, o_orderdate FROM orders)
"""


def text_dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderpriority",
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("us_date"),
        F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon").alias("rare_date"),
        F.lit("2020").alias("year"),
        "o_orderdate",
    )


@query(
    f"""
    WITH {TEXT_DATES_SQL}, c AS (
      SELECT 'o_orderpriority' AS column_name, 1 AS position, CAST(0 AS BIGINT) AS parsed, false AS varied FROM td
      UNION SELECT 'us_date', 2, count(try_strptime(us_date, '%m/%d/%Y')), count(DISTINCT us_date) > 2 FROM td
      UNION SELECT 'rare_date', 3, count(try_strptime(rare_date, '%Y-%m-%d')), count(DISTINCT rare_date) > 2 FROM td
      UNION SELECT 'year', 4, 0, false FROM td
      UNION SELECT 'o_orderdate', 5, count(o_orderdate), count(DISTINCT o_orderdate) > 2 FROM td),
    n AS (SELECT count(*) AS rows FROM td)
    SELECT column_name, position, parsed, rows, varied, parsed >= greatest(10, floor(rows * 0.5)) AND varied AS qualifies
    FROM c, n
    """
)
def date_columns(spark, sf_dir):
    return I.date_candidates(text_dates(spark, sf_dir))


@query(
    f"WITH {EVENTS_SQL}, v AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {i} AS position, var_samp({c}) AS variance, count(*) - count({c}) AS nulls FROM ev"
        for i, c in ((0, "event_id"), (2, "user_id"), (4, "value"))
    )
    + ") SELECT column_name, position, round(variance, 4) AS variance, nulls FROM v"
)
def forecast_targets(spark, sf_dir):
    return rounded(I.target_candidates(events_with_gaps(spark, sf_dir)), "variance", digits=4)


HOURLY_SQL = f"""
{EVENTS_SQL}, hourly AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS ts,
  avg(CASE WHEN hour(ts) % 6 <> 2 THEN value END) AS value FROM ev GROUP BY 1, 2)
"""


def hourly(spark, sf_dir):
    """Mean per hour and type (those without a type are a series too), some hours without values."""
    events = events_with_gaps(spark, sf_dir).withColumn("value", F.expr("CASE WHEN hour(ts) % 6 <> 2 THEN value END"))
    events = events.withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return I.to_series(events, "ts", "value", ["event_type"])


@query(f"WITH {HOURLY_SQL} SELECT event_type, ts, round(value, 6) AS value FROM hourly")
def collapsed_series(spark, sf_dir):
    return rounded(hourly(spark, sf_dir), "value")


# Four series per customer segment: daily, monthly, quarter ends, and irregular.
FREQ_SQL = """
base AS (SELECT DISTINCT date_trunc('day', o_orderdate)::TIMESTAMP AS d FROM orders),
kinds AS (
  SELECT 'daily' AS k, unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS ts FROM base
  UNION ALL SELECT 'weekly', unnest(generate_series(min(d), max(d), INTERVAL 7 DAY)) FROM base
  UNION ALL SELECT DISTINCT 'monthly', date_trunc('month', d)::TIMESTAMP FROM base
  UNION ALL SELECT DISTINCT 'year ends', (date_trunc('year', d) + INTERVAL 1 YEAR - INTERVAL 1 DAY)::TIMESTAMP FROM base
  UNION ALL SELECT DISTINCT 'irregular', (date_trunc('day', ts) + to_hours(hour(ts)) + to_minutes(minute(ts)))::TIMESTAMP
            FROM events)
"""


def mixed_series(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("d")).distinct()
    ends = days.agg(F.min("d").alias("a"), F.max("d").alias("b"))
    daily = ends.select(F.lit("daily").alias("k"), F.explode(F.expr("sequence(a, b, INTERVAL 1 DAY)")).alias("ts"))
    weekly = ends.select(F.lit("weekly").alias("k"), F.explode(F.expr("sequence(a, b, INTERVAL 7 DAYS)")).alias("ts"))
    month = F.date_trunc("month", "d").cast("timestamp_ntz")
    year_end = F.expr("cast(date_trunc('year', d) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS timestamp_ntz)")
    monthly = days.select(F.lit("monthly").alias("k"), month.alias("ts")).distinct()
    yearly = days.select(F.lit("year ends").alias("k"), year_end.alias("ts")).distinct()
    minute = F.date_trunc("minute", "ts").cast("timestamp_ntz")
    loose = table(spark, sf_dir, "events").select(F.lit("irregular").alias("k"), minute.alias("ts")).distinct()
    stamps = daily.unionByName(weekly).unionByName(monthly).unionByName(yearly).unionByName(loose)
    return stamps.withColumn("value", F.dayofyear("ts").cast("double"))


@query(
    f"""
    WITH {FREQ_SQL}, g AS (SELECT k, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY k ORDER BY ts)) AS gap FROM kinds),
    m AS (SELECT k, quantile_cont(CAST(gap AS DOUBLE), 0.5) AS median_gap FROM g GROUP BY k)
    SELECT k, count(*) AS points, min(ts) AS first_ts, max(ts) AS last_ts,
           CASE k WHEN 'monthly' THEN 'month_start' WHEN 'year ends' THEN 'month_end' WHEN 'irregular' THEN 'irregular'
                  ELSE 'fixed' END AS kind,
           CASE k WHEN 'daily' THEN 86400000000 WHEN 'weekly' THEN 604800000000 END AS step,
           CASE k WHEN 'monthly' THEN 1 WHEN 'year ends' THEN 12 END AS months,
           any_value(median_gap) AS median_gap,
           CASE k WHEN 'year ends' THEN 'yearly' WHEN 'irregular' THEN 'unknown' ELSE k END AS label
    FROM kinds JOIN m USING (k) GROUP BY k
    """
)
def series_frequencies(spark, sf_dir):
    return I.frequency(mixed_series(spark, sf_dir), ["k"])


FILLED_SQL = f"""
{HOURLY_SQL}, span AS (SELECT event_type, min(ts) AS a, max(ts) AS b FROM hourly GROUP BY 1),
grid AS (SELECT event_type, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM span),
j AS (SELECT g.event_type, g.ts, h.value, epoch_us(g.ts) AS us FROM grid g
      LEFT JOIN hourly h ON g.event_type IS NOT DISTINCT FROM h.event_type AND g.ts = h.ts),
w AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS pv,
             last_value(CASE WHEN value IS NOT NULL THEN us END IGNORE NULLS) OVER b AS pt,
             first_value(value IGNORE NULLS) OVER f AS nv,
             first_value(CASE WHEN value IS NOT NULL THEN us END IGNORE NULLS) OVER f AS nt
      FROM j WINDOW b AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    f AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT event_type, ts, coalesce(value, pv + (nv - pv) * (us - pt) / (nt - pt), pv, nv) AS value FROM w)
"""


@query(f"WITH {FILLED_SQL} SELECT event_type, ts, round(value, 6) AS value FROM filled")
def regular_hourly_grid(spark, sf_dir):
    series = hourly(spark, sf_dir)
    wanted = I.with_step(series, I.HOUR, ["event_type"])
    return rounded(I.regularise(series, ["event_type"], wanted), "value")


@query(
    f"""WITH {FILLED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS rank FROM filled)
        SELECT event_type, ts, round(value, 6) AS value, rank FROM r WHERE rank <= 30"""
)
def history_tail(spark, sf_dir):
    series = hourly(spark, sf_dir)
    full = I.regularise(series, ["event_type"], I.with_step(series, I.HOUR, ["event_type"]))
    tail = I.last_points(full, 30, ["event_type"])
    return rounded(tail.withColumn("rank", F.col("rank").cast("bigint")), "value")


@query(
    f"""
    WITH {FREQ_SQL}, last AS (SELECT k, max(ts) AS ts FROM kinds WHERE k <> 'irregular' GROUP BY k)
    SELECT k, i, CASE k WHEN 'daily' THEN ts + to_days(i::INT) WHEN 'weekly' THEN ts + to_days(7 * i::INT)
                        WHEN 'monthly' THEN ts + to_months(i::INT) ELSE last_day(ts + to_years(i::INT))::TIMESTAMP END AS ts
    FROM last, range(1, 11) t(i)
    """
)
def future_stamps(spark, sf_dir):
    freq = I.frequency(mixed_series(spark, sf_dir), ["k"]).where("k <> 'irregular'")
    ahead = freq.withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(10).cast("bigint"))))
    stamp = I.shifted(F.col("last_ts"), F.col("i"), F.col("kind"), F.col("step"), F.col("months"), F.col("median_gap"))
    return ahead.select("k", "i", stamp.alias("ts"))


@query()
def forecast_by_type(spark, sf_dir):
    series = hourly(spark, sf_dir)
    freq = I.with_step(series, I.HOUR, ["event_type"])
    return I.forecast(I.regularise(series, ["event_type"], freq), 10, ["event_type"], freq)


@query()
def forecast_of_table(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "value")
    return I.forecast_table(events)[0]


# --- anomalies ---

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINES_SQL = f"""
f AS (SELECT l_orderkey, l_linenumber, {', '.join(FEATURES)} FROM lineitem),
s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in FEATURES)} FROM f),
z AS (SELECT l_orderkey, l_linenumber, [{', '.join(
    f"struct_pack(a := abs(({c} - m_{c}) / s_{c}), i := {-i}, n := '{c}', z := ({c} - m_{c}) / s_{c})"
    for i, c in enumerate(FEATURES))}] AS zs FROM f, s),
x AS (SELECT l_orderkey, l_linenumber, list_reverse_sort(zs) AS zs FROM z)
"""


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *FEATURES)


@query(
    f"""
    WITH {LINES_SQL}
    SELECT l_orderkey, l_linenumber, round(zs[1].a, 6) AS severity, zs[1].n AS col_1, round(zs[1].z, 6) AS z_1,
           zs[2].n AS col_2, round(zs[2].z, 6) AS z_2, 'Most extreme: ' || zs[1].n || ', ' || zs[2].n AS reason FROM x
    """
)
def extreme_columns(spark, sf_dir):
    found = G.explain(G.z_scores(lines(spark, sf_dir), FEATURES))
    return rounded(
        found.select("l_orderkey", "l_linenumber", "severity", "col_1", "z_1", "col_2", "z_2", "reason"),
        "severity", "z_1", "z_2",
    )


def keyed_lines(spark, sf_dir):
    """Order and line do not identify rows in the test data; supplier and part complete the key."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(key.alias("line_id"), *FEATURES)


@query()
def anomalous_lines(spark, sf_dir):
    scored, _ = G.scored_rows(keyed_lines(spark, sf_dir), ["line_id"])
    return G.anomaly_counts(G.flag_anomalies(scored))


@query()
def worst_anomalies(spark, sf_dir):
    return G.top_anomalies(keyed_lines(spark, sf_dir), ["line_id"])


@query(
    f"""
    WITH s AS (SELECT o_orderkey, o_totalprice AS score FROM orders),
    c AS (SELECT quantile_cont(score, 0.05) AS cut FROM s)
    SELECT count(*) FILTER (WHERE score < cut) AS anomaly_count,
           round(100.0 * count(*) FILTER (WHERE score < cut) / count(*), 6) AS anomaly_pct FROM s, c
    """
)
def share_below_cut(spark, sf_dir):
    scored = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("score"))
    return rounded(G.anomaly_counts(G.flag_anomalies(scored)), "anomaly_pct")


# --- clusters ---

GIVEN_SQL = "c AS (SELECT CAST(l_linenumber % 3 AS INTEGER) AS cluster, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)"


def given_clusters(spark, sf_dir):
    """Line items with a given label as cluster."""
    return lines(spark, sf_dir).select((F.col("l_linenumber") % 3).cast("int").alias("cluster"), *FEATURES)


@query(f"WITH {GIVEN_SQL} SELECT cluster, count(*) AS n FROM c GROUP BY cluster")
def cluster_counts(spark, sf_dir):
    return U.cluster_sizes(given_clusters(spark, sf_dir))


@query(
    f"WITH {GIVEN_SQL} "
    + " UNION ALL ".join(
        f"SELECT cluster, '{c}' AS column_name, round(avg({c}), 6) AS mean FROM c GROUP BY cluster" for c in FEATURES
    )
)
def cluster_means(spark, sf_dir):
    return rounded(U.cluster_profile(given_clusters(spark, sf_dir), FEATURES).drop("position"), "mean")


DEVIATION_SQL = f"{GIVEN_SQL}, d AS (" + " UNION ALL ".join(
    f"SELECT cluster, '{c}' AS column_name, {i} AS position, (avg({c}) - any_value(o)) / greatest(abs(any_value(o)), 1e-9) AS deviation "
    f"FROM c, (SELECT avg({c}) AS o FROM c) GROUP BY cluster"
    for i, c in enumerate(FEATURES)
) + ")"


@query(f"WITH {DEVIATION_SQL} SELECT cluster, column_name, round(deviation, 6) AS deviation FROM d")
def cluster_deviations(spark, sf_dir):
    found = U.deviations(given_clusters(spark, sf_dir), FEATURES)
    return rounded(found.select("cluster", "column_name", "deviation"), "deviation")


@query(
    f"""
    WITH {DEVIATION_SQL},
    h AS (SELECT cluster, replace(column_name, '_', ' ') AS up FROM d
          QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY deviation DESC, position) = 1),
    l AS (SELECT cluster, replace(column_name, '_', ' ') AS down FROM d
          QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY deviation, position) = 1),
    n AS (SELECT cluster, count(*) AS n, format('l_quantity={{:.2f}}, l_extendedprice={{:,.2f}}, l_discount={{:.2f}}',
                 avg(l_quantity), avg(l_extendedprice), avg(l_discount)) AS means FROM c GROUP BY cluster)
    SELECT cluster, n, CASE WHEN up = down THEN 'Distinct ' || up ELSE 'High ' || up || ', low ' || down END AS label,
           CASE WHEN cluster = (SELECT cluster FROM n ORDER BY n DESC, cluster LIMIT 1) THEN means END AS example
    FROM n JOIN h USING (cluster) JOIN l USING (cluster)
    """
)
def labelled_clusters(spark, sf_dir):
    return U.cluster_report(given_clusters(spark, sf_dir), FEATURES)


@query(
    """
    WITH c AS (SELECT CAST(2 + p_size % 5 AS INTEGER) AS k, sum(p_retailprice) AS inertia FROM part GROUP BY 1),
    d AS (SELECT *, lag(inertia) OVER (ORDER BY k) AS before FROM c),
    e AS (SELECT *, CASE WHEN before > 0 THEN (before - inertia) / before END AS drop_share FROM d)
    SELECT k, round(inertia, 2) AS inertia, round(drop_share, 6) AS drop_share,
           k = coalesce((SELECT min(k) FROM e WHERE drop_share < 0.2), 4) AS chosen FROM e
    """
)
def elbow_rule(spark, sf_dir):
    costs = table(spark, sf_dir, "part").groupBy((2 + F.col("p_size") % 5).cast("int").alias("k"))
    found = U.choose_k(costs.agg(F.sum("p_retailprice").alias("inertia")))
    return rounded(rounded(found, "drop_share"), "inertia", digits=2)


@query()
def elbow_costs(spark, sf_dir):
    return U.elbow(lines(spark, sf_dir), columns=FEATURES)


@query()
def clustered_lines(spark, sf_dir):
    found = U.cluster(lines(spark, sf_dir), k=3, columns=FEATURES)
    return U.cluster_report(found, FEATURES)
