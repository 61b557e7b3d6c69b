"""Registered queries: correlation and chart data."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from facetwise.operators import charts as H, correlation as C
from facetwise.plans.inputs import DOCS_SQL, EVENTS_SQL, docs, events_with_gaps
from facetwise.plans.profile_queries import DOC_NUMBERS, LINE_NUMBERS, rounded
from facetwise.plans.registry import query, table


def pairs_sql(source: str, names: list[str]) -> str:
    """The upper triangle; DuckDB gives NaN for constants, which counts as no value."""
    return "\nUNION ALL\n".join(
        f"SELECT {i} AS pair, '{a}' AS col_a, '{b}' AS col_b, "
        f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END AS r FROM {source}"
        for i, (a, b) in enumerate(combinations(names, 2))
    )


LINE_PAIRS = f"WITH pairs AS ({pairs_sql('lineitem', LINE_NUMBERS)})"
DOC_PAIRS = f"WITH {DOCS_SQL}, pairs AS ({pairs_sql('docs', DOC_NUMBERS)})"
# A constant column has no correlation with anything.
CONSTANT_SQL = "cust AS (SELECT c_custkey, c_nationkey, c_acctbal, 1 AS one FROM customer)"
CONSTANT_PAIRS = f"WITH {CONSTANT_SQL}, pairs AS ({pairs_sql('cust', ['c_custkey', 'c_nationkey', 'c_acctbal', 'one'])})"


def with_constant(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return customer.withColumn("one", F.lit(1))


@query(LINE_PAIRS + " SELECT pair, col_a, col_b, round(r, 6) AS r FROM pairs")
def correlation_pairs(spark, sf_dir):
    return rounded(C.correlations(table(spark, sf_dir, "lineitem")), "r")


@query(CONSTANT_PAIRS + " SELECT pair, col_a, col_b, round(r, 6) AS r FROM pairs")
def correlation_with_constant(spark, sf_dir):
    return rounded(C.correlations(with_constant(spark, sf_dir)), "r")


@query(
    DOC_PAIRS
    + """ SELECT pair, col_a, col_b, round(r, 6) AS r FROM pairs
          WHERE abs(r) > 0.5 ORDER BY abs(r) DESC, pair LIMIT 5"""
)
def strong_correlations(spark, sf_dir):
    return rounded(C.strong_pairs(C.correlations(docs(spark, sf_dir))), "r")


@query(
    f"WITH {DOCS_SQL}, pairs AS ({pairs_sql('docs', DOC_NUMBERS)}), sym AS ("
    "SELECT col_a AS a, col_b AS b, r FROM pairs UNION ALL SELECT col_b, col_a, r FROM pairs) "
    "SELECT a, b, round(r, 3) AS r FROM sym UNION ALL "
    + " UNION ALL ".join(f"SELECT '{c}', '{c}', 1.0" for c in DOC_NUMBERS)
)
def correlation_heatmap(spark, sf_dir):
    return C.heatmap(docs(spark, sf_dir))


@query(
    f"WITH {DOCS_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, "
        + ", ".join("1.0 AS " + b if a == b else f"round(corr({a}, {b}), 3) AS {b}" for b in DOC_NUMBERS)
        + " FROM docs"
        for a in DOC_NUMBERS
    )
)
def correlation_matrix_wide(spark, sf_dir):
    return C.wide_heatmap(C.heatmap(docs(spark, sf_dir)), DOC_NUMBERS)


@query(
    LINE_PAIRS
    + " SELECT pair, col_a, col_b, round(r, 6) AS r FROM pairs WHERE r IS NOT NULL ORDER BY abs(r) DESC, pair LIMIT 10"
)
def strongest_ten_pairs(spark, sf_dir):
    return rounded(C.top_pairs(C.correlations(table(spark, sf_dir, "lineitem"))), "r")


@query(
    CONSTANT_PAIRS
    + """, sym AS (SELECT col_a AS feature, r FROM pairs UNION ALL SELECT col_b, r FROM pairs)
        SELECT feature, round(coalesce(sum(abs(r)), 0) / (count(r) + 1), 6) AS score FROM sym GROUP BY feature
        ORDER BY score DESC LIMIT 10"""
)
def feature_importance(spark, sf_dir):
    return rounded(C.importance(C.correlations(with_constant(spark, sf_dir))), "score")


@query(
    DOC_PAIRS
    + " SELECT col_a, col_b, round(r, 6) AS r FROM pairs WHERE r <> 0 ORDER BY abs(r) DESC, pair LIMIT 1"
)
def strongest_pair(spark, sf_dir):
    return rounded(C.best_pair(C.correlations(docs(spark, sf_dir))), "r")


@query(
    DOC_PAIRS
    + """, sym AS (SELECT col_a AS feature, col_b AS partner, r, pair FROM pairs
                    UNION ALL SELECT col_b, col_a, r, pair FROM pairs)
        SELECT partner, round(r, 6) AS r FROM sym WHERE feature = 'quality' AND r <> 0
        ORDER BY abs(r) DESC, pair LIMIT 1"""
)
def partner_of_quality(spark, sf_dir):
    return rounded(C.best_partner(C.correlations(docs(spark, sf_dir)), "quality"), "r")


@query(
    DOC_PAIRS
    + """, sym AS (SELECT col_a AS feature, col_b AS partner, r, pair FROM pairs
                    UNION ALL SELECT col_b, col_a, r, pair FROM pairs),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY abs(r) DESC, pair) AS rk
                   FROM sym WHERE r <> 0)
        SELECT feature, partner, round(r, 6) AS r FROM ranked WHERE rk = 1"""
)
def partners_of_all(spark, sf_dir):
    return rounded(C.best_partners(C.correlations(docs(spark, sf_dir))), "r")


@query(
    DOC_PAIRS
    + """ SELECT col_a, col_b, round(r, 6) AS r, round(abs(r), 6) AS abs_r,
                 CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS direction
          FROM pairs WHERE abs(r) > 0.2 ORDER BY abs(r) DESC, pair LIMIT 5"""
)
def pair_directions(spark, sf_dir):
    return rounded(C.pair_report(C.correlations(docs(spark, sf_dir)), cut=0.2), "r", "abs_r")


@query(
    f"WITH {EVENTS_SQL} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean,
            round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median,
            CAST(min({c}) AS DOUBLE) AS "min", CAST(max({c}) AS DOUBLE) AS "max" FROM ev"""
        for c in ("user_id", "value")
    )
)
def histogram_statistics(spark, sf_dir):
    return rounded(H.hist_stats(events_with_gaps(spark, sf_dir), ["user_id", "value"]), "mean", "median")


def histogram_sql(source: str, name: str, bins: int) -> str:
    return f"""
    b AS (SELECT CAST(min({name}) AS DOUBLE) AS lo, CAST(max({name}) AS DOUBLE) AS hi FROM {source}),
    r AS (SELECT CASE WHEN lo = hi THEN lo - CASE WHEN lo = 0 THEN 0.001 ELSE abs(lo) * 0.001 END ELSE lo END AS lo,
                 CASE WHEN lo = hi THEN hi + CASE WHEN hi = 0 THEN 0.001 ELSE abs(hi) * 0.001 END ELSE hi END AS hi,
                 CASE WHEN lo = hi THEN 0 ELSE (hi - lo) * 0.001 END AS pad FROM b),
    edges AS (SELECT CAST(i AS INTEGER) AS bin,
                     CASE WHEN i = 1 THEN lo - pad ELSE lo + (i - 1) * ((hi - lo) / {bins}) END AS lo,
                     CASE WHEN i = {bins} THEN hi ELSE lo + i * ((hi - lo) / {bins}) END AS hi
              FROM r, range(1, {bins + 1}) t(i))
    SELECT bin, round(e.lo, 6) AS lo, round(e.hi, 6) AS hi, count(s.{name}) AS n
    FROM edges e LEFT JOIN {source} s ON s.{name} > e.lo AND s.{name} <= e.hi
    GROUP BY bin, e.lo, e.hi
    """


@query("WITH " + histogram_sql("lineitem", "l_extendedprice", 20))
def price_histogram(spark, sf_dir):
    return rounded(H.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice"), "lo", "hi")


@query(f"WITH {EVENTS_SQL}, " + histogram_sql("ev", "value", 20))
def value_histogram_with_gaps(spark, sf_dir):
    return rounded(H.histogram(events_with_gaps(spark, sf_dir), "value"), "lo", "hi")


@query(f"WITH {CONSTANT_SQL}, " + histogram_sql("cust", "one", 20))
def constant_histogram(spark, sf_dir):
    return rounded(H.histogram(with_constant(spark, sf_dir), "one"), "lo", "hi")


@query(
    f"""WITH {EVENTS_SQL} SELECT coalesce(event_type, 'nan') AS value, count(*) AS n FROM ev
        GROUP BY 1 ORDER BY n DESC, value LIMIT 10"""
)
def frequent_event_types(spark, sf_dir):
    return H.top_categories(events_with_gaps(spark, sf_dir), "event_type")


@query(
    f"""WITH {DOCS_SQL}
    SELECT doc_id, CAST(n_chars AS DOUBLE) AS x, CAST(words AS DOUBLE) AS y,
           (SELECT round(corr(n_chars, words), 6) FROM docs) AS r
    FROM docs ORDER BY md5(CAST(doc_id AS VARCHAR) || ':0'), doc_id LIMIT 300"""
)
def scatter_points(spark, sf_dir):
    frame = docs(spark, sf_dir)
    x, y = H.choose_pair(frame)
    return rounded(H.scatter(frame, x, y, ["doc_id"], 300), "r")


@query("SELECT o_orderkey AS x, o_totalprice AS y FROM orders ORDER BY o_orderkey")
def chart_series(spark, sf_dir):
    return H.series(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice")


@query(
    """
    WITH g AS (SELECT o_orderpriority, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS done_rate
               FROM orders GROUP BY 1)
    SELECT 'done_rate' AS metric,
           (SELECT o_orderpriority FROM g ORDER BY done_rate DESC, o_orderpriority LIMIT 1) AS high_label,
           round(max(done_rate), 6) AS high,
           (SELECT o_orderpriority FROM g ORDER BY done_rate, o_orderpriority LIMIT 1) AS low_label,
           round(min(done_rate), 6) AS low FROM g
    """
)
def highest_and_lowest_rate(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    rates = orders.groupBy("o_orderpriority").agg(
        F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("done_rate")
    )
    return rounded(H.extremes(rates), "high", "low")
