"""Registered queries: schema, profile and distinct-value operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetwise.functions.values import number_columns
from facetwise.operators import profile as P, schema as S
from facetwise.operators.quantiles import quantiles
from facetwise.plans.inputs import DOCS_SQL, EVENTS_SQL, ITEMS_SQL, docs, events_with_gaps, items, melted_sql
from facetwise.plans.registry import query, table

EV = ["event_id", "ts", "user_id", "event_type", "value"]
DOCS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic", "words"]
DOC_NUMBERS = ["doc_id", "n_chars", "quality", "toxic", "words"]
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]

MISSING_SQL = (
    f"WITH {EVENTS_SQL}, counted AS ("
    + melted_sql("ev", EV, "CAST(count(*) - count({c}) AS BIGINT) AS missing, count(*) AS rows")
    + "), m AS (SELECT *, 100.0 * missing / rows AS pct FROM counted) "
)


def rounded(df, *names, digits=6):
    for name in names:
        df = df.withColumn(name, F.round(name, digits))
    return df


@query(
    "WITH "
    + DOCS_SQL
    + ", firsts AS (SELECT * FROM docs ORDER BY doc_id LIMIT 3) "
    + melted_sql(
        "docs",
        DOCS,
        "CAST(count(*) - count({c}) AS BIGINT) AS null_count, count(*) AS row_count, "
        "(SELECT string_agg(coalesce(CAST({c} AS VARCHAR), '-'), '|' ORDER BY doc_id) FROM firsts) AS samples",
    )
)
def schema_payload(spark, sf_dir):
    found = S.describe_schema(docs(spark, sf_dir), ["doc_id"])
    joined = F.array_join(F.transform("samples", lambda v: F.coalesce(v, F.lit("-"))), "|")
    return found.select("column_name", "position", "null_count", "row_count", joined.alias("samples"))


@query(
    """
    SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 199) || '…' ELSE text END AS text
    FROM documents
    """
)
def truncated_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.truncate(F.col("text"), 200).alias("text"))


@query(
    """
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
             CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END AS ts,
           CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE value END AS value
    FROM events
    """
)
def json_safe_values(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.expr(
            "CASE WHEN event_id % 7 = 0 THEN double('NaN') WHEN event_id % 11 = 0 THEN double('Infinity') "
            "ELSE value END AS value"
        ),
    )
    return S.json_safe(raw)


@query(
    """
    SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS json
    FROM nation
    """
)
def json_rows(spark, sf_dir):
    return S.to_json_rows(table(spark, sf_dir, "nation"))


@query(
    """
    SELECT o_orderkey, o_totalprice FROM orders
    ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':7'), o_orderkey LIMIT 500
    """
)
def seeded_sample(spark, sf_dir):
    return S.sample_rows(table(spark, sf_dir, "orders"), ["o_orderkey"], 500, seed=7).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_custkey LIMIT 10")
def first_ten_rows(spark, sf_dir):
    return S.first_rows(table(spark, sf_dir, "customer"), ["c_custkey"], 10).select("c_custkey", "c_name", "c_acctbal")


@query(
    """
    SELECT 's_suppkey' AS key, CAST(s_suppkey AS VARCHAR) AS value FROM supplier
    UNION ALL SELECT 's_name', s_name FROM supplier
    UNION ALL SELECT 's_nationkey', CAST(s_nationkey AS VARCHAR) FROM supplier
    """
)
def key_value_rows(spark, sf_dir):
    return S.to_key_value(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"))


@query("SELECT count(*) AS rows, CAST(11 AS BIGINT) AS cols FROM lineitem")
def table_shape(spark, sf_dir):
    return P.shape(table(spark, sf_dir, "lineitem"))


@query(MISSING_SQL + "SELECT column_name, missing, round(pct, 6) AS pct FROM m WHERE missing > 0")
def missing_by_column(spark, sf_dir):
    return rounded(P.missing(events_with_gaps(spark, sf_dir)), "pct")


@query(MISSING_SQL + "SELECT column_name, missing, round(pct, 6) AS pct FROM m WHERE pct > 30")
def high_missing_columns(spark, sf_dir):
    return rounded(P.high_missing(events_with_gaps(spark, sf_dir)), "pct")


@query(
    MISSING_SQL
    + """SELECT CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(rows) AS BIGINT) AS cells,
                round(100.0 * sum(missing) / sum(rows), 6) AS pct FROM m"""
)
def missing_cells_overall(spark, sf_dir):
    return rounded(P.missing_cells(events_with_gaps(spark, sf_dir)), "pct")


@query(
    MISSING_SQL
    + """SELECT column_name, missing,
                format('Column ''{}'' has {:.1f}% missing values ({:,} rows).', column_name, pct, missing) AS note
         FROM m WHERE missing > 0 AND pct >= 1 ORDER BY missing DESC, position LIMIT 8"""
)
def missing_sentences(spark, sf_dir):
    return P.missing_notes(events_with_gaps(spark, sf_dir))


@query(MISSING_SQL + "SELECT column_name, missing FROM m WHERE missing > 0 ORDER BY missing DESC, position LIMIT 20")
def most_missing_columns(spark, sf_dir):
    return P.most_missing(events_with_gaps(spark, sf_dir))


@query(
    f"""
    WITH {ITEMS_SQL}, g AS (SELECT count(*) AS n FROM items GROUP BY ALL)
    SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
           round(100.0 * sum(n - 1) / sum(n), 6) AS pct FROM g
    """.replace("FROM items GROUP BY ALL", "FROM items GROUP BY l_quantity, l_discount, l_tax, l_returnflag, l_linestatus")
)
def duplicate_items(spark, sf_dir):
    return rounded(P.duplicates(items(spark, sf_dir)), "pct")


@query(
    f"""
    WITH {EVENTS_SQL}, w AS (SELECT user_id, event_type, value FROM ev),
    g AS (SELECT count(*) AS n FROM w GROUP BY user_id, event_type, value)
    SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
           round(100.0 * sum(n - 1) / sum(n), 6) AS pct FROM g
    """
)
def duplicate_events_with_gaps(spark, sf_dir):
    return rounded(P.duplicates(events_with_gaps(spark, sf_dir).drop("event_id", "ts")), "pct")


@query(
    melted_sql(
        "lineitem",
        LINE_NUMBERS,
        "round(avg({c}), 7) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, "
        "CAST(max({c}) AS DOUBLE) AS max, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median",
    ).join(["SELECT column_name, mean, std, min, max, median FROM (", ")"])
)
def numeric_columns(spark, sf_dir):
    found = P.numeric_summary(table(spark, sf_dir, "lineitem"))
    # Seven digits: with six, the mean of 60,000 two-digit decimals can lie exactly between two
    # roundings, and the order of summation would decide.
    return rounded(rounded(found, "std", "median"), "mean", digits=7)


@query(
    f"WITH {EVENTS_SQL} "
    + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, CAST({p} AS DOUBLE) AS prob, count({c}) AS n, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), {p}), 6) AS quantile FROM ev"
        for c in ("user_id", "value")
        for p in (0.05, 0.5, 0.9)
    )
)
def bracketed_quantiles(spark, sf_dir):
    """Coarse sketches on purpose, so that ranks come from narrowed brackets."""
    found = quantiles(events_with_gaps(spark, sf_dir), ["user_id", "value"], [0.05, 0.5, 0.9], accuracy=50)
    return rounded(found, "quantile")


@query(
    f"WITH {DOCS_SQL}, numbers AS ("
    + melted_sql(
        "docs",
        DOC_NUMBERS,
        "count({c}) AS \"count\", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
        "CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25, "
        "round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q50, "
        "round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75, CAST(max({c}) AS DOUBLE) AS max",
    )
    + "), vc AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c} AS v, count(*) AS n FROM docs WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in ("lang", "source")
    )
    + """), ranked AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, v) AS rk,
                              count(*) OVER (PARTITION BY column_name) AS u,
                              sum(n) OVER (PARTITION BY column_name) AS total FROM vc)
    SELECT column_name, "count", CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS top,
           CAST(NULL AS BIGINT) AS freq, mean, std, min, q25, q50, q75, max FROM numbers
    UNION ALL
    SELECT column_name, CAST(total AS BIGINT), u, v, n, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ranked WHERE rk = 1
    """
)
def describe_documents(spark, sf_dir):
    return rounded(P.describe_all(docs(spark, sf_dir)), "mean", "std", "q25", "q50", "q75")


@query(
    f"WITH {EVENTS_SQL}, base AS ("
    + melted_sql("ev", EV, "count({c}) AS non_null, CAST(count(*) - count({c}) AS BIGINT) AS nulls")
    + "), numbers AS ("
    + melted_sql(
        "ev",
        ["event_id", "user_id", "value"],
        'CAST(min({c}) AS DOUBLE) AS "min", CAST(max({c}) AS DOUBLE) AS "max", round(avg({c}), 6) AS "mean"',
    )
    + "), vc AS (SELECT coalesce(event_type, 'nan') AS v, count(*) AS n FROM ev GROUP BY 1), "
    + "best AS (SELECT 'event_type' AS column_name, v, n FROM vc ORDER BY n DESC, v LIMIT 1)"
    + """
    SELECT b.column_name, non_null, nulls,
           CASE WHEN b.column_name = 'event_type' THEN (SELECT count(DISTINCT event_type) FROM ev) END AS "unique",
           best.v AS top, best.n AS top_count, "min", "max", "mean"
    FROM base b LEFT JOIN numbers USING (column_name) LEFT JOIN best ON b.column_name = best.column_name
    WHERE b.column_name <> 'ts'
    """
)
def summarised_columns(spark, sf_dir):
    found = P.column_summary(events_with_gaps(spark, sf_dir).drop("ts"))
    return rounded(found.drop("dtype"), "mean")


@query(
    f"""
    WITH {EVENTS_SQL}
    SELECT round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max,
           count(*) - count(value) AS nulls,
           (SELECT string_agg(CAST(value AS VARCHAR), ', ' ORDER BY event_id)
            FROM (SELECT * FROM ev WHERE value IS NOT NULL ORDER BY event_id LIMIT 5)) AS samples
    FROM ev
    """
)
def stats_of_value(spark, sf_dir):
    found = P.column_stats(events_with_gaps(spark, sf_dir), "value", ["event_id"])
    found = found.withColumn("samples", F.array_join("samples", ", "))
    return rounded(found, "mean", "std").withColumns(
        {"min": F.col("min").cast("double"), "max": F.col("max").cast("double")}
    )


@query(
    """
    WITH vc AS (
      SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2
      UNION ALL
      SELECT 'o_orderpriority', CASE WHEN o_orderkey % 4 = 0 THEN 'nan' ELSE o_orderpriority END, count(*)
      FROM orders GROUP BY 2
      UNION ALL SELECT 'o_orderdate', CAST(o_orderdate AS VARCHAR), count(*) FROM orders GROUP BY 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank FROM vc)
    SELECT column_name, value, n, rank FROM r WHERE rank <= 8
    """
)
def frequent_values(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn(
        "o_orderpriority", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority"))
    )
    found = P.top_values(orders)
    return found.withColumn("rank", F.col("rank").cast("bigint"))


DISTINCT_SQL = f"WITH {DOCS_SQL}, counted AS (" + melted_sql(
    "docs",
    DOCS,
    "count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS \"distinct\", count(*) AS rows",
)


@query(DISTINCT_SQL + ') SELECT column_name, CAST("distinct" AS BIGINT) AS "distinct" FROM counted')
def distinct_values(spark, sf_dir):
    return P.distinct_counts(docs(spark, sf_dir))


@query(
    melted_sql("lineitem", LINE_NUMBERS, "round(skewness({c}), 6) AS skew").join(
        ["SELECT column_name, skew FROM (", ")"]
    )
)
def column_skews(spark, sf_dir):
    return rounded(P.skews(table(spark, sf_dir, "lineitem")).select("column_name", "skew"), "skew")


@query(
    DISTINCT_SQL
    + "), sk AS ("
    + melted_sql("docs", DOC_NUMBERS, "skewness({c}) AS skew")
    + """)
    SELECT column_name, 'constant' AS flag, CAST("distinct" AS DOUBLE) AS detail FROM counted WHERE "distinct" = 1
    UNION ALL SELECT column_name, 'possible_id', CAST(rows AS DOUBLE) FROM counted WHERE "distinct" = rows
    UNION ALL SELECT column_name, 'low_cardinality', CAST("distinct" AS DOUBLE) FROM counted
              WHERE "distinct" < 10 AND column_name IN ('lang', 'source')
    UNION ALL SELECT column_name, 'high_skew', round(skew, 6) FROM sk WHERE abs(skew) > 2
    """
)
def distribution_flags(spark, sf_dir):
    return rounded(P.flags(docs(spark, sf_dir)), "detail")
