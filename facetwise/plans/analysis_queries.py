"""Registered queries: grouping, ranking, buckets, periods and preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetwise.operators import analysis as A, cleaning as L, prep as R
from facetwise.plans.inputs import DOCS_SQL, EVENTS_SQL, docs, events_with_gaps
from facetwise.plans.profile_queries import rounded
from facetwise.plans.registry import query, table


@query(
    """
    SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, sum(l_quantity) AS quantity,
           round(avg(l_extendedprice), 6) AS price_mean, round(quantile_cont(l_extendedprice, 0.5), 6) AS price_median,
           min(l_discount) AS discount_min, max(l_tax) AS tax_max
    FROM lineitem GROUP BY l_returnflag, l_linestatus
    """
)
def grouped_measures(spark, sf_dir):
    found = A.group_agg(
        table(spark, sf_dir, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        {
            "n": ("l_quantity", "count"),
            "quantity": ("l_quantity", "sum"),
            "price_mean": ("l_extendedprice", "mean"),
            "price_median": ("l_extendedprice", "median"),
            "discount_min": ("l_discount", "min"),
            "tax_max": ("l_tax", "max"),
        },
    )
    return rounded(found, "price_mean", "price_median")


@query(
    f"""WITH {EVENTS_SQL} SELECT user_id, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS middle
        FROM ev GROUP BY user_id"""
)
def median_per_user(spark, sf_dir):
    found = A.group_agg(
        events_with_gaps(spark, sf_dir), ["user_id"], {"n": ("value", "count"), "middle": ("value", "median")}
    )
    return rounded(found, "middle")


@query("SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def part_type_counts(spark, sf_dir):
    return A.value_counts(table(spark, sf_dir, "part"), "p_type", 5)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_orders(spark, sf_dir):
    return A.top_n(table(spark, sf_dir, "orders"), "o_totalprice", 10, ["o_orderkey"]).select(
        "o_orderkey", "o_totalprice"
    )


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10")
def bottom_customers(spark, sf_dir):
    return A.bottom_n(table(spark, sf_dir, "customer"), "c_acctbal", 10, ["c_custkey"]).select("c_custkey", "c_acctbal")


@query(
    """
    SELECT * FROM (SELECT o_orderpriority, o_orderkey, o_totalprice,
      row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
    WHERE rank <= 3
    """
)
def top_orders_per_priority(spark, sf_dir):
    found = A.top_n(table(spark, sf_dir, "orders"), "o_totalprice", 3, ["o_orderkey"], per=["o_orderpriority"])
    return found.select("o_orderpriority", "o_orderkey", "o_totalprice", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT count(*) FILTER (WHERE l_discount >= 0.05 AND l_quantity < 10) AS n, count(*) AS rows FROM lineitem")
def count_of_discounted(spark, sf_dir):
    return A.count_where(table(spark, sf_dir, "lineitem"), (F.col("l_discount") >= 0.05) & (F.col("l_quantity") < 10))


@query(
    """
    SELECT o_orderpriority, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS rate
    FROM orders GROUP BY 1
    """
)
def rate_by_priority(spark, sf_dir):
    return rounded(A.rate_by(table(spark, sf_dir, "orders"), ["o_orderpriority"], F.col("o_orderstatus") == "F"), "rate")


@query(
    """
    WITH b AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part),
    x AS (SELECT p.*, (SELECT count(*) FROM range(1, 5) t(i), b WHERE p_retailprice > b.lo + i * ((b.hi - b.lo) / 5)) + 1
                 AS bucket FROM part p)
    SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS n, round(avg(p_size), 6) AS metric FROM x GROUP BY 1
    """
)
def equal_width_buckets(spark, sf_dir):
    return rounded(A.bucket_equal_width(table(spark, sf_dir, "part"), "p_retailprice", 5, F.avg("p_size")), "metric")


@query(
    f"""
    WITH {DOCS_SQL},
    e AS (SELECT quantile_cont(CAST(n_chars AS DOUBLE), 0.25) AS a, quantile_cont(CAST(n_chars AS DOUBLE), 0.5) AS b,
                 quantile_cont(CAST(n_chars AS DOUBLE), 0.75) AS c FROM docs),
    x AS (SELECT docs.*, 1 + (n_chars > a)::INT + (n_chars > b)::INT + (n_chars > c)::INT AS bucket FROM docs, e)
    SELECT bucket, count(*) AS n, CAST(min(n_chars) AS BIGINT) AS lo, CAST(max(n_chars) AS BIGINT) AS hi,
           round(avg(quality), 6) AS metric FROM x GROUP BY bucket
    """
)
def quantile_buckets(spark, sf_dir):
    return rounded(A.bucket_quantile(docs(spark, sf_dir), F.col("n_chars"), 4, F.avg("quality")), "metric")


@query(
    """
    WITH r AS (SELECT o_totalprice / c_acctbal AS x, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey),
    e AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.5) AS b, quantile_cont(x, 0.75) AS c FROM r),
    x AS (SELECT r.*, 1 + (x > a)::INT + (x > b)::INT + (x > c)::INT AS bucket FROM r, e)
    SELECT bucket, count(*) AS n, round(min(x), 4) AS lo, round(max(x), 4) AS hi,
           round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS metric FROM x GROUP BY bucket
    """
)
def rate_by_ratio_quartile(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    found = A.ratio_buckets(joined, "o_totalprice", "c_acctbal", F.col("o_orderstatus") == "F")
    return rounded(rounded(found, "metric"), "lo", "hi", digits=4)


MONTHS_SQL = """
m AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, count(*) AS n, avg(o_totalprice) AS price
      FROM orders GROUP BY 1)
"""


def months(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return A.by_period(
        orders, "o_orderdate", "month", {"n": F.count(F.lit(1)), "price": F.avg("o_totalprice")}
    )


@query(f"WITH {MONTHS_SQL} SELECT period, n, round(price, 6) AS price FROM m")
def orders_by_month(spark, sf_dir):
    return rounded(months(spark, sf_dir), "price")


@query(
    f"""
    WITH {MONTHS_SQL}, c AS (SELECT *, lag(n) OVER (ORDER BY period) AS previous FROM m)
    SELECT period, n, previous, n - previous AS change, round((n - previous) * 100.0 / previous, 6) AS pct,
           CASE WHEN n > previous THEN 'increase' WHEN n < previous THEN 'decrease' WHEN n = previous THEN 'flat' END
             AS direction
    FROM c
    """
)
def change_by_month(spark, sf_dir):
    return rounded(A.change_by_period(months(spark, sf_dir).drop("price"), "n"), "pct")


@query(
    """
    SELECT l_returnflag, sum(l_quantity) AS total, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (), 6) AS share
    FROM lineitem GROUP BY l_returnflag
    """
)
def share_by_flag(spark, sf_dir):
    return rounded(A.share_of_total(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity"), "share")


@query(
    """
    WITH o AS (SELECT avg(c_acctbal) AS overall FROM customer)
    SELECT c_mktsegment, count(c_acctbal) AS n, round(avg(c_acctbal), 6) AS mean, round(any_value(overall), 6) AS overall,
           round(avg(c_acctbal) - any_value(overall), 6) AS gap FROM customer, o GROUP BY 1
    """
)
def segments_against_overall(spark, sf_dir):
    return rounded(
        A.compare_groups(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal"), "mean", "overall", "gap"
    )


@query(
    """
    SELECT l_suppkey, count(*) AS n, round(sum(l_quantity * l_extendedprice) / 1000, 3) AS total
    FROM lineitem GROUP BY l_suppkey
    """
)
def quantity_times_price(spark, sf_dir):
    found = A.derived_sums(
        table(spark, sf_dir, "lineitem"), ["l_suppkey"], F.col("l_quantity") * F.col("l_extendedprice")
    )
    return found.withColumn("total", F.round(F.col("total") / 1000, 3))


@query(f"WITH {DOCS_SQL} SELECT doc_id, lang, source, n_chars, words FROM docs")
def without_sparse_columns(spark, sf_dir):
    return R.drop_sparse(docs(spark, sf_dir))


IMPUTED_SQL = f"""
{EVENTS_SQL}, med AS (SELECT quantile_cont(CAST(user_id AS DOUBLE), 0.5) AS u, quantile_cont(value, 0.5) AS v FROM ev),
imp AS (SELECT CAST(event_id AS DOUBLE) AS event_id, coalesce(user_id, u) AS user_id, coalesce(value, v) AS value
        FROM ev, med)
"""


@query(f"WITH {IMPUTED_SQL} SELECT event_id, round(user_id, 6) AS user_id, round(value, 6) AS value FROM imp")
def median_imputed(spark, sf_dir):
    gaps = events_with_gaps(spark, sf_dir).select("event_id", "user_id", "value")
    return rounded(R.impute_median(gaps), "user_id", "value")


@query(
    f"""
    WITH {IMPUTED_SQL}, s AS (SELECT avg(user_id) AS mu, stddev_pop(user_id) AS su, avg(value) AS mv,
                                     stddev_pop(value) AS sv FROM imp)
    SELECT event_id, round((user_id - mu) / su, 6) AS user_id, round((value - mv) / sv, 6) AS value, 0.0 AS one
    FROM imp, s
    """
)
def standard_scaled(spark, sf_dir):
    gaps = events_with_gaps(spark, sf_dir).select("event_id", "user_id", "value")
    filled = R.impute_median(gaps).withColumn("one", F.lit(1.0))
    return rounded(R.scale(filled, ["user_id", "value", "one"]), "user_id", "value")


@query(
    f"""
    WITH {EVENTS_SQL},
    mode AS (SELECT event_type AS t FROM ev WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    a AS (SELECT avg(value) AS v FROM ev)
    SELECT DISTINCT user_id, coalesce(event_type, t) AS event_type, round(coalesce(value, v), 6) AS value
    FROM ev, mode, a WHERE user_id IS NOT NULL
    """
)
def cleaned_events(spark, sf_dir):
    fixed = R.apply_fixes(
        events_with_gaps(spark, sf_dir),
        [
            ("fill", "event_type", "mode"),
            ("fill", "value", "mean"),
            ("drop_rows", ["user_id"]),
            ("drop_duplicates", ["user_id", "event_type", "value"]),
        ],
    )
    return rounded(fixed.select("user_id", "event_type", "value"), "value")


# All rows of events with every kind of issue; every 20th row twice.
MESSY_SQL = """
once AS (SELECT event_id, CASE WHEN event_id % 9 > 0 THEN ts END AS happened, CASE WHEN event_id % 5 > 0 THEN user_id END AS user_id,
                CASE WHEN event_id % 7 > 0 THEN value END AS value, CASE WHEN event_id % 7 > 0 THEN value * value * value END AS cubed,
                CASE WHEN event_id % 10 > 6 THEN value END AS rare, 'x' AS same, NULL::DOUBLE AS nothing,
                CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 4 = 0 THEN ' ' || event_type ELSE event_type END AS kind,
                CASE WHEN event_id % 2 = 0 THEN event_type END AS half FROM events),
messy AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE event_id % 20 = 0)
"""


def messy(spark, sf_dir):
    once = table(spark, sf_dir, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 9 > 0 THEN ts END AS happened", "CASE WHEN event_id % 5 > 0 THEN user_id END AS user_id",
        "CASE WHEN event_id % 7 > 0 THEN value END AS value", "CASE WHEN event_id % 7 > 0 THEN value * value * value END AS cubed",
        "CASE WHEN event_id % 10 > 6 THEN value ELSE double('NaN') END AS rare", "'x' AS same", "CAST(NULL AS DOUBLE) AS nothing",
        "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 4 = 0 THEN ' ' || event_type ELSE event_type END AS kind",
        "CASE WHEN event_id % 2 = 0 THEN event_type END AS half",
    )
    return once.unionByName(once.where("event_id % 20 = 0"))


@query(
    f"""
    WITH {MESSY_SQL}, n AS (SELECT count(*) AS rows FROM messy),
    top AS (SELECT trim(kind) AS t FROM messy WHERE kind IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    i AS (
      SELECT 'padded_text' AS kind, 'kind' AS c, count(*) FILTER (kind <> trim(kind)) AS affected, 'trim' AS action,
             NULL::DOUBLE AS fill_number, NULL AS fill_text FROM messy
      UNION ALL SELECT 'missing_values', 'user_id', count(*) - count(user_id), 'fill_mean', avg(user_id), NULL FROM messy
      UNION ALL SELECT 'missing_values', 'value', count(*) - count(value),
                       CASE WHEN abs(skewness(value)) > 2 THEN 'fill_median' ELSE 'fill_mean' END,
                       CASE WHEN abs(skewness(value)) > 2 THEN quantile_cont(value, 0.5) ELSE avg(value) END, NULL FROM messy
      UNION ALL SELECT 'missing_values', 'cubed', count(*) - count(cubed),
                       CASE WHEN abs(skewness(cubed)) > 2 THEN 'fill_median' ELSE 'fill_mean' END,
                       CASE WHEN abs(skewness(cubed)) > 2 THEN quantile_cont(cubed, 0.5) ELSE avg(cubed) END, NULL FROM messy
      UNION ALL SELECT 'missing_values', 'kind', count(*) - count(kind), 'fill_mode', NULL, (SELECT t FROM top) FROM messy
      UNION ALL SELECT 'missing_values', 'half', count(*) - count(half), 'fill_constant', NULL, 'unknown' FROM messy
      UNION ALL SELECT 'undated_rows', 'happened', count(*) - count(happened), 'drop_rows', NULL, NULL FROM messy
      UNION ALL SELECT 'empty_column', 'nothing', count(*), 'drop_column', NULL, NULL FROM messy
      UNION ALL SELECT 'sparse_column', 'rare', count(*) - count(rare), 'drop_column', NULL, NULL FROM messy
      UNION ALL SELECT 'constant_column', 'same', count(*), 'drop_column', NULL, NULL FROM messy
      UNION ALL SELECT 'duplicate_rows', NULL, (SELECT rows FROM n) - count(*), 'drop_duplicates', NULL, NULL FROM (SELECT DISTINCT * FROM messy))
    SELECT kind || coalesce(':' || c, '') AS issue_id, kind, c AS column_name, affected, round(100.0 * affected / rows, 6) AS pct,
           action, round(fill_number, 4) AS fill_number, fill_text FROM i, n
    """
)
def cleaning_plan(spark, sf_dir):
    return rounded(rounded(L.cleaning_plan(messy(spark, sf_dir)), "pct"), "fill_number", digits=4)


PREVIEW_RULES = [
    ("trim", "kind"), ("fill", "value", "mean"), ("fill", "cubed", "median"), ("fill", "kind", "mode"), ("fill", "half", "constant", "unknown"),
    ("drop_rows", ["happened", "user_id"]), ("drop_column", "nothing"),
]


@query(
    f"""
    WITH {MESSY_SQL}, v AS (SELECT avg(value) AS value, quantile_cont(cubed, 0.5) AS cubed FROM messy),
    top AS (SELECT trim(kind) AS t FROM messy WHERE kind IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    f AS (SELECT m.event_id, m.happened, m.user_id, coalesce(m.value, v.value) AS value, coalesce(m.cubed, v.cubed) AS cubed, m.rare, m.same, m.nothing,
                 coalesce(trim(m.kind), t) AS kind, coalesce(m.half, 'unknown') AS half
          FROM messy m, v, top WHERE m.happened IS NOT NULL AND m.user_id IS NOT NULL),
    """
    + "b AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS rows_before, count(*) - count({c}) AS missing_before, "
        f"{f'avg({c})' if c in ('event_id', 'user_id', 'value', 'cubed', 'rare', 'nothing') else 'NULL::DOUBLE'} AS mean_before FROM messy"
        for c in ("event_id", "happened", "user_id", "value", "cubed", "rare", "same", "nothing", "kind", "half")
    ) + "), a AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS rows_after, {'NULL::BIGINT' if c == 'nothing' else f'count(*) - count({c})'} AS missing_after, "
        f"{f'avg({c})' if c in ('event_id', 'user_id', 'value', 'cubed', 'rare') else 'NULL::DOUBLE'} AS mean_after FROM f"
        for c in ("event_id", "happened", "user_id", "value", "cubed", "rare", "same", "nothing", "kind", "half")
    )
    + """) SELECT column_name, rows_before, rows_after, missing_before, missing_after, round(mean_before, 4) AS mean_before,
                  round(mean_after, 4) AS mean_after, column_name <> 'nothing' AS stays FROM a JOIN b USING (column_name)"""
)
def cleaning_preview(spark, sf_dir):
    return rounded(L.preview(messy(spark, sf_dir), PREVIEW_RULES), "mean_before", "mean_after", digits=4)


@query(
    f"""
    WITH {MESSY_SQL}, top AS (SELECT trim(kind) AS t FROM messy WHERE kind IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT DISTINCT event_id, happened, user_id, round(value, 6) AS value, round(cubed, 6) AS cubed, coalesce(trim(kind), t) AS kind, half, rare
    FROM messy, top WHERE happened IS NOT NULL
    """
)
def cleaned_by_plan(spark, sf_dir):
    """Some issues of the plan, by their ids."""
    df = messy(spark, sf_dir)
    ids = ["duplicate_rows", "undated_rows:happened", "padded_text:kind", "missing_values:kind", "constant_column:same", "empty_column:nothing"]
    fixed = L.apply_cleaning(df, L.cleaning_plan(df), ids)
    return rounded(fixed.withColumn("rare", F.nanvl("rare", F.lit(None).cast("double"))), "value", "cubed")
