"""Registered queries: combined profile, files, streams and user code."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from facetwise.operators import catalog as K
from facetwise.operators.udf import apply_merged, apply_table
from facetwise.plans import reports
from facetwise.plans.inputs import DOCS_SQL, EVENTS_SQL, docs, events_with_gaps, melted_sql
from facetwise.plans.profile_queries import DOC_NUMBERS, DOCS, rounded
from facetwise.plans.registry import query, table
from facetwise.plans.relation_queries import pairs_sql
from facetwise.plans.search_queries import LOG_SQL, question_log
from facetwise.session import scratch_path
from facetwise.sources.tables import export, load_table, read_table, save_table
from facetwise.streaming import jobs

_MEASURES = {
    "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})",
    "median": "quantile_cont(CAST({c} AS DOUBLE), 0.5)",
}
PROFILE_SQL = f"""
WITH {DOCS_SQL}, base AS (
{melted_sql("docs", DOCS, 'count(*) - count({c}) AS missing, count(*) AS rows, count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS "distinct"')}
), sk AS ({melted_sql("docs", DOC_NUMBERS, "skewness({c}) AS skew")}),
pairs AS ({pairs_sql("docs", DOC_NUMBERS)}),
dup AS (SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM docs)) AS extra FROM docs),
facts AS (
  SELECT 'shape' AS section, '' AS column_name, 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value_double, NULL AS value_string FROM docs
  UNION ALL SELECT 'shape', '', 'cols', {len(DOCS)}, NULL
  UNION ALL SELECT 'missing', column_name, 'count', missing, NULL FROM base WHERE missing > 0
  UNION ALL SELECT 'missing', column_name, 'pct', 100.0 * missing / rows, NULL FROM base WHERE missing > 0
  UNION ALL SELECT 'missing', column_name, 'high', CASE WHEN 100.0 * missing / rows > 30 THEN 1 ELSE 0 END, NULL FROM base WHERE missing > 0
  UNION ALL SELECT 'duplicates', '', 'count', extra, NULL FROM dup
  UNION ALL SELECT 'duplicates', '', 'pct', 100.0 * extra / rows, NULL FROM dup
  UNION ALL SELECT 'flag', column_name, 'constant', "distinct", NULL FROM base WHERE "distinct" = 1
  UNION ALL SELECT 'flag', column_name, 'possible_id', rows, NULL FROM base WHERE "distinct" = rows
  UNION ALL SELECT 'flag', column_name, 'low_cardinality', "distinct", NULL FROM base WHERE "distinct" < 10 AND column_name IN ('lang', 'source')
  UNION ALL SELECT 'flag', column_name, 'high_skew', skew, NULL FROM sk WHERE abs(skew) > 2
  UNION ALL SELECT * FROM (SELECT 'correlation', col_a, 'r', r, col_b FROM pairs WHERE abs(r) > 0.5 ORDER BY abs(r) DESC, pair LIMIT 5)
  {" ".join(f"UNION ALL SELECT 'numeric', '{c}', '{m}', {sql.format(c=c)}, NULL FROM docs" for c in DOC_NUMBERS for m, sql in _MEASURES.items())}
)
"""


def document_facts(spark, sf_dir):
    return reports.profile(docs(spark, sf_dir), "documents")


@query(
    PROFILE_SQL
    + """SELECT 'documents' AS dataset, section, column_name, metric, round(value_double, 5) AS value_double,
                CAST(value_string AS VARCHAR) AS value_string FROM facts"""
)
def combined_profile(spark, sf_dir):
    return rounded(document_facts(spark, sf_dir), "value_double", digits=5)


@query(
    PROFILE_SQL
    + """SELECT 'documents' AS dataset, section, count(*) AS entries FROM facts
         WHERE section = 'flag' OR (section, metric) IN (('missing', 'count'), ('correlation', 'r'), ('numeric', 'mean'))
         GROUP BY section"""
)
def profile_entries(spark, sf_dir):
    return reports.section_counts(document_facts(spark, sf_dir))


@query(
    PROFILE_SQL
    + """SELECT 'documents' AS dataset, CASE WHEN max(value_double) FILTER (WHERE section = 'duplicates' AND metric = 'pct') > 1
         THEN 'Needs attention' WHEN count(*) FILTER (WHERE section = 'missing') > 0 THEN 'Review missing'
         ELSE 'Looks good' END AS badge FROM facts"""
)
def profile_badge(spark, sf_dir):
    return reports.badge(document_facts(spark, sf_dir))


@query(
    PROFILE_SQL
    + """SELECT 'documents' AS dataset, section, count(*) AS n FROM facts WHERE section <> 'missing' GROUP BY section"""
)
def stored_profile(spark, sf_dir):
    """A profile is stored twice; a section that has emptied since leaves nothing behind."""
    root = scratch_path(spark, "facts")
    facts = document_facts(spark, sf_dir)
    K.put_facts(facts, root, ["documents"])
    K.put_facts(facts.where("section <> 'missing'"), root, ["documents"])
    return K.stored_facts(spark, root).groupBy("dataset", "section").agg(F.count(F.lit(1)).alias("n"))


@query()
def model_report(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", F.length("props").alias("size"))
    return reports.model_facts(events, "events", ["event_id"])


# --- files ---


@query(
    f"""WITH {EVENTS_SQL} SELECT event_id, user_id, event_type, value, event_id % 2 = 0 AS even FROM ev"""
)
def csv_round_trip(spark, sf_dir):
    """A table written as CSV and read back with inferred types."""
    path = scratch_path(spark, "csv")
    gaps = events_with_gaps(spark, sf_dir).drop("ts").withColumn("even", F.col("event_id") % 2 == 0)
    # Several missing-value texts in one column.
    texts = gaps.withColumn("user_id", F.coalesce(F.col("user_id").cast("string"), F.element_at(F.array(F.lit("NA"), F.lit("N/A"), F.lit("null")), (F.col("event_id") % 3 + 1).cast("int"))))
    export(texts, path, "csv")
    return read_table(spark, path)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def stored_table(spark, sf_dir):
    root = scratch_path(spark, "tables")
    save_table(table(spark, sf_dir, "nation"), root, "nation")
    return load_table(spark, root, "nation")


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def json_export(spark, sf_dir):
    path = scratch_path(spark, "json")
    export(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), path)
    return spark.read.schema("p_partkey bigint, p_name string, p_retailprice double").json(path)


# --- streams ---


@query(
    f"WITH {EVENTS_SQL} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS missing, round(avg({c}), 6) AS mean,
            round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS "min", CAST(max({c}) AS DOUBLE) AS "max",
            round(skewness({c}), 6) + 0.0 AS skew FROM ev"""
        for c in ("event_id", "user_id", "value")
    )
)
def streamed_profile(spark, sf_dir):
    """The events table cut into files, streamed a few files at a time."""
    found = rounded(streamed_facts(spark, sf_dir), "mean", "std", "skew")
    return found.withColumn("skew", F.col("skew") + 0.0).drop("distinct", "median")


@query()
def streamed_estimates(spark, sf_dir):
    """Distinct values and the median of streamed columns, from stored sketches."""
    return streamed_facts(spark, sf_dir).select("column_name", "distinct", "median")


def streamed_facts(spark, sf_dir):
    """The running profile of the events table, streamed a few files at a time."""
    landing, root = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-facts")
    frame = events_with_gaps(spark, sf_dir)
    frame.repartition(6, "event_id").write.parquet(landing)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 2).parquet(landing)
    jobs.stream_profile(stream, root, scratch_path(spark, "stream-checkpoint")).awaitTermination()
    return jobs.running_profile(spark, root)


@query(f"WITH {LOG_SQL} SELECT id, dataset_id, question FROM log")
def streamed_log(spark, sf_dir):
    """Log entries arriving twice are kept once."""
    landing, root = scratch_path(spark, "log-in"), scratch_path(spark, "log")
    entries = question_log(spark, sf_dir).select("id", "dataset_id", "question", F.col("created_at").cast("timestamp"))
    entries.unionByName(entries).write.parquet(landing)
    stream = spark.readStream.schema(entries.schema).parquet(landing)
    jobs.stream_log(stream, root, scratch_path(spark, "log-checkpoint"), "3650 days").awaitTermination()
    return spark.read.parquet(root).select("id", "dataset_id", "question")


@query(
    """
    SELECT 'n' || n_regionkey AS part, count(*) AS row_count, CAST(3 AS BIGINT) AS col_count FROM nation GROUP BY 1
    """
)
def streamed_ingest(spark, sf_dir):
    """One CSV file per region arrives in a landing folder."""
    landing, root = scratch_path(spark, "landing"), scratch_path(spark, "ingest")
    nation = table(spark, sf_dir, "nation")
    # One partition folder per region, one file in each.
    nation.withColumn("region", F.concat(F.lit("n"), "n_regionkey")).repartition(1).write.partitionBy("region").csv(landing, header=True)
    for _ in range(2):
        # The second run finds nothing new.
        jobs.stream_ingest(spark, f"{landing}/*", root, f"{root}/checkpoint").awaitTermination()
    catalog = spark.read.parquet(f"{root}/catalog").select("dataset_id", "row_count", "col_count")
    verdicts = spark.read.parquet(f"{root}/landing").select("dataset_id", F.regexp_extract("path", "region=([^/]+)", 1).alias("part"))
    return catalog.join(verdicts, "dataset_id").select("part", "row_count", "col_count")


# --- user code ---


@query(
    """
    SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(max(o_totalprice) - min(o_totalprice), 4) AS spread
    FROM orders GROUP BY o_orderpriority, o_orderstatus
    """
)
def user_code_per_group(spark, sf_dir):
    keys = ["o_orderpriority", "o_orderstatus"]

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        grouped = pdf.groupby(keys, dropna=False)["o_totalprice"]
        return grouped.agg(n="size", lo="min", hi="max").reset_index()

    def merge(states: pd.DataFrame) -> pd.DataFrame:
        return states.groupby(keys, dropna=False).agg(n=("n", "sum"), lo=("lo", "min"), hi=("hi", "max")).reset_index()

    def spread(states: pd.DataFrame) -> pd.DataFrame:
        return states[[*keys, "n"]].assign(spread=states["hi"] - states["lo"])

    orders = table(spark, sf_dir, "orders").select(*keys, "o_totalprice")
    schema = "o_orderpriority string, o_orderstatus string, n bigint, spread double"
    found = apply_merged(orders, keys, partial, merge, spread, "n bigint, lo double, hi double", schema)
    return rounded(found, "spread", digits=4)


@query("SELECT p_partkey, upper(p_name) AS p_name FROM part WHERE p_size > 25")
def user_code_on_batches(spark, sf_dir):
    def shout(pdf: pd.DataFrame) -> pd.DataFrame:
        large = pdf[pdf["p_size"] > 25]
        return pd.DataFrame({"p_partkey": large["p_partkey"], "p_name": large["p_name"].str.upper()})

    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return apply_table(part, shout, "p_partkey bigint, p_name string")
