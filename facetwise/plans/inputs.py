"""Input tables with the features the generated data lacks, on both engines.

Each SQL text is a list of common table expressions; each function is the same
table in Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from facetwise.plans.registry import table

# Every 7th value and every 3rd type missing.
EVENTS_SQL = """
ev AS (SELECT event_id, ts, CASE WHEN event_id % 5 > 1 THEN user_id END AS user_id,
              CASE WHEN event_id % 3 > 0 THEN event_type END AS event_type,
              CASE WHEN event_id % 7 > 0 THEN value END AS value
       FROM events)
"""


def events_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.expr("CASE WHEN event_id % 5 > 1 THEN user_id END AS user_id"),
        F.expr("CASE WHEN event_id % 3 > 0 THEN event_type END AS event_type"),
        # NaN and null are both missing: use both.
        F.expr("CASE WHEN event_id % 7 > 0 THEN value WHEN event_id % 2 = 0 THEN double('NaN') END AS value"),
    )


# Labels are known for some documents only: natural nulls.
DOCS_SQL = """
docs AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic,
                length(d.text) - length(replace(d.text, ' ', '')) + 1 AS words
         FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    return documents.join(labels, "doc_id", "left").select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        "quality",
        "toxic",
        (F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit(""))) + 1).cast("bigint").alias("words"),
    )


# Line items without their keys and price repeat a lot.
ITEMS_SQL = """
items AS (SELECT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem)
"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"
    )


def melted_sql(source: str, columns: list[str], value: str) -> str:
    """UNION ALL of one SELECT per column; ``{c}`` in ``value`` is the column."""
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, {i} AS position, {value.format(c=c)} FROM {source}"
        for i, c in enumerate(columns)
    )
