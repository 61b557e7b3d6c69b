"""The corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from facetwise.llm import language, lines, packing, simhash, substrings
from facetwise.llm.common import stored

TOKENIZER = "word_bpe_49k.json"


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language by compression; rejected documents go, and ``lang`` becomes the language found."""
    model = language.fit(docs.where(language.training_rows()))
    found = language.identify(docs, model, whole_row=True).where("NOT rejected")
    kept = [F.col("lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return found.select(*kept)


def without_near_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines within one edit of an earlier line go; every document stays."""
    return counted(lines.without_duplicate_lines(docs), docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with linked fingerprints the one with the smallest id stays."""
    groups = stored(simhash.near_groups(docs), "near-groups")
    gone = groups.groupBy("doc_id").agg(F.bool_or(F.expr("doc_id <=> component_id")).alias("stays")).where("NOT stays")
    # As a table its size is known when the join is planned, so texts are not shuffled for a few ids.
    gone = stored(gone.select("doc_id"), "near-copies")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that start earlier go; every document stays. A null text becomes empty."""
    kept = substrings.without_repeats(docs, whole_row=True)
    columns = [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return counted(kept.select(*columns), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in a sequence."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path(TOKENIZER), ids=False)


def counted(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars of the text as it is now."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


STAGES = [
    ("language", identified),
    ("lines", without_near_lines),
    ("near_duplicates", one_of_each_group),
    ("passages", without_repeated_passages),
    ("packing", packed),
]

#: Compression, token merges and packing aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
