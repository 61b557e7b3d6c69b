"""Streams that keep tables, profiles and the log up to date. All of them may be replayed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from facetwise.functions.values import missing, number, number_columns, per_column
from facetwise.operators.catalog import register
from facetwise.sources.tables import judge_files, read_table, save_table

FILES_PER_BATCH = 16
#: Sizes of the stored sketches: 2^12 registers of distinct values, 200 values on each level of ranks.
DISTINCT_LG_K = 12
RANKS_K = 200


def stream_ingest(spark: SparkSession, folder: str, root: str, checkpoint: str, max_bytes: int | None = None) -> StreamingQuery:
    """New files of a landing folder become stored tables (``root/tables``) with a catalog row
    (``root/catalog``) each; the verdict on every file goes to ``root/landing``.

    A file's id comes from its path, and everything is written by id or batch, so a
    replayed batch replaces what it wrote before. Empty files never reach a stream.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("maxFilesPerTrigger", FILES_PER_BATCH)
        .load(folder)
        .select("path", "length")
    )

    def take(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        judged = judge_files(session, batch, folder, max_bytes)
        identified = judged.withColumn("dataset_id", F.substring(F.sha2("path", 256), 1, 32))
        verdicts = f"{root}/landing/batch_id={batch_id}"
        identified.write.mode("overwrite").parquet(verdicts)
        # At most FILES_PER_BATCH names; each file is a table of its own.
        accepted = session.read.parquet(verdicts).where("accepted AND lower(path) LIKE '%.csv'").collect()
        for row in accepted:
            table = read_table(session, row["path"])
            path = save_table(table, f"{root}/tables", row["dataset_id"])
            stored = session.read.parquet(path)
            entry = register(stored, row["dataset_id"], row["path"].rsplit("/", 1)[-1], path)
            entry.drop("dataset_id").write.mode("overwrite").parquet(f"{root}/catalog/dataset_id={row['dataset_id']}")

    return (
        files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def batch_facts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mergeable facts of one batch -> column_name, rows, missing, mean, squares, cubes, min, max, seen, ranks.

    ``squares`` and ``cubes`` are summed powers of the distances from the batch mean. ``seen`` is a sketch of
    the distinct values, ``ranks`` one of their order; both have a bounded size for any number of rows.
    """
    names = list(columns) if columns is not None else number_columns(df)

    def measures(name):
        x = number(df, name) + F.lit(0.0)  # one zero, not two
        n, spread = F.count(x), F.var_pop(x)
        return {
            "rows": F.count(F.lit(1)),
            "missing": F.count_if(missing(df, name)),
            "mean": F.avg(x),
            "squares": spread * n,
            "cubes": F.when(n > 0, F.when(spread > 0, F.skewness(x) * F.pow(spread, 1.5) * n).otherwise(0.0)),
            "min": F.min(x),
            "max": F.max(x),
            "seen": F.hll_sketch_agg(F.when(x.isNotNull(), F.xxhash64(x)), DISTINCT_LG_K),
            "ranks": F.when(n > 0, F.kll_sketch_agg_double(x, RANKS_K)),
        }

    return per_column(df, names, measures).drop("position")


def merge_facts(facts: DataFrame) -> DataFrame:
    """Batch facts of any number of batches -> column_name, rows, missing, mean, std, min, max, skew, distinct, median.

    The last two are estimates: ``distinct`` within some 5 %, ``median`` within some 1.5 % of the rows in rank.
    """
    n = F.col("rows") - F.col("missing")
    totals = facts.groupBy("column_name").agg(
        F.sum("rows").alias("rows"),
        F.sum("missing").alias("missing"),
        F.try_divide(F.sum(n * F.col("mean")), F.sum(F.when(F.col("mean").isNotNull(), n))).alias("mean"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.hll_sketch_estimate(F.hll_union_agg("seen")).alias("distinct"),
        F.kll_merge_agg_double("ranks").alias("_ranks"),
    )
    # One row per column: safe to send everywhere.
    centred = facts.join(F.broadcast(totals.select("column_name", F.col("mean").alias("_mean"))), "column_name")
    offset = F.col("mean") - F.col("_mean")
    spread = centred.groupBy("column_name").agg(
        F.sum(F.col("squares") + n * offset * offset).alias("_squares"),
        F.sum(F.col("cubes") + 3 * offset * F.col("squares") + n * offset * offset * offset).alias("_cubes"),
    )
    third = F.col("_cubes") / n / F.pow(F.col("_squares") / n, 1.5)
    return totals.join(F.broadcast(spread), "column_name").select(
        "column_name",
        "rows",
        "missing",
        "mean",
        F.sqrt(F.when(n > 1, F.col("_squares") / (n - 1))).alias("std"),
        "min",
        "max",
        F.when((n > 2) & (F.col("_squares") > 0), third * F.sqrt(n * (n - 1.0)) / (n - 2)).alias("skew"),
        "distinct",
        F.when(n > 0, F.kll_sketch_get_quantile_double("_ranks", F.lit(0.5))).alias("median"),
    )


def stream_profile(stream: DataFrame, root: str, checkpoint: str, columns: Sequence[str] | None = None) -> StreamingQuery:
    """Facts per micro-batch under ``root``; read them with ``running_profile``."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch_facts(batch, columns).write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_profile(spark: SparkSession, root: str) -> DataFrame:
    return merge_facts(spark.read.parquet(root))


def stream_log(entries: DataFrame, root: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Appends log entries, each id once; repeats within ``delay`` are dropped."""
    once = entries.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["id"])
    return (
        once.writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("dataset_id")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(root)
    )
