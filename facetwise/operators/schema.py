"""Schema views, row selection and result shaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from facetwise.functions.values import as_text, chunks, col, dtype, is_fractional, missing, per_column, union_all

ELLIPSIS = "…"


def truncate(value: Column, n: int) -> Column:
    """Texts longer than ``n`` keep ``n - 1`` characters and an ellipsis."""
    return F.when(F.length(value) > n, F.concat(F.substring(value, 1, n - 1), F.lit(ELLIPSIS))).otherwise(value)


def first_values(
    df: DataFrame, names: Sequence[str], order_by: Sequence[str], n: int, skip_missing: bool, max_chars: int = 200
) -> DataFrame:
    """The first ``n`` values of each column in key order, as text -> column_name, samples.

    Every part is an ordered limit, which keeps ``n`` rows per task and never
    sorts the table. With ``skip_missing`` each column reads only itself and the
    key, because its first present values may lie anywhere.
    """
    keys = [col(k).alias(f"_k{i}") for i, k in enumerate(order_by)]
    ranks = [f"_k{i}" for i in range(len(order_by))]
    if skip_missing:
        firsts = [
            df.where(~missing(df, name))
            .select(F.lit(name).alias("column_name"), as_text(df, name).alias("value"), *keys)
            .orderBy(*ranks)
            .limit(n)
            for name in names
        ]
    else:
        cells = [F.struct(F.lit(c).alias("column_name"), as_text(df, c).alias("value")) for c in names]
        firsts = [df.orderBy(*[col(k) for k in order_by]).limit(n).select(*keys, F.inline(F.array(*cells)))]
    # At most n rows per column from here on.
    in_order = F.array_sort(F.collect_list(F.struct(*ranks, F.col("value").alias("v"))))
    return (
        union_all(firsts)
        .groupBy("column_name")
        .agg(F.transform(in_order, lambda s: truncate(s["v"], max_chars)).alias("samples"))
    )


def describe_schema(df: DataFrame, order_by: Sequence[str], n: int = 3, max_chars: int = 200) -> DataFrame:
    """Per column -> column_name, position, dtype, samples, null_count, row_count."""
    counted = per_column(
        df,
        df.columns,
        lambda name: {
            "dtype": F.lit(dtype(df, name).simpleString()),
            "null_count": F.count_if(missing(df, name)),
            "row_count": F.count(F.lit(1)),
        },
    )
    samples = first_values(df, df.columns, order_by, n, False, max_chars)
    return counted.join(F.broadcast(samples), "column_name", "left").select(
        "column_name", "position", "dtype", "samples", "null_count", "row_count"
    )


def json_safe(df: DataFrame) -> DataFrame:
    """The same columns with values any JSON reader takes: NaN and infinity become
    null, dates and timestamps ISO-8601 text, bytes UTF-8 text, decimals doubles."""

    def clean(value: Column, data_type: T.DataType) -> Column:
        if is_fractional(data_type):
            return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)
        if isinstance(data_type, T.DecimalType):
            return value.cast("double")
        if isinstance(data_type, T.DateType):
            return F.date_format(value, "yyyy-MM-dd")
        if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
            whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
            micros = F.date_format(value, "SSSSSS")
            return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
        if isinstance(data_type, T.BinaryType):
            return F.decode(value, "UTF-8")
        if isinstance(data_type, T.DayTimeIntervalType):
            return value.cast("string")
        if isinstance(data_type, T.ArrayType):
            return F.transform(value, lambda v: clean(v, data_type.elementType))
        if isinstance(data_type, T.StructType):
            fields = [clean(value.getField(f.name), f.dataType).alias(f.name) for f in data_type.fields]
            return F.when(value.isNotNull(), F.struct(*fields))
        return value

    return df.select(*[clean(col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON document per row -> json."""
    safe = json_safe(df)
    return safe.select(F.to_json(F.struct(*[col(c) for c in safe.columns]), {"ignoreNullFields": "false"}).alias("json"))


def sample_rows(df: DataFrame, key: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (all, when fewer), the same ones on every run and cluster.

    Rows are ranked by a digest of their key, ties by all columns. They are first counted per beginning
    of the digest, and only those up to the beginning where the count reaches ``n`` are ordered.
    """
    if not key:
        raise ValueError("a sample needs a key")
    digest = F.md5(F.concat_ws(":", *[col(k).cast("string") for k in key], F.lit(str(seed))))
    ranked = df.withColumn("_digest", digest)
    start = F.substring("_digest", 1, 4)
    # At most 65,536 beginnings.
    counts = ranked.groupBy(start.alias("_start")).agg(F.count(F.lit(1)).alias("_n"))
    so_far = counts.withColumn("_sum", F.sum("_n").over(W.orderBy("_start")))
    last = so_far.agg(F.min(F.when(F.col("_sum") >= n, F.col("_start"))).alias("last"))
    near = ranked.where(start <= F.coalesce(last.scalar(), F.lit("ffff")))
    everything = F.to_json(F.struct(*[col(c) for c in df.columns]))
    return near.orderBy("_digest", *[col(k) for k in key], everything).limit(n).drop("_digest")


def first_rows(df: DataFrame, order_by: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in key order."""
    return df.orderBy(*[col(k) for k in order_by]).limit(n)


def to_key_value(df: DataFrame) -> DataFrame:
    """Every cell of a record table as key and text value -> key, value."""
    parts = []
    for names in chunks(df.columns):
        pairs = [F.struct(F.lit(n).alias("key"), col(n).cast("string").alias("value")) for n in names]
        parts.append(df.select(F.inline(F.array(*pairs))))
    return union_all(parts)
