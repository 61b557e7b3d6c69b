"""CSV with inferred types, landing checks, stored tables and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from facetwise.functions.values import chunks, col
from facetwise.operators.schema import json_safe

# Texts that stand for a missing value.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
TRUE_TEXTS = ("True", "TRUE", "true")
FALSE_TEXTS = ("False", "FALSE", "false")
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
DECIMAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$|^\s*[+-]?([iI]nf|[iI]nfinity)\s*$"
EXTENSIONS = ("csv", "xlsx", "xls")


def _cleaned(name: str, na_tokens: Sequence[str]) -> Column:
    return F.when(~col(name).isin(list(na_tokens)), col(name))


def _as_long(value: Column) -> Column:
    return F.when(value.rlike(INTEGER), F.trim(value).try_cast("bigint"))


def _as_double(value: Column) -> Column:
    return F.when(value.rlike(DECIMAL), F.regexp_replace(F.lower(F.trim(value)), "^([+-]?)inf$", "$1infinity").try_cast("double"))


def _as_boolean(value: Column) -> Column:
    return F.when(value.isin(list(TRUE_TEXTS)), True).when(value.isin(list(FALSE_TEXTS)), False)


def infer_types(raw: DataFrame, na_tokens: Sequence[str] = NA_TOKENS) -> dict[str, T.DataType]:
    """The narrowest of long, double, boolean and string that takes every present text. One pass;
    an empty column is double."""
    found: dict[str, T.DataType] = {}
    for part in chunks(raw.columns):
        counts = raw.agg(
            *[
                F.struct(F.count(v), F.count(_as_long(v)), F.count(_as_double(v)), F.count(_as_boolean(v))).alias(f"c{i}")
                for i, v in enumerate(_cleaned(name, na_tokens) for name in part)
            ]
        ).head()
        for name, (present, longs, doubles, booleans) in zip(part, counts):
            if present == 0:
                found[name] = T.DoubleType()
            elif longs == present:
                found[name] = T.LongType()
            elif doubles == present:
                found[name] = T.DoubleType()
            elif booleans == present:
                found[name] = T.BooleanType()
            else:
                found[name] = T.StringType()
    return found


def read_table(
    spark: SparkSession, path: str, na_tokens: Sequence[str] = NA_TOKENS, schema: T.StructType | None = None, multi_line: bool = True
) -> DataFrame:
    """A CSV with header. Missing-value texts become null and do not spoil a column's type.

    A column of whole numbers with gaps stays long. Quoted line breaks keep a
    file in one task; landing files are small (see ``check_landing``), larger
    ones without such breaks should be read with ``multi_line=False``.
    """
    raw = spark.read.csv(
        path, header=True, quote='"', escape='"', multiLine=multi_line, inferSchema=False, nullValue=None, emptyValue=""
    )
    types = {f.name: f.dataType for f in schema.fields} if schema is not None else infer_types(raw, na_tokens)
    casts = {T.LongType(): _as_long, T.DoubleType(): _as_double, T.BooleanType(): _as_boolean, T.StringType(): lambda v: v}

    def typed(name):
        value = _cleaned(name, na_tokens)
        target = types[name]
        return casts[target](value) if target in casts else value.try_cast(target)

    return raw.select(*[typed(c).alias(c) for c in raw.columns if c in types])


def check_landing(spark: SparkSession, folder: str, max_bytes: int | None = None) -> DataFrame:
    """Files of a folder -> path, length, accepted, reason. Files have no size limit unless ``max_bytes`` gives one.

    A scan leaves empty files out, so names come from the listing the scan was planned with.
    """
    scan = spark.read.format("binaryFile").load(folder)
    listed = spark.createDataFrame([(name,) for name in scan.inputFiles()], "listed string")
    plain = F.regexp_replace(F.url_decode(F.replace("listed", F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    sizes = scan.select("path", "length")
    files = listed.select(plain.alias("path")).join(sizes, "path", "left").withColumn("length", F.coalesce("length", F.lit(0)))
    return judge_files(spark, files, folder, max_bytes)


def judge_files(spark: SparkSession, files: DataFrame, folder: str, max_bytes: int | None = None) -> DataFrame:
    """Verdicts on (path, length) rows of a landing folder, as in ``check_landing``."""
    too_large = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    small = spark.read.format("binaryFile").option("pathGlobFilter", "*.[cC][sS][vV]").load(folder)
    unreadable = small.where((F.col("length") > 0) & ~too_large).where(~F.is_valid_utf8(F.col("content").cast("string")))
    broken = unreadable.select(F.col("path").alias("_bad"))
    reason = (
        F.when(~extension.isin(list(EXTENSIONS)), "Only .csv, .xlsx, and .xls files are accepted.")
        .when(too_large, F.lit(f"File too large. Max size is {max_bytes} bytes."))
        .when(F.col("length") == 0, "Uploaded file is empty.")
        .when(F.col("_bad").isNotNull(), "Uploaded file is not a valid CSV.")
    )
    judged = files.join(broken, F.col("path") == F.col("_bad"), "left").withColumn("reason", reason)
    return judged.select("path", "length", F.col("reason").isNull().alias("accepted"), "reason")


def table_path(root: str, dataset_id: str) -> str:
    return f"{root.rstrip('/')}/dataset_id={dataset_id}"


def save_table(df: DataFrame, root: str, dataset_id: str) -> str:
    """Keep a table as Parquet under its id; saving again replaces it."""
    path = table_path(root, dataset_id)
    df.write.mode("overwrite").parquet(path)
    return path


def load_table(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    return spark.read.parquet(table_path(root, dataset_id))


def export(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Results as JSON lines or CSV with header; nested values go to CSV as JSON text."""
    if fmt == "json":
        json_safe(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    elif fmt == "csv":
        nested = (T.ArrayType, T.MapType, T.StructType)
        flat = df.select(
            *[(F.to_json(col(f.name)) if isinstance(f.dataType, nested) else col(f.name)).alias(f.name) for f in df.schema.fields]
        )
        flat.write.mode("overwrite").option("escape", '"').csv(path, header=True)
    else:
        raise ValueError(f"unknown format: {fmt}")
