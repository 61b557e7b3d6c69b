"""Columns by name and type, and one notion of "missing" for all of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Aggregates of one pass are split so that generated code stays compilable.
COLUMNS_PER_PASS = 100


def col(name: str) -> Column:
    """A column by its literal name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_number(data_type: T.DataType, booleans: bool = False) -> bool:
    return isinstance(data_type, T.NumericType) or (booleans and isinstance(data_type, T.BooleanType))


def number_columns(df: DataFrame, booleans: bool = False) -> list[str]:
    """Numeric column names. Profile, correlation and models leave booleans out;
    summary lines and column descriptions count them in (``booleans=True``)."""
    return [f.name for f in df.schema.fields if is_number(f.dataType, booleans)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def is_fractional(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def missing(df: DataFrame, name: str) -> Column:
    """True where the value is null, or NaN in a floating column."""
    c = col(name)
    return c.isNull() | F.isnan(c) if is_fractional(dtype(df, name)) else c.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The value, with NaN turned into null."""
    c = col(name)
    return F.when(~F.isnan(c), c) if is_fractional(dtype(df, name)) else c


def number(df: DataFrame, name: str) -> Column:
    """The value as a double, missing as null."""
    return present(df, name).cast("double")


def finite(value: Column) -> Column:
    """Infinity and NaN become null."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def as_text(df: DataFrame, name: str) -> Column:
    """A string that differs exactly when two values differ; missing is null."""
    data_type = dtype(df, name)
    value = present(df, name)
    if is_fractional(data_type):
        return F.when(value == 0, F.lit("0.0")).otherwise(value.cast("string"))
    if isinstance(data_type, T.BinaryType):
        return F.hex(value)
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value)
    if isinstance(data_type, T.TimestampType):
        return F.date_format(F.to_utc_timestamp(value, F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return value.cast("string")


def chunks(names: Sequence[str], size: int = COLUMNS_PER_PASS) -> Iterator[list[str]]:
    for start in range(0, len(names), size):
        yield list(names[start : start + size])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def per_column(df: DataFrame, names: Sequence[str], measures, keys: Sequence[str] = ()) -> DataFrame:
    """One aggregation pass, one output row per column.

    ``measures(name)`` gives ``{output name: aggregate}``; every column must
    give the same output names and types.
    """
    frames = []
    positions = {name: i for i, name in enumerate(df.columns)}
    for part in chunks(names):
        structs = [
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(positions[name]).alias("position"),
                *[agg.alias(alias) for alias, agg in measures(name).items()],
            )
            for name in part
        ]
        grouped = df.groupBy(*[col(k) for k in keys]).agg(F.array(*structs).alias("_rows"))
        frames.append(grouped.select(*[col(k) for k in keys], F.inline("_rows")))
    return union_all(frames)


def melt(df: DataFrame, names: Sequence[str], value, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys..., column_name, value)``: one row per cell, ``value(name)`` all of one type."""
    cells = F.array(*[F.struct(F.lit(n).alias("column_name"), value(n).alias("value")) for n in names])
    return df.select(*[col(k) for k in keys], F.inline(cells))
