"""Time series: find the columns, collapse, infer the frequency, fill, forecast.

A series table has keys (none for a single series), ts and value. One series
may be very long, so ordered work never sees a whole one: points are dealt by ranges
of key and time and packed into blocks, work is done inside blocks, and what crosses
their borders is carried over one summary row per block. Set the session time zone to
UTC to keep daylight saving out of gaps.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from facetwise import kernels
from facetwise.functions.values import col, dtype, missing, number, number_columns, per_column, text_columns
from facetwise.operators.analysis import join_on_keys
from facetwise.operators.quantiles import long_quantiles
from facetwise.session import write_through

# Date texts understood, tried in this order.
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy HH:mm:ss", "dd-MMM-yyyy", "d MMM yyyy", "MMM d, yyyy", "yyyyMMdd",
)
MIN_ROWS = 5
MIN_POINTS = 10
MIN_DISTINCT = 3
HISTORY_POINTS = 30
#: Points of a block: 1 MB of stamps and values.
BLOCK_POINTS = 1 << 16

MINUTE = 60_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR
GRID_CHUNK = 10_000


def _shape(date_format: str) -> str:
    """A pattern of the texts a date format can read. A failed parse costs far more than a look."""
    spans = [m.group(0) for m in re.finditer(r"'[^']*'|([A-Za-z])\1*|.", date_format)]

    def pattern(span: str) -> str:
        if span.startswith("'"):
            return span.strip("'")
        if span == "MMM":
            return "[A-Za-z]{3}"
        if span == "X":
            return "(Z|[+-][0-9]{2}([0-9]{2})?)"
        if span.isalpha():
            return "[0-9]{1,2}" if len(span) == 1 else f"[0-9]{{{len(span)}}}"
        return re.escape(span)

    return "^" + "".join(pattern(s) for s in spans) + "$"


def parsed(df: DataFrame, name: str) -> Column:
    """The column as a timestamp without zone; unreadable texts are null."""
    data_type = dtype(df, name)
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return col(name).cast("timestamp_ntz")
    if isinstance(data_type, T.StringType):
        text = F.trim(col(name))
        result = F.lit(None).cast("timestamp_ntz")
        # Shapes exclude each other, so the first that fits decides.
        for f in reversed(DATE_FORMATS):
            result = F.when(text.rlike(_shape(f)), F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz")).otherwise(result)
        return result
    return F.lit(None).cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def date_candidates(df: DataFrame) -> DataFrame:
    """-> column_name, position, parsed, rows, varied, qualifies. Numbers never count as dates."""
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType)
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]
    schema = "column_name string, position int, parsed bigint, rows bigint, varied boolean, qualifies boolean"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    dates = df.select(*[parsed(df, n).alias(n) for n in names])
    at = {n: i for i, n in enumerate(names)}
    bounds = dates.agg(
        F.struct(*[F.min(col(n)).alias(f"lo{i}") for n, i in at.items()], *[F.max(col(n)).alias(f"hi{i}") for n, i in at.items()])
    ).scalar()
    # At least three distinct values: some value lies strictly between the ends.
    bounded = dates.withColumn("_ends", bounds)
    found = per_column(
        bounded,
        names,
        lambda n: {
            "parsed": F.count(col(n)),
            "rows": F.count(F.lit(1)),
            "varied": F.count_if((col(n) > F.col(f"_ends.lo{at[n]}")) & (col(n) < F.col(f"_ends.hi{at[n]}"))) > 0,
        },
    )
    spots = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(df.columns.index(n)))])
    enough = F.col("parsed") >= F.greatest(F.lit(MIN_POINTS), F.floor(F.col("rows") * 0.5))
    return found.withColumn("position", spots[F.col("column_name")]).withColumn("qualifies", enough & F.col("varied"))


def find_date_column(df: DataFrame) -> str | None:
    """The first column that reads as dates."""
    found = date_candidates(df).where("qualifies").orderBy("position").limit(1).head()
    return found["column_name"] if found else None


def target_candidates(df: DataFrame) -> DataFrame:
    """Numeric columns by variance, then fewest gaps -> column_name, position, variance, nulls."""
    found = per_column(
        df,
        number_columns(df),
        lambda n: {"variance": F.var_samp(number(df, n)), "nulls": F.count_if(missing(df, n))},
    )
    usable = found.where("variance is not null AND NOT isnan(variance) AND variance <> double('Infinity')")
    return usable.orderBy(F.desc("variance"), "nulls", "position")


def pick_target(df: DataFrame) -> str | None:
    if not number_columns(df):
        return None
    found = target_candidates(df).limit(1).head()
    return found["column_name"] if found else None


def to_series(df: DataFrame, ts: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean per timestamp -> keys, ts, value."""
    dated = df.select(*[col(k) for k in keys], parsed(df, ts).alias("ts"), number(df, y).alias("value"))
    return dated.where("ts is not null").groupBy(*[col(k) for k in keys], "ts").agg(F.avg("value").alias("value"))


# --- series as blocks of points ---


def _named(series: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Key columns as k0, k1, ... (a constant where there are none), so that no name can clash."""
    names = [f"k{i}" for i in range(len(keys) or 1)]
    own = [col(k).alias(n) for k, n in zip(keys, names)] or [F.lit(0).alias("k0")]
    return series.select(*own, micros(F.col("ts")).alias("us"), F.col("value").cast("double").alias("value")), names


def _kinds(frame: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(n, frame.schema[n].dataType) for n in names]


def blocks(series: DataFrame, keys: Sequence[str] = (), size: int | None = None) -> tuple[DataFrame, list[str]]:
    """Points in order of time as rows of arrays -> (k0, k1, ..., seq, n, us, value, us0, us1, first, last, second), key names.

    Rows are dealt by ranges of key and time, so a long series is many tasks. us0 and us1 are the ends of a block, and
    (us0, seq) orders the blocks of a series; equal stamps are never parted. first and last are the known
    values nearest to the ends with their stamps, null where a block knows none, second the value before the
    last point. ``us`` and ``value`` are arrays of longs and doubles as bytes; missing is NaN.
    """
    points, names = _named(series, keys)
    dealt = points.repartitionByRange(*names, "us").sortWithinPartitions(*names, "us", "value")
    schema = T.StructType([*_kinds(points, names), *T._parse_datatype_string("seq long, n long, us binary, value binary").fields])
    packed = dealt.mapInArrow(kernels.block_packer(len(names), size or BLOCK_POINTS), schema)

    ends = "us0 long, us1 long, first struct<us:long,v:double>, last struct<us:long,v:double>, second double"
    return write_through(packed.mapInPandas(kernels.block_ends(), T.StructType([*schema.fields, *T._parse_datatype_string(ends).fields])), "blocks"), names


def _in_order(names: Sequence[str], backwards: bool = False) -> W:
    order = [F.desc("us0"), F.desc("seq")] if backwards else ["us0", "seq"]
    return W.partitionBy(*names).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)


def _back_to_blocks(packed: DataFrame, carried: DataFrame, names: Sequence[str]) -> DataFrame:
    """Blocks with what was carried to them; both have one row per (keys, us0, seq)."""
    on = None
    for c in [*names, "us0", "seq"]:
        same = F.col(f"b.{c}").eqNullSafe(F.col(f"c.{c}"))
        on = same if on is None else on & same
    rest = [F.col(f"c.`{c}`") for c in carried.columns if c not in (*names, "us0", "seq")]
    return packed.alias("b").join(carried.alias("c"), on).select("b.*", *rest)


def gaps(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distances between neighbours -> keys, gap (microseconds), months (calendar months apart).

    Neighbours are found inside blocks, and between the ends of neighbouring blocks.
    """
    packed, names = blocks(series.select(*[col(k) for k in keys], "ts", F.lit(0.0).alias("value")), keys)
    ends = packed.select(*names, "us0", "us1", "seq").withColumn("before", F.last("us1").over(_in_order(names)))
    between = ends.where("before is not null").select(*names, F.col("before").alias("prev"), F.col("us0").alias("us"))
    schema = T.StructType([*_kinds(packed, names), *T._parse_datatype_string("prev long, us long").fields])
    inside = packed.select(*names, "us").mapInPandas(kernels.neighbours(list(names)), schema)

    def month(us):
        stamp = from_micros(us)
        return F.year(stamp) * 12 + F.month(stamp)

    own = [F.col(n).alias(k) for k, n in zip(keys, names)]
    return inside.unionByName(between).select(
        *own, (F.col("us") - F.col("prev")).alias("gap"), (month(F.col("us")) - month(F.col("prev"))).alias("months")
    )


def _label(kind: Column, step: Column, months: Column, gap: Column) -> Column:
    """Calendar and fixed steps by their size; irregular series by their median gap, with tolerance."""
    regular = (
        F.when(kind.isin("month_start", "month_end"), F.when(months % 12 == 0, "yearly").when(months % 3 == 0, "quarterly").otherwise("monthly"))
        .when(step == 7 * DAY, "weekly")
        .when((step % DAY == 0) & (step % (7 * DAY) != 0), "daily")
        .when((step % HOUR == 0) & (step % DAY != 0), "hourly")
        .otherwise("unknown")
    )

    def near(size, tolerance):
        return F.abs(gap - size) / size < tolerance

    loose = (
        F.when(near(HOUR, 0.25), "hourly")
        .when(near(DAY, 0.25), "daily")
        .when(near(7 * DAY, 0.25), "weekly")
        .when(near(30 * DAY, 0.35), "monthly")
        .when(near(365 * DAY, 0.35), "yearly")
        .otherwise("unknown")
    )
    return F.when(kind == "irregular", loose).otherwise(regular)


def frequency(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """-> keys, points, first_ts, last_ts, kind, step, months, median_gap, label.

    ``kind`` is month_start or month_end (every ``months`` months), fixed
    (every ``step`` microseconds) or irregular (``median_gap`` between points).
    """
    by = [col(k) for k in keys]
    ts = F.col("ts")
    midnight = F.date_trunc("day", ts).cast("timestamp_ntz") == ts
    span = series.groupBy(*by).agg(
        F.count(F.lit(1)).alias("points"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.bool_and(midnight & (F.dayofmonth("ts") == 1)).alias("_starts"),
        F.bool_and(midnight & (F.dayofmonth("ts") == F.dayofmonth(F.last_day("ts")))).alias("_ends"),
    )
    steps = write_through(gaps(series, keys), "gaps")
    ranges = steps.groupBy(*by).agg(
        F.min("gap").alias("_g0"), F.max("gap").alias("_g1"), F.min("months").alias("_m0"), F.max("months").alias("_m1")
    )
    middle = long_quantiles(steps.select(*by, F.col("gap").cast("double").alias("value")), keys, [0.5]).select(
        *by, F.col("quantile").alias("median_gap")
    )
    if keys:
        joined = join_on_keys(join_on_keys(span, ranges, keys), middle, keys)
    else:
        joined = span.withColumn("_r", ranges.select(F.struct("*")).scalar()).select("*", "_r.*").drop("_r")
        joined = joined.withColumn("median_gap", middle.scalar())
    enough = F.col("points") >= 3
    same_months = enough & (F.col("_m0") == F.col("_m1")) & (F.col("_m0") > 0)
    kind = (
        F.when(same_months & F.col("_starts"), "month_start")
        .when(same_months & F.col("_ends"), "month_end")
        .when(enough & (F.col("_g0") == F.col("_g1")), "fixed")
        .otherwise("irregular")
    )
    return (
        joined.withColumn("kind", kind)
        .withColumn("months", F.when(F.col("kind").isin("month_start", "month_end"), F.col("_m0")))
        .withColumn("step", F.when(F.col("kind") == "fixed", F.col("_g0")))
        .withColumn("label", _label(F.col("kind"), F.col("step"), F.col("months"), F.col("median_gap")))
        .select(*by, "points", "first_ts", "last_ts", "kind", "step", "months", "median_gap", "label")
    )


def shifted(start: Column, i: Column, kind: Column, step: Column, months: Column, median_gap: Column) -> Column:
    """The ``i``-th stamp after ``start`` at a frequency."""
    month_start = F.add_months(start, (i * months).cast("int"))
    pace = F.coalesce(step, F.round(median_gap).cast("bigint"), F.lit(DAY))
    return (
        F.when(kind == "month_start", month_start.cast("timestamp_ntz"))
        .when(kind == "month_end", F.last_day(month_start).cast("timestamp_ntz"))
        .otherwise(from_micros(micros(start) + i * pace))
    )


def grid(freq: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every stamp from first to last of regular series -> keys, ts, i.

    Points are numbered through chunk numbers first, so no row holds a long array.
    """
    by = [col(k) for k in keys]
    month_count = (F.year("last_ts") - F.year("first_ts")) * 12 + F.month("last_ts") - F.month("first_ts")
    last = F.when(F.col("kind") == "fixed", F.floor((micros(F.col("last_ts")) - micros(F.col("first_ts"))) / F.col("step")))
    last = last.otherwise(F.floor(month_count / F.col("months"))).cast("bigint")
    regular = freq.where("kind <> 'irregular'").withColumn("_last", last)
    chunked = regular.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_last") / GRID_CHUNK))))
    first_i = F.col("_c") * GRID_CHUNK
    numbered = chunked.withColumn("i", F.explode(F.sequence(first_i, F.least(F.col("_last"), first_i + (GRID_CHUNK - 1)))))
    stamp = shifted(F.col("first_ts"), F.col("i"), F.col("kind"), F.col("step"), F.col("months"), F.col("median_gap"))
    return numbered.select(*by, stamp.alias("ts"), "i")


def with_step(series: DataFrame, step: int, keys: Sequence[str] = ()) -> DataFrame:
    """A frequency table that asks for a fixed grid, whatever the gaps -> as ``frequency``."""
    return series.groupBy(*[col(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("points"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.lit("fixed").alias("kind"),
        F.lit(step).cast("bigint").alias("step"),
        F.lit(None).cast("int").alias("months"),
        F.lit(None).cast("double").alias("median_gap"),
        F.lit("fixed").alias("label"),
    )


def fill(series: DataFrame, keys: Sequence[str] = (), size: int | None = None) -> DataFrame:
    """Missing values by linear interpolation in time, the ends by their nearest value -> keys, ts, value.

    The nearest known points come from within a block of points or are carried to it from the last known point of
    the blocks before and the first of the blocks after.
    """
    packed, names = blocks(series, keys, size)
    ends = packed.select(*names, "us0", "seq", "first", "last")
    carried = ends.select(
        *names,
        "us0",
        "seq",
        F.last("last", True).over(_in_order(names)).alias("before"),
        F.last("first", True).over(_in_order(names, backwards=True)).alias("after"),
    )
    schema = T.StructType([*_kinds(packed, names), *T._parse_datatype_string("us long, value double").fields])
    wanted = _back_to_blocks(packed, carried, names).select(*names, "us", "value", "before", "after")
    filled = wanted.mapInPandas(kernels.block_filler(list(names)), schema)
    return filled.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], from_micros(F.col("us")).alias("ts"), F.nanvl("value", F.lit(None).cast("double")).alias("value"))


def regularise(series: DataFrame, keys: Sequence[str] = (), freq: DataFrame | None = None) -> DataFrame:
    """Regular series on their full grid, irregular ones on their own stamps, gaps filled
    -> keys, ts, value."""
    freq = frequency(series, keys) if freq is None else freq
    by = [col(k) for k in keys]
    on_grid = join_on_keys(grid(freq, keys).select(*by, "ts"), series.select(*by, "ts", "value"), [*keys, "ts"])
    loose = freq.where("kind = 'irregular'").select(*by, F.lit(True).alias("_loose"))
    if keys:
        others = join_on_keys(series, loose, keys, "left").where("_loose").select(*by, "ts", "value")
    else:
        others = series.withColumn("_loose", loose.select("_loose").scalar()).where("_loose").select("ts", "value")
    return fill(on_grid.select(*by, "ts", "value").unionByName(others), keys)


def last_points(series: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """The last ``n`` points of every series, with their rank from the end -> ..., rank.

    The rank is cut at ``n``, so each task keeps ``n`` points a series before they meet.
    """
    by = [col(k) for k in keys] or [F.lit(0)]
    ranked = W.partitionBy(*by).orderBy(F.desc("ts"))
    return series.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= n)


def _fitted(packed: DataFrame, names: Sequence[str], steps: int) -> DataFrame:
    """Forecasts -> k0, k1, ..., i, value, lower, upper. A series within one block is fitted in one place. Of a longer one every
    block is a map of the search state (see ``kernels.newton_map``); a step of the search joins the states to the blocks and
    puts the maps of each series together, so no task sees more points than a block's."""
    names = list(names)
    ahead = T.StructType([*_kinds(packed, names), *T._parse_datatype_string("i long, value double, lower double, upper double").fields])
    # The last change of a block needs the level before it, which may lie in an earlier block.
    levels = packed.select(*names, "us0", "seq", F.col("n"), F.col("last.v").alias("level"), F.col("second"))
    whole = W.partitionBy(*names)
    levels = levels.withColumn("before", F.last("level").over(_in_order(names))).withColumn("blocks", F.count(F.lit(1)).over(whole))
    levels = levels.withColumn("own_change", F.col("level") - F.coalesce("second", "before"))
    levels = levels.withColumn("change", F.last("own_change", True).over(_in_order(names)))
    levels = write_through(levels.withColumn("points", F.sum("n").over(whole)), "block-levels")
    carried = levels.where(F.col("points") >= MIN_POINTS).select(*names, "us0", "seq", "before", "change", "blocks")
    parts = _back_to_blocks(packed.select(*names, "us0", "seq", "value"), carried, names)
    short = parts.where("blocks = 1").select(*names, "value").mapInPandas(kernels.whole_forecaster(names, steps, MIN_POINTS), ahead)

    long = write_through(parts.where("blocks > 1").select(*names, "us0", "seq", "value", "before", "change"), "block-changes")
    if long.isEmpty():
        return short
    state = T.StructType([*_kinds(packed, names), *[T.StructField(c, T.DoubleType()) for c in kernels.SEARCH]])
    mapped = T.StructType([*_kinds(packed, names), *T._parse_datatype_string("us0 long, seq long, map binary").fields])
    found = long.mapInPandas(kernels.grid_mapper(names), mapped).groupBy(*names).applyInPandas(kernels.grid_chooser(names), state)
    found = write_through(found, "search")
    mapped = T.StructType([*_kinds(packed, names), *T._parse_datatype_string("us0 long, seq long").fields, *state.fields[len(names) :], T.StructField("map", T.BinaryType())])
    for _ in range(kernels.MAX_STEPS):
        open_ = found.where("done = 0")
        if open_.isEmpty():
            break
        moving = _on_names(long, open_, names).mapInPandas(kernels.newton_mapper(names), mapped)
        stepped = moving.groupBy(*names).applyInPandas(kernels.newton_stepper(names), state)
        found = write_through(stepped.unionByName(found.where("done > 0")), "search")
    newest = W.partitionBy(*names).orderBy(F.desc("us0"), F.desc("seq"))
    last = levels.withColumn("_r", F.row_number().over(newest)).where("_r = 1").select(*names, "level", F.coalesce("own_change", "change").alias("end_change"), "points")
    fitted = _on_names(found, last, names).mapInPandas(kernels.long_forecaster(names, steps), ahead)
    return short.unionByName(fitted)


def _on_names(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Inner join on key columns, null keys equal."""
    on = None
    for c in names:
        same = F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        on = same if on is None else on & same
    return left.alias("l").join(right.alias("r"), on).select("l.*", *[F.col(f"r.`{c}`") for c in right.columns if c not in names])


def forecast(series: DataFrame, steps: int = 10, keys: Sequence[str] = (), freq: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """ARIMA(1,1,1) per series -> keys, ts, kind (history or forecast), value, lower, upper.

    Takes a series without gaps (see ``regularise``). Models are fitted by conditional least squares on all points,
    in blocks of ``size``; series with fewer than 10 points give no forecast.
    """
    freq = frequency(series, keys) if freq is None else freq
    by = [col(k) for k in keys]
    packed, names = blocks(series.where("value is not null AND NOT isnan(value)"), keys, size)
    fitted = _fitted(packed, names, steps)
    fitted = fitted.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "i", "value", "lower", "upper")
    paces = freq.drop("points", "first_ts", "label")
    if keys:
        paced = join_on_keys(fitted, paces, keys)
    else:
        paced = fitted.withColumn("_f", paces.select(F.struct("*")).scalar()).select("*", "_f.*")
    stamp = shifted(F.col("last_ts"), F.col("i"), F.col("kind"), F.col("step"), F.col("months"), F.col("median_gap"))
    ahead = paced.select(*by, stamp.alias("ts"), F.lit("forecast").alias("kind"), "value", "lower", "upper")
    nothing = F.lit(None).cast("double")
    past = last_points(series, HISTORY_POINTS, keys).select(
        *by, "ts", F.lit("history").alias("kind"), "value", nothing.alias("lower"), nothing.alias("upper")
    )
    return past.unionByName(ahead)


def forecast_table(df: DataFrame, steps: int = 10) -> tuple[DataFrame | None, str]:
    """Finds date and target, then forecasts -> (rows, "") or (None, why not)."""
    if df.limit(MIN_ROWS).count() < MIN_ROWS:
        return None, "Not enough rows"
    date = find_date_column(df)
    if date is None:
        return None, "No datetime column detected"
    if not number_columns(df):
        return None, "No numeric columns found"
    target = pick_target(df)
    if target is None:
        return None, "No numeric target with finite variance"
    series = to_series(df, date, target)
    if series.limit(MIN_POINTS).count() < MIN_POINTS:
        return None, "Too few unique datetime points"
    freq = frequency(series)
    return forecast(regularise(series, freq=freq), steps, freq=freq), ""
