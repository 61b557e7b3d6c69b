"""User code over a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from facetwise.functions.values import col


def apply_table(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keys: Sequence[str] | None = None) -> DataFrame:
    """Runs ``fn`` on pandas frames -> a table of ``schema``.

    Without keys ``fn`` sees one Arrow batch at a time, so it must work row by
    row or be merged afterwards. With keys it sees a whole group, which must
    then fit a task: where a group may be large, use ``apply_merged``.
    """
    if keys:
        return df.groupBy(*[col(k) for k in keys]).applyInPandas(fn, schema)

    def each(batches):
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(each, schema)


#: State rows that a task holds before it merges them, and passes on where there are still as many.
HELD_STATES = 10_000
#: Partial states of a key meet in so many places first, then in fewer, then in one.
WIDTHS = (1024, 32)


def apply_merged(
    df: DataFrame,
    keys: Sequence[str],
    partial: Callable[[pd.DataFrame], pd.DataFrame],
    merge: Callable[[pd.DataFrame], pd.DataFrame],
    finish: Callable[[pd.DataFrame], pd.DataFrame],
    state: str,
    schema: str,
    widths: Sequence[int] = WIDTHS,
) -> DataFrame:
    """User code over groups of any size, in mergeable parts -> a table of ``schema``.

    ``partial`` turns rows of several keys into state rows: the keys and the columns of ``state`` (a schema
    without the keys). ``merge`` makes one state row per key of several, in any order and grouping. ``finish``
    makes result rows of state rows, one per key. All three may see several keys at a time; null is a key
    (pandas makes doubles of whole-number keys with nulls).

    A task merges what it has read before anything is shuffled. The states of a key then meet in a tree:
    by input partition modulo each of ``widths``, then in one place. So no task sees a whole group, and
    a group with most of the rows is read by as many tasks as its rows have splits.
    """
    names = list(keys)

    kinds = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in names] + [state])
    texts = [[f.name for f in T.StructType.fromDDL(ddl) if f.dataType == T.StringType()] for ddl in (kinds, schema)]

    def plain(frame, columns=texts[0]):
        """Texts as objects: pandas makes numbers of a column that is missing throughout, and Arrow chunks of joined texts."""
        whole = {c: frame[c].astype(object).where(frame[c].notna(), None) for c in columns}
        return frame.assign(**whole)

    def read(batches):
        # The partition only, not a running number: a repeated task must send a key the same way.
        place = TaskContext.get().partitionId()
        held, size = [], 0
        for batch in batches:
            held.append(partial(batch))
            size += len(held[-1])
            if size >= HELD_STATES:
                held = [merge(pd.concat(held, ignore_index=True))]
                size = len(held[0])
                if size >= HELD_STATES:
                    yield plain(held[0]).assign(_place=place)
                    held, size = [], 0
        if size:
            yield plain(merge(pd.concat(held, ignore_index=True))).assign(_place=place)

    def together(place):
        return lambda frame: plain(merge(frame.drop(columns="_place"))).assign(_place=place(frame))

    def finished(batches):
        for batch in batches:
            yield plain(finish(batch), texts[1])

    states = df.mapInPandas(read, f"{kinds}, _place int")
    by = [col(k) for k in names]
    for width in widths:
        dealt = states.withColumn("_place", F.pmod("_place", F.lit(width)))
        states = dealt.groupBy(*by, "_place").applyInPandas(together(lambda frame: frame["_place"].iloc[0]), f"{kinds}, _place int")
    one = states.groupBy(*by).applyInPandas(together(lambda frame: 0), f"{kinds}, _place int")
    return one.drop("_place").mapInPandas(finished, schema)
