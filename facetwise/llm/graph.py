"""Connected components of links held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from facetwise.llm.common import shared_root


def _print(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component_id) for each node of the links (a, b), both long: the smallest node reachable.

    Alternating stars: a node's larger neighbours, then its smaller ones, are hung on the smallest
    neighbour until nothing changes, in about log(longest chain) rounds. Every round is a checkpoint in
    the shared folder. A hub is a minimum taken before the shuffle, and a join whose two sides are dealt
    out for it alone, which adaptive execution may split. Nulls and loops are ignored; no links give no rows.
    """
    shared_root(links.sparkSession)
    edges = (
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
        .checkpoint()
    )
    before = _print(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).repartition("a", "m")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).repartition("a", "m")
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = least.select("a", F.col("m").alias("b")).union(small).distinct().checkpoint()
        now = _print(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links still change after {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component_id")).union(
        edges.select(F.col("b").alias("node"), "b").distinct()
    )
