"""Exact duplicates: one 128-bit hash for each text, and a comparison of bytes inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from facetwise.llm.common import plain, stored

#: Collided hashes named in the plan; more of them are joined instead.
MAX_LISTED = 100


def content_hash(text: Column) -> Column:
    """The 16 bytes of the text's MD5."""
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest",
                 carry: dict[str, Column] | None = None, content_hash=content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id (the id that stays of its equal texts), group_size, kept.

    Rows are grouped by the hash of their whole text, counted before the shuffle, so a group of any size
    is one row per task. Inside groups of several rows each text is compared byte for byte with that of
    the row that stays. Where a text differs, that hash has collided, and its rows are grouped by the
    text itself. ``keep``: "largest" or "smallest" id. ``carry``: more columns, made from doc_id and text.
    A null text counts as empty; rows of one id and text are the same document and all carry the same
    answer; a null id stays only in a group without any other; other columns are ignored; no rows give
    no rows.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep: {keep!r}")
    best = F.max if keep == "largest" else F.min
    hashed = plain(docs, id_col, text_col).withColumn("hash", content_hash(F.col("text")))
    groups = hashed.groupBy("hash").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # A table, so that every join below deals out both of its sides and a hot group can be split.
    groups = stored(groups, "exact-groups")

    several = groups.where("group_size > 1")
    members = hashed.join(several.select("hash"), "hash").select("hash", "text")
    first = hashed.alias("h").join(
        several.alias("g"), F.expr("h.hash = g.hash AND h.doc_id <=> g.keep_id"), "left_semi"
    )
    first = first.groupBy("hash").agg(F.min("text").alias("stays")).repartition("hash", "stays")
    collided = members.join(first, "hash").where("text <> stays").select("hash")
    bad = {bytes(r[0]) for r in collided.distinct().limit(MAX_LISTED + 1).collect()}

    def answer(rows: DataFrame, of: DataFrame, keys: list[str]) -> DataFrame:
        rows = rows.select("doc_id", *keys, *[c.alias(f"carry_{name}") for name, c in (carry or {}).items()])
        return rows.join(of, keys).select(
            "doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"),
            *[F.col(f"carry_{name}").alias(name) for name in carry or {}],
        )

    if not bad:
        return answer(hashed, groups, ["hash"])
    if len(bad) <= MAX_LISTED:
        hit = F.col("hash").isin(sorted(bad))
        sound, odd = hashed.where(~hit), hashed.where(hit)
    else:
        sound = hashed.join(collided.distinct(), "hash", "left_anti")
        odd = hashed.join(collided.distinct(), "hash", "left_semi")
    by_text = odd.groupBy("hash", "text").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return answer(sound, groups, ["hash"]).union(answer(odd, by_text, ["hash", "text"]))
