"""Line dedup: lines within one edit of an earlier line, by a deletion-neighbourhood join.

Two texts within one edit become equal when one character is deleted from both, or from the longer.
Emitting every such variant of every line would multiply the corpus by the length of its lines, so the
neighbourhood is built by deleting shorter and shorter stretches: of up to 256 characters, then of 16,
then single characters. A variant's key is a hash of everything outside the stretch and of its place.
Two lines within one edit share the key of the stretch that holds it, at each step; only lines whose key
another line shares go on to the next step. So no pair is lost and few variants are made. At the last
step a key is a deleted character: of its lines only the earliest matters, so no pairs are made either.
All of it is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from facetwise.llm.common import stored

#: One edit must leave 0.8 in common: shorter lines are duplicates only if equal.
MIN_CHARS = 5
STRETCHES = (256, 16, 1)


def split_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no from 0, line); a null text has no lines, an empty one has one."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.posexplode(F.split(F.col(f"`{text_col}`").cast("string"), "\n", -1)).alias("line_no", "line"),
    )


def _identity() -> dict[str, Column]:
    """128 bits of hash: two with different seeds."""
    return {"id1": F.xxhash64("line"), "id2": F.xxhash64(F.lit("second"), "line")}


def _cut(rows: DataFrame, size: int, keep: list[str], least: int = 1) -> DataFrame:
    """Each text ``content`` with ``spare`` of 0 or 1 in stretches of about ``size`` characters.

    A text of m + spare characters is cut as one of m characters is, with ``spare`` characters more in
    the stretch: as the shorter (0) and the longer (1) of two lines it meets both neighbours in length.
    """
    rows = rows.withColumn("m", F.length("content") - F.col("spare"))
    rows = rows.withColumn("q", F.greatest(F.lit(least), F.ceil(F.col("m") / size).cast("int")))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("q"))).alias("r"))
    return rows.selectExpr(
        *keep,
        "spare",
        "int(floor((r - 1L) * m / q)) AS lo",
        "int(floor(r * bigint(m) / q)) AS hi",
        "m", "r", "content", "key",
    ).selectExpr(
        *keep,
        "spare",
        "xxhash64(key, m, r, left(content, lo), substring(content, hi + spare + 1)) AS key",
        "substring(content, lo + 1, hi - lo + spare) AS content",
    )


def _shared_keys(rows: DataFrame, identity: str) -> DataFrame:
    """Keys under which different lines stand, one of them at least as the shorter."""
    return (
        rows.groupBy("key")
        .agg(F.min(identity).alias("low"), F.max(identity).alias("high"), F.min("spare").alias("spare"))
        .where("low <> high AND spare = 0")
        .select("key")
    )


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, origin): each line that is within one edit of an earlier one, and where the
    earliest of those stands, a struct of doc_id and line_no.

    Earlier: smaller doc_id, or the same and a smaller line number. One edit: a character put in, left
    out or exchanged, or none. Judged on the input: what is close to a removed line goes too. Blank lines
    are never duplicates; lines under five characters only if equal; lines of null ids are neither
    duplicates nor originals. A null text has no lines. Rows that repeat an id are one document, whose
    lines of one number stand at one place. Other columns are ignored; no rows give no rows.
    """
    lines = split_lines(docs, id_col, text_col).where("doc_id IS NOT NULL AND trim(line) <> ''")
    lines = lines.withColumns(_identity())
    # Equal lines: their first place. Copies are merged before the shuffle.
    firsts = lines.groupBy("id1", "id2").agg(F.min(F.struct("doc_id", "line_no")).alias("at"))
    firsts = stored(firsts, "first-lines")
    near = stored(_near(docs, id_col, text_col, lines, firsts), "near-lines")
    origins = firsts.join(near, "at", "left").select("id1", "id2", F.least("at", "earliest").alias("origin"))
    return (
        lines.select("doc_id", "line_no", "id1", "id2")
        .join(origins.repartition("id1", "origin"), ["id1", "id2"])
        .where(F.col("origin") < F.struct("doc_id", "line_no"))
        .select("doc_id", "line_no", "origin")
    )


def _near(docs: DataFrame, id_col: str, text_col: str, lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """(at, earliest): first places of lines, and the first place of the earliest other line one edit away."""
    spares = F.explode(F.array(F.lit(0), F.lit(1))).alias("spare")
    fit = F.length("content") - F.col("spare") >= MIN_CHARS

    def widest(rows: DataFrame, keep: list[str]) -> DataFrame:
        rows = rows.select(*keep, F.col("line").alias("content"), F.lit(0).cast("long").alias("key"), spares)
        return _cut(rows.where(fit), STRETCHES[0], keep, least=2)

    wide = widest(lines.where(F.length("line") >= MIN_CHARS), ["id1"]).select("id1", "spare", "key")
    shared = stored(_shared_keys(wide, "id1"), "shared-stretches")
    # Few lines are left; their texts are fetched once, by document.
    found = wide.join(shared, "key").groupBy("id1").agg(F.collect_set("key").alias("keys"))
    places = firsts.join(found, "id1").select("at.doc_id", F.struct("at.line_no", "keys").alias("mark"))
    places = places.groupBy("doc_id").agg(F.collect_list("mark").alias("marks"))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    texts = texts.join(places, "doc_id").select("doc_id", F.split("text", "\n", -1).alias("all"), F.explode("marks").alias("mark"))
    texts = texts.where(F.size("all") > F.col("mark.line_no")).select(
        F.struct("doc_id", F.col("mark.line_no").alias("line_no")).alias("at"),
        F.element_at("all", F.col("mark.line_no") + 1).alias("line"),
        F.col("mark.keys").alias("keys"),
    )
    texts = stored(texts, "line-candidates")

    rows = widest(texts, ["at", "keys"]).where("array_contains(keys, key)").drop("keys")
    for size in STRETCHES[1:]:
        rows = _cut(rows, size, ["at"])
        if size > 1:
            rows = stored(rows, "stretches")
            rows = rows.join(_shared_keys(rows, "at").repartition("key", F.lit(0)), "key", "left_semi")
    # One character of the shorter line, two of the longer. Exchanged: two shorter ones under one key.
    # Put in: the shorter one's character is one of the longer one's two.
    variants = rows.select(
        "at", "key",
        F.explode(F.expr(
            "CASE WHEN spare = 0 THEN array(named_struct('role', 2, 'letter', ''), named_struct('role', 0, 'letter', content)) "
            "ELSE transform(array_distinct(array(left(content, 1), right(content, 1))), c -> named_struct('role', 1, 'letter', c)) END"
        )).alias("v"),
    ).select("at", F.col("v.role").alias("role"), F.xxhash64("key", F.col("v.role") == 2, "v.letter").alias("key"))
    variants = stored(variants.distinct(), "line-variants")
    groups = variants.groupBy("key").agg(*[F.min(F.when(F.col("role") == k, F.col("at"))).alias(f"of{k}") for k in (0, 1, 2)])
    groups = stored(groups.where("of0 IS NOT NULL AND of1 IS NOT NULL OR of2 IS NOT NULL"), "variant-groups")
    pairs = variants.join(groups, "key").select(
        "at", F.expr("CASE role WHEN 0 THEN of1 WHEN 1 THEN of0 ELSE of2 END").alias("other")
    )
    pairs = pairs.where(F.col("other") < F.col("at")).distinct()
    here, there = texts.select("at", F.col("line").alias("here")), texts.select(F.col("at").alias("other"), F.col("line").alias("there"))
    checked = pairs.join(here, "at").join(there, "other").where(F.levenshtein("here", "there", 1).between(0, 1))
    return checked.groupBy("at").agg(F.min("other").alias("earliest"))


def without_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, duplicate lines taken out of the text.

    A text whose lines all go is left empty; null texts and rows with null ids stay as they are.
    """
    gone = duplicate_lines(docs, id_col, text_col).groupBy(F.col("doc_id").alias("__id")).agg(
        F.collect_set("line_no").alias("__gone")
    )
    text = F.col(f"`{text_col}`")
    kept = F.array_join(F.filter(F.split(text.cast("string"), "\n", -1), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    joined = docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col("__id"), "left")
    return joined.withColumn(text_col, F.when(F.col("__gone").isNull(), text).otherwise(kept)).drop("__id", "__gone")
