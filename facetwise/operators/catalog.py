"""Dataset catalog, stored profiles, and the question log.

Tables: datasets (dataset_id, name, path, row_count, col_count, schema_json,
created_at); facts (dataset, section, column_name, metric, value_double,
value_string); log (id, dataset_id, question, answer_summary, response_json,
query_type, created_at).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from facetwise import kernels
from facetwise.functions.text import ACCEPTED_OVERLAP, CONTAINED_SCORE, overlap_score, plain, words_of
from facetwise.operators.vectors import best_matches, embed, hashed_ngrams
from facetwise.session import write_through

SUMMARY_CHARS = 200
HISTORY_SCORE = 0.75
# Rows of one side that meet in one task, however large a dataset is.
BLOCK_ROWS = 4096
PROFILE_SECTIONS = ("shape", "missing", "duplicates", "correlation", "flag", "numeric")
COVERED = "covered"


def register(df: DataFrame, dataset_id: str, name: str, path: str, created_at: Column | None = None) -> DataFrame:
    """The catalog row of a dataset."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(name).alias("name"),
        F.lit(path).alias("path"),
        "row_count",
        F.lit(len(df.columns)).cast("bigint").alias("col_count"),
        F.lit(df.schema.json()).alias("schema_json"),
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
    )


def list_datasets(catalog: DataFrame, missing_counts: DataFrame | None = None) -> DataFrame:
    """Newest first, with the current number of missing cells when given (dataset_id, missing)."""
    if missing_counts is not None:
        catalog = catalog.join(missing_counts, "dataset_id", "left")
    return catalog.orderBy(F.desc("created_at"), "dataset_id")


def get(catalog: DataFrame, dataset_id: str) -> DataFrame:
    return catalog.where(F.col("dataset_id") == dataset_id)


def remove(frame: DataFrame, gone: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Rows of datasets that stay; use it on the catalog, its facts, log and registry alike."""
    ids = gone.select(F.col("dataset_id").alias("_gone"))
    return frame.join(ids, F.col(key) == F.col("_gone"), "left_anti")


def put_facts(facts: DataFrame, root: str, whole: Sequence[str] = ()) -> None:
    """Store profile facts; the sections at hand replace their earlier version, others stay.

    ``whole``: datasets whose full profile this is. All their profile sections are replaced, also those
    without any fact now: a marker row stands for each, which ``stored_facts`` leaves out.
    """
    if whole:
        markers = [(d, s, "", COVERED) for d in whole for s in PROFILE_SECTIONS]
        frame = facts.sparkSession.createDataFrame(markers, "dataset string, section string, column_name string, metric string")
        facts = facts.unionByName(frame, allowMissingColumns=True)
    (
        facts.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dataset", "section")
        .parquet(root)
    )


def stored_facts(spark: SparkSession, root: str) -> DataFrame:
    """The facts that ``put_facts`` has stored."""
    return spark.read.parquet(root).where(F.col("metric") != COVERED)


def status(catalog: DataFrame, facts: DataFrame) -> DataFrame:
    """Profile state per dataset: processing (no facts yet), error, or ready."""
    seen = facts.groupBy(F.col("dataset").alias("dataset_id")).agg(
        F.max((F.col("section") == "error").cast("int")).alias("_failed")
    )
    return catalog.join(seen, "dataset_id", "left").select(
        "dataset_id",
        F.when(F.col("_failed").isNull(), "processing").when(F.col("_failed") == 1, "error").otherwise("ready").alias("status"),
    )


def log_entries(answers: DataFrame) -> DataFrame:
    """Log rows from answered questions: adds answer_summary, the first 200 characters, trimmed."""
    return answers.withColumn("answer_summary", F.trim(F.substring(F.coalesce("answer", F.lit("")), 1, SUMMARY_CHARS)))


def append(rows: DataFrame, root: str) -> None:
    rows.write.mode("append").partitionBy("dataset_id").parquet(root)


def recent(log: DataFrame, n: int = 20) -> DataFrame:
    """The newest ``n`` entries of every dataset, newest first -> ..., rank."""
    if n < 1:
        raise ValueError("at least one entry")
    return _newest(log, n)


def _newest(log: DataFrame, n: int) -> DataFrame:
    newest = W.partitionBy("dataset_id").orderBy(F.desc("created_at"), F.desc("id"))
    return log.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= n)


def search_log(log: DataFrame, questions: DataFrame, k: int = 3, cut: float = HISTORY_SCORE, embedder=hashed_ngrams) -> DataFrame:
    """Earlier questions of the same dataset, by embedding: the ``k`` nearest, then the cut
    -> question_id, id, dataset_id, score, rank. ``questions``: question_id, dataset_id, question."""
    asked = embed(questions.where(F.trim("question") != ""), "question", embedder).select(
        F.col("question_id").alias("query_id"), F.col("dataset_id").alias("query_group"), "embedding"
    )
    if "question_embedding" in log.columns:
        known = log.select("id", "dataset_id", F.col("question_embedding").alias("embedding"))
    else:
        known = embed(log, "question", embedder)
    items = known.where("embedding is not null").select(
        F.col("id").cast("string").alias("item_id"), F.col("dataset_id").cast("string").alias("item_group"), "embedding"
    )
    found = best_matches(asked, items, k, "same")
    return found.where(F.col("score") > cut).select(
        F.col("query_id").alias("question_id"), F.col("item_id").alias("id"), F.col("item_group").alias("dataset_id"), "score", "rank"
    )


def _apart(texts: DataFrame) -> DataFrame:
    """Texts that a join may not send to every task: Spark's guess of their size is that of their compressed columns."""
    return texts.hint("merge")


def _with_known(
    asked: DataFrame, known: DataFrame, keys: Sequence[str] = ("dataset_id",), idents: tuple[str, str] = ("question_id", "id")
) -> DataFrame:
    """Questions joined to the known entries that agree in ``keys``; ``idents`` tell the rows of each side apart.

    A key may hold a large share of all rows: both sides are counted, cut into blocks of about
    ``BLOCK_ROWS``, and every block of one meets every block of the other in a task of its own.
    """

    def blocks(frame, alias):
        return frame.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("bigint").alias(alias))

    sizes = blocks(asked, "_na").join(blocks(known, "_nk"), list(keys))

    def dealt(frame, ident, own, count, other, others):
        return (
            frame.join(_apart(sizes), list(keys))
            .withColumn(own, F.pmod(F.xxhash64(ident), F.col(count)))
            .withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(others) - 1)))
            .drop("_na", "_nk")
        )

    left = dealt(asked, idents[0], "_a", "_na", "_k", "_nk")
    right = dealt(known, idents[1], "_k", "_nk", "_a", "_na")
    by = [*keys, "_a", "_k"]
    return left.join(_apart(right), by).drop("_a", "_k")


#: Letters of the keys by which similar texts meet.
TEXT_GRAM = 4
#: A first look for good matches: so many of a question's rarest keys, each in so many known texts at most.
FIRST_KEYS = 8
FIRST_TEXTS = 32


def _ratio(cut: float):
    @F.pandas_udf("double")
    def ratio(new: pd.Series, old: pd.Series) -> pd.Series:
        return kernels.text_ratio(new, old, cut)

    # So that a filter on the score does not work it out a second time, or before pairs are made distinct.
    return ratio.asNondeterministic()


def text_pairs(asked: DataFrame, known: DataFrame, entries: DataFrame, k: int, cut: float) -> DataFrame:
    """Pairs among which are the ``k`` entries most similar to each question, above ``cut`` -> dataset_id, y, x.
    ``asked``: dataset_id, y; ``known``: dataset_id, x; both folded, different texts; ``entries``: dataset_id, x, at, id.

    Texts whose matched letters are the part r of their letters share a good part of their runs of four letters: an unmatched
    letter of the question breaks four of them, one of the entry three, so at least 7 M - 3 s - 3 of the question's runs
    stand in the entry, M matched letters, s letters of both. A first look at entries that share a rare run finds
    ``k`` good ones for most questions. What is to beat them shares so many runs that it has one of the question's
    rarest runs, as many as may be broken and one more. Only questions for which that number
    says nothing meet all texts whose length allows the score: lengths are put into bands of a factor
    (2 - cut) / cut, and only neighbouring bands meet.
    """
    by = ["dataset_id", "gram"]
    # Texts are numbered: runs and pairs go with numbers, texts only to the pairs that are scored.
    asked, known = _numbered(asked, "y_id"), _numbered(known, "x_id")
    in_known = write_through(known.select("dataset_id", "x_id", F.explode(_grams("x", [TEXT_GRAM])).alias("gram")), "known-runs")
    held = in_known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    own = asked.select("dataset_id", "y_id", F.length("y").alias("ny"), F.explode_outer(_grams("y", [TEXT_GRAM], False)).alias("gram")).join(_apart(held), by, "left")
    own = own.groupBy("dataset_id", "y_id", "ny").agg(
        F.sort_array(F.collect_list(F.when(F.col("gram").isNotNull(), F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")))).alias("gs")
    )
    own = write_through(own, "asked-runs")

    def meeting(keys: DataFrame) -> DataFrame:
        # Rare runs: what one holds is small, and adaptive execution splits one that is not.
        return keys.join(_apart(in_known), by).groupBy("y_id", "x_id").agg(F.count(F.lit(1)).alias("n"))

    def texts(pairs: DataFrame) -> DataFrame:
        return pairs.join(_apart(asked.select("y_id", "y")), "y_id").join(_apart(known), "x_id")

    few = F.slice(F.filter("gs", lambda g: g["n"].between(1, FIRST_TEXTS)), 1, FIRST_KEYS)
    first = meeting(own.select("dataset_id", "y_id", F.explode(F.array_distinct(few)).alias("g")).select("dataset_id", "y_id", "g.gram"))
    # Those with most of the keys are likely the best; any will do as a bound.
    most = W.partitionBy("y_id").orderBy(F.desc("n"), "x_id")
    first = first.withColumn("r", F.row_number().over(most)).where(F.col("r") <= FIRST_ENTRIES + k).select("y_id", "x_id")
    first = texts(first).withColumn("score", _ratio(cut)("y", "x")).where(F.col("score") > cut).join(_apart(entries.select("dataset_id", "x")), ["dataset_id", "x"])
    best = W.partitionBy("y_id").orderBy(F.desc("score"))
    reached = first.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("y_id", F.col("score").alias("reached"))

    to_beat = F.coalesce("reached", F.lit(cut))
    bounded = own.join(_apart(reached), "y_id", "left").withColumn("to_beat", to_beat)
    # The sum of both lengths is at least 2 |y| / (2 - r).
    q = TEXT_GRAM
    shared = 2 * F.col("ny") / (2 - F.col("to_beat")) * ((2 * q - 1) / 2 * F.col("to_beat") - (q - 1)) - (q - 1)
    bounded = write_through(bounded.withColumn("shared", F.floor(shared - 1e-6)), "asked-bounds")
    some = bounded.where("shared >= 1").withColumn("g", F.explode(F.slice("gs", F.lit(1), F.greatest(F.size("gs") - F.col("shared") + 1, F.lit(0)).cast("int"))))
    near = meeting(some.where("g.n > 0").select("dataset_id", "y_id", "g.gram").distinct()).select("y_id", "x_id")

    share = min(max(cut, 1e-6), 1 - 1e-6)
    width = math.log((2 - share) / share) + 1e-9
    band = lambda n: F.floor(F.log(n.cast("double")) / width)
    left = bounded.where("shared < 1").select("dataset_id", "y_id", band(F.col("ny")).alias("band"))
    right = known.select("dataset_id", "x_id", F.explode(F.array(*[band(F.length("x")) + d for d in (-1, 0, 1)])).alias("band"))
    far = _with_known(left, right, ("dataset_id", "band"), ("y_id", "x_id")).select("y_id", "x_id")
    return texts(near.unionByName(far)).select("dataset_id", "y", "x")


def similar_text(log: DataFrame, questions: DataFrame, k: int = 3, cut: float = HISTORY_SCORE) -> DataFrame:
    """Earlier questions of the same dataset, by text: all entries with question and summary count
    -> question_id, id, dataset_id, score, rank. Equal texts are scored once; see ``text_pairs`` for what meets."""

    @F.pandas_udf("string")
    def folded(texts: pd.Series) -> pd.Series:
        return texts.str.casefold()

    asked = questions.select("question_id", "dataset_id", F.trim("question").alias("q")).where("q <> ''")
    asked = write_through(asked.select("question_id", "dataset_id", folded("q").alias("y")), "asked")
    known = log.where((F.trim("question") != "") & (F.trim("answer_summary") != "")).select(
        "dataset_id", "id", F.trim("question").alias("q"), F.col("created_at").alias("at")
    )
    newest = W.partitionBy("dataset_id", "x").orderBy(F.desc("at"), F.desc("id"))
    entries = known.select("dataset_id", "id", "at", folded("q").alias("x")).withColumn("r", F.row_number().over(newest))
    entries = write_through(entries.where(F.col("r") <= k).drop("r"), "known")
    pairs = text_pairs(asked.select("dataset_id", "y").distinct(), entries.select("dataset_id", "x").distinct(), entries, k, cut)
    scored = pairs.withColumn("score", _ratio(cut)("y", "x")).where(F.col("score") > cut)
    found = scored.join(entries, ["dataset_id", "x"]).join(asked, ["dataset_id", "y"])
    best = W.partitionBy("question_id").orderBy(F.desc("score"), F.desc("at"), F.desc("id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("question_id", "id", "dataset_id", "score", "rank")


#: Characters of the keys by which one text is found inside another.
GRAM = 3


def _grams(text: str, sizes: Sequence[int], different: bool = True) -> Column:
    """The runs of so many characters in a text, as numbers."""
    wanted = tuple(sizes)

    @F.pandas_udf("array<long>")
    def runs(texts: pd.Series) -> pd.Series:
        return kernels.letter_runs(texts, wanted, different)

    return runs(text)


def _contained(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of texts of which one may hold the other -> y_id, x_id.

    A text is looked for under one key: itself if it has GRAM characters at most, else its GRAM characters that
    the fewest texts of the other side have. For a short question the newest entry with it is enough. The keys of a
    text go with its number, never with the text.
    """
    sizes = range(1, GRAM + 1)
    by = ["dataset_id", "gram"]
    whole = F.array_max  # of the runs of a short text, itself is the largest number
    full = F.col("gram") >= 1 << 42  # runs of GRAM characters

    def keyed(frame, text, ident, label, *more):
        runs = frame.select("dataset_id", ident, *more, (F.length(text) <= GRAM).alias("short"), F.explode(_grams(text, sizes)).alias("gram"))
        return write_through(runs, label)

    in_known = keyed(known, "x", "x_id", "known-runs", "newest")
    in_asked = keyed(asked, "y", "y_id", "asked-runs")
    short = asked.where(F.length("y") <= GRAM).select("dataset_id", "y_id", whole(_grams("y", sizes)).alias("gram"))
    newest = in_known.groupBy(*by).agg(F.max(F.struct("newest", "x_id")).alias("top")).select(*by, "top.x_id")
    found = short.join(_apart(newest), by).select("y_id", "x_id")

    def rarest(frame: DataFrame, ident: str, others: DataFrame) -> DataFrame:
        held = others.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        own = frame.where(full & ~F.col("short")).select(*by, ident).join(held, by, "left")
        return own.groupBy("dataset_id", ident).agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("key")
        ).where("key.n > 0").select("dataset_id", ident, F.col("key.gram").alias("gram"))

    def holding(pairs: DataFrame, outer: str, inner: str) -> DataFrame:
        texts = pairs.join(_apart(asked.select("y_id", "y")), "y_id").join(_apart(known.select("x_id", "x")), "x_id")
        return texts.where(F.contains(outer, F.col(inner))).select("y_id", "x_id")

    long = rarest(in_asked, "y_id", in_known.where(full).select(*by))
    met = long.join(_apart(in_known.where(full).select(*by, "x_id")), by).select("y_id", "x_id")
    found = found.unionByName(holding(met, "x", "y"))

    few = known.where(F.length("x") <= GRAM).select("dataset_id", "x_id", whole(_grams("x", sizes)).alias("gram"))
    many = rarest(in_known, "x_id", in_asked.where(full).select(*by))
    met = in_asked.select(*by, "y_id").join(_apart(few.unionByName(many)), by).select("y_id", "x_id")
    return found.unionByName(holding(met, "y", "x"))


def _ordered(frame: DataFrame, ident: str, words: str, held: DataFrame, *more: str) -> DataFrame:
    """Different words of each text with their counts, rare ones first -> ident, ws, size."""
    own = frame.select("dataset_id", ident, *more, F.explode(words).alias("w")).groupBy("dataset_id", ident, *more, "w").agg(F.count(F.lit(1)).alias("c"))
    return own.join(held, ["dataset_id", "w"], "left").groupBy("dataset_id", ident, *more).agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w", "c"))).alias("ws"), F.sum("c").alias("size")
    )


def _words_held(known: DataFrame) -> DataFrame:
    return known.select("dataset_id", F.explode(F.array_distinct("xs")).alias("w")).groupBy("dataset_id", "w").agg(F.count(F.lit(1)).alias("n"))


def _scored(pairs: DataFrame, asked: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs with both texts' score -> y_id, score, newest, to_beat."""
    texts = pairs.select("y_id", "x_id").join(_apart(asked.select("y_id", "y", "to_beat")), "y_id").join(_apart(known.select("x_id", "x", "newest")), "x_id")
    score = overlap_score(F.col("x"), words_of(F.col("x")), F.col("y"), words_of(F.col("y")))
    return texts.select("y_id", score.alias("score"), "newest", "to_beat")


#: A first look for a good match: a question's rarest words, each in so many texts at most, and the texts that hold most of them.
FIRST_WORDS = 8
FIRST_ENTRIES = 4


def _bounded(asked: DataFrame, known: DataFrame, accept: float) -> DataFrame:
    """``asked`` with what the best entry scores at least, ``to_beat``: 1 where the text itself is known, else the best
    score of a first look or ``accept``."""
    itself = known.select("dataset_id", F.col("x").alias("y"), F.lit(1.0).alias("itself"))
    asked = write_through(asked.join(_apart(itself), ["dataset_id", "y"], "left").withColumn("to_beat", F.coalesce("itself", F.lit(float(accept)))).drop("itself"), "asked-known")
    held = _words_held(known).where(F.col("n") <= FIRST_TEXTS)
    own = _ordered(asked.where("to_beat < 1"), "y_id", "ys", held)
    few = own.select("dataset_id", "y_id", F.explode(F.slice(F.filter("ws", lambda v: v["n"] > 0), 1, FIRST_WORDS)).alias("v")).select("dataset_id", "y_id", "v.w")
    in_known = known.select("dataset_id", "x_id", F.explode(F.array_distinct("xs")).alias("w"))
    # At most FIRST_WORDS * FIRST_TEXTS for a question.
    met = few.join(_apart(in_known), ["dataset_id", "w"]).groupBy("y_id", "x_id").agg(F.count(F.lit(1)).alias("n"))
    most = W.partitionBy("y_id").orderBy(F.desc("n"), "x_id")
    met = met.withColumn("r", F.row_number().over(most)).where(F.col("r") <= FIRST_ENTRIES)
    reached = _scored(met, asked, known).groupBy("y_id").agg(F.max("score").alias("reached"))
    better = F.greatest("to_beat", F.coalesce("reached", F.lit(0.0)))
    return write_through(asked.join(_apart(reached), "y_id", "left").withColumn("to_beat", better).drop("reached"), "asked-bounds")


def _sharing(asked: DataFrame, known: DataFrame, accept: float) -> DataFrame:
    """Pairs of texts that can share enough words to reach the question's ``to_beat`` (``accept`` at least) -> y_id, x_id.

    Words are put in one order for a dataset, rare ones first. A question may lack the part 1 - ``to_beat`` of its words,
    so one of its first words, just more than that part, must be in the entry. Where no word of the question
    repeats, the same holds for the words of the entry. Lengths that cannot reach ``to_beat`` do not meet.
    """
    by = ["dataset_id", "w"]
    held = _words_held(known)

    def numbered(ws: str) -> Column:
        """Words with the number of words before them."""
        return F.expr(
            f"transform({ws}, (v, i) -> struct(v.n AS n, v.w AS w, aggregate(slice({ws}, 1, i), 0L, (a, u) -> a + u.c) AS before))"
        )

    left = _ordered(asked, "y_id", "ys", held, "to_beat").withColumn("repeats", F.exists("ws", lambda v: v["c"] > 1))
    slack = F.col("size") * (1 - F.col("to_beat")) + 1e-9
    first = F.explode(F.filter(numbered("ws"), lambda v: v["before"] <= slack)).alias("v")
    left = left.select("dataset_id", "y_id", "to_beat", "repeats", F.col("size").alias("ny"), first).where("v.n > 0")
    right = _ordered(known, "x_id", "xs", held)
    # Of the different words of an entry at least to_beat * size must be met, if none counts twice.
    place = F.expr("transform(ws, (v, i) -> struct(v.w AS w, i AS before))")
    right = right.select("dataset_id", "x_id", F.col("size").alias("nx"), F.size("ws").alias("dx"), F.explode(place).alias("v"))
    met = _with_known(
        left.select("dataset_id", "y_id", "ny", "to_beat", "repeats", F.col("v.w").alias("w")),
        right.select("dataset_id", "x_id", "nx", "dx", F.col("v.w").alias("w"), F.col("v.before").alias("before")),
        by,
        ("y_id", "x_id"),
    )
    nx, ny, least = F.col("nx"), F.col("ny"), F.col("to_beat")
    early = F.col("before") <= F.col("dx") - nx * least + 1e-9
    met = met.where((ny >= nx * least - 1e-9) & (F.col("repeats") | (early & (nx >= ny * least - 1e-9))))
    return met.select("y_id", "x_id").distinct()


def _numbered(frame: DataFrame, ident: str) -> DataFrame:
    """Rows with a number each, written once so that it stays."""
    return write_through(frame.withColumn(ident, F.monotonically_increasing_id()), ident)


def overlap_candidates(asked: DataFrame, known: DataFrame, accept: float) -> DataFrame:
    """Pairs of different texts of a dataset among which is the best of each question, if it reaches ``accept`` -> y_id, x_id.
    ``asked``: dataset_id, y, ys; ``known``: dataset_id, x, xs, newest; texts are plain, not empty, and come once. They are
    told apart by their numbers y_id and x_id, which are given here where missing."""
    asked = asked if "y_id" in asked.columns else _numbered(asked, "y_id")
    known = known if "x_id" in known.columns else _numbered(known, "x_id")
    asked = asked if "to_beat" in asked.columns else _bounded(asked, known, accept)
    pairs = _sharing(asked, known, accept)
    # Questions that have something better need not look for texts that hold them.
    open_ = asked.where(F.col("to_beat") <= CONTAINED_SCORE)
    if accept <= CONTAINED_SCORE and not open_.isEmpty():
        pairs = pairs.unionByName(_contained(open_.select("dataset_id", "y_id", "y"), known.select("dataset_id", "x_id", "x", "newest")))
    equal = asked.select("dataset_id", "y", "y_id").join(_apart(known.select("dataset_id", F.col("x").alias("y"), "x_id")), ["dataset_id", "y"])
    return pairs.unionByName(equal.select("y_id", "x_id"))


def overlapping(log: DataFrame, questions: DataFrame, accept: float = ACCEPTED_OVERLAP) -> DataFrame:
    """The question of the same dataset, over the whole log, sharing most words with a new one; of equal scores the
    newest -> question_id, id, score.

    Equal texts count once on both sides. Pairs meet by keys that any pair shares which can reach the best score found by
    a first look (see ``overlap_candidates``), not all with all. Until they are scored, pairs are pairs of numbers.
    """
    if not 0 < accept <= 1:
        raise ValueError("accept lies above 0, up to 1")
    texts = questions.select("question_id", "dataset_id", plain(F.col("question")).alias("y")).where("y <> ''")
    asked = texts.select("dataset_id", "y").distinct().withColumn("ys", words_of(F.col("y")))
    known = log.select("dataset_id", plain(F.col("question")).alias("x"), F.struct(F.col("created_at").alias("at"), "id").alias("own"))
    known = known.where("x <> ''").groupBy("dataset_id", "x").agg(F.max("own").alias("newest"))
    known = _numbered(known.withColumn("xs", words_of(F.col("x"))), "x_id")
    asked = _bounded(_numbered(asked, "y_id"), known, accept)
    scored = _scored(overlap_candidates(asked, known, accept).distinct(), asked, known).where(F.col("score") >= accept)
    best = scored.groupBy("y_id").agg(F.max(F.struct("score", "newest")).alias("best"))
    best = best.join(_apart(asked.select("y_id", "dataset_id", "y")), "y_id")
    return texts.join(_apart(best), ["dataset_id", "y"]).select("question_id", F.col("best.newest.id").alias("id"), F.col("best.score").alias("score"))


def log_with_names(log: DataFrame, catalog: DataFrame) -> DataFrame:
    """Log entries with their dataset's name, newest first."""
    return log.join(catalog.select("dataset_id", "name"), "dataset_id").orderBy(F.desc("created_at"), "id")


def answers(log: DataFrame) -> DataFrame:
    """-> id, dataset_id, question, answer (out of the response document), created_at."""
    answer = F.coalesce(F.get_json_object("response_json", "$.answer"), F.lit(""))
    return log.select("id", "dataset_id", "question", answer.alias("answer"), "created_at")


# Short words that never count as a column name.
STOP_WORDS = ("at", "in", "on", "to", "of", "for", "and", "or", "vs", "x", "y")
SHORT_NAME = 3
WORD = r"([\p{L}\p{N}_]+)"
# Names sent to every task: at most so many, counted first.
MAX_BROADCAST_NAMES = 65536


def mentions(questions: DataFrame, registry: DataFrame) -> DataFrame:
    """Columns named in a question -> question_id, dataset_id, column_name, position, rank.

    A name matches as whole words of any script, ignoring case. Candidates come from an
    equality join on the first word of the name, and only they are searched
    for in the text, so no question meets every name. Few names travel to the
    words; neither words nor questions are ever sent whole to every task, as the
    size Spark guesses for them is that of their compressed files.
    ``questions``: question_id, dataset_id, question.
    """
    lowered = F.lower("column_name")
    names = (
        registry.select("dataset_id", "column_name")
        .distinct()
        .withColumn("_word", F.regexp_extract(lowered, WORD, 1))
        .where("_word <> ''")
        .where(
            (F.length("column_name") > SHORT_NAME)
            | (lowered.rlike("^[a-z0-9]+$") & ~lowered.isin(list(STOP_WORDS)))
        )
    )
    words = F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit(WORD), F.lit(1)))
    few = names.limit(MAX_BROADCAST_NAMES + 1).count() <= MAX_BROADCAST_NAMES
    candidates = (
        questions.select("question_id", "dataset_id", F.explode(words).alias("_word"))
        .join(F.broadcast(names) if few else names.hint("merge"), ["dataset_id", "_word"])
        .drop("_word")
    )
    literal = F.replace(F.col("column_name"), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    pattern = F.concat(F.lit("(?iuU)\\b\\Q"), literal, F.lit("\\E\\b"))
    found = (
        candidates.join(questions.hint("merge"), ["question_id", "dataset_id"])
        .withColumn("position", F.regexp_instr("question", pattern) - 1)
        .where("position >= 0")
        .select("question_id", "dataset_id", "column_name", "position")
    )
    order = W.partitionBy("question_id", "dataset_id").orderBy("position", "column_name")
    return found.withColumn("rank", F.row_number().over(order))


def chosen_columns(mentioned: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` columns a question names."""
    return mentioned.where(F.col("rank") <= n)
