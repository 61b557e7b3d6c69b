"""Question routing, mentions, log search and vector search."""

import difflib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from facetwise import kernels
from facetwise.functions import text
from facetwise.operators import catalog, vectors

# Question texts and the intent each must get.
CASES = [
    ("hi", "smalltalk"), ("Hello there!", "smalltalk"), ("thanks for your help", "smalltalk"), ("what are you?", "smalltalk"),
    ("tell me about the data", "descriptive"), ("Summarize the dataset", "descriptive"), ("what columns exist", "descriptive"),
    ("show schema", "descriptive"), ("which product sold most", "analytical"), ("Compare average sentiment by month", "analytical"),
    ("which two columns are related?", "correlation"), ("show correlation between sales and month", "correlation"),
    ("", "analytical"), ("   ", "analytical"), ("summarize missing values and duplicates", "descriptive"),
    ("Is LoanAmount / ApplicantIncome (loan burden) related to approval? Summarize by burden quartiles", "analytical"),
    ("What is the total_sales for each product?", "analytical"), ("hi, what columns exist?", "smalltalk"),
    ("group by region", "clustering"), ("what is the trend", "forecast"), (None, "analytical"),
]


def test_intents(spark):
    frame = spark.createDataFrame([(i, q, want) for i, (q, want) in enumerate(CASES)], "i int, q string, want string")
    wrong = frame.withColumn("got", text.intent(F.col("q"))).where("got <> want").collect()
    assert wrong == []


def test_chart_words_match_inside_words(spark):
    frame = spark.createDataFrame([("sales per district",), ("nothing here",)], "q string")
    assert [r[0] for r in frame.select(text.wants_chart(F.col("q"))).collect()] == [True, False]


@pytest.mark.parametrize(
    "a,b,score",
    [("Sales by month", "sales-by_month!", 1.0), ("sales by month", "show sales by month", 0.92), ("a b c d", "d c x y", 0.5),
     ("b a", "a a c", 2 / 3), ("", "x", 0.0)],
)
def test_token_overlap(spark, a, b, score):
    frame = spark.createDataFrame([(a, b)], "a string, b string")
    assert frame.select(text.token_overlap(F.col("a"), F.col("b"))).head()[0] == pytest.approx(score)


def test_mentions(spark):
    questions = spark.createDataFrame(
        [(1, "d", "Plot AT against Loan Amount and a.b_c"), (2, "d", "at the total, by total_sales"), (3, "d", "RH vs x")],
        "question_id int, dataset_id string, question string",
    )
    names = ["AT", "at", "Loan Amount", "total", "total_sales", "b_c", "a.b_c", "RH", "x", "Loan"]
    registry = spark.createDataFrame([("d", n) for n in names], "dataset_id string, column_name string")
    found = catalog.mentions(questions, registry).orderBy("question_id", "rank").collect()
    got = {}
    for r in found:
        got.setdefault(r["question_id"], []).append((r["column_name"], r["position"]))
    assert got[1] == [("Loan", 16), ("Loan Amount", 16), ("a.b_c", 32)]
    assert got[2] == [("total", 7), ("total_sales", 17)]
    assert got[3] == [("RH", 0)]


def test_mentions_in_any_script(spark):
    questions = spark.createDataFrame([(1, "d", "покажи Выручка и größe, nicht Größen")], "question_id int, dataset_id string, question string")
    registry = spark.createDataFrame([("d", n) for n in ("выручка", "Größe", "выруч")], "dataset_id string, column_name string")
    found = catalog.mentions(questions, registry).orderBy("rank").collect()
    assert [(r["column_name"], r["position"]) for r in found] == [("выручка", 7), ("Größe", 17)]


def log_of(spark, questions):
    rows = [(f"{i:03d}", d, q, "an answer", i) for i, (d, q) in enumerate(questions)]
    frame = spark.createDataFrame(rows, "id string, dataset_id string, question string, answer_summary string, t int")
    return frame.withColumn("created_at", F.timestamp_seconds("t"))


def test_log_search_finds_exact_text_in_its_dataset_only(spark):
    log = log_of(spark, [("a", "Top 5 products by revenue"), ("a", "something else entirely"), ("b", "Top 5 products by revenue")])
    asked = spark.createDataFrame([("q", "a", "top 5 products by revenue"), ("r", "c", "top 5 products by revenue")], "question_id string, dataset_id string, question string")
    for found in (catalog.similar_text(log, asked).collect(), catalog.search_log(log, asked).collect()):
        assert [(r["question_id"], r["id"]) for r in found] == [("q", "000")]
        assert found[0]["score"] >= 0.99


def test_text_search_reaches_the_oldest_entries(spark, monkeypatch):
    log = log_of(spark, [("a", "Top 5 products by revenue")] + [("a", f"number {i} of many others") for i in range(300)])
    asked = spark.createDataFrame([("q", "a", "top 5 products by revenue?")], "question_id string, dataset_id string, question string")
    one = [r["id"] for r in catalog.similar_text(log, asked).collect()]
    monkeypatch.setattr(catalog, "BLOCK_ROWS", 7)
    assert one == ["000"] == [r["id"] for r in catalog.similar_text(log, asked).collect()]


def test_upsert_takes_the_last_of_repeated_keys(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "k string, t int, v string")
    new = spark.createDataFrame([("a", 2, "y"), ("a", 3, "z"), ("a", 3, "w")], "k string, t int, v string")
    assert sorted(map(tuple, vectors.upsert(old, new, ["k"], ["t"]).collect())) == [("a", 3, "z"), ("b", 1, "x")]


def test_recent_is_newest_first_and_whole(spark):
    log = log_of(spark, [("a", f"q{i}") for i in range(5)])
    with pytest.raises(ValueError):
        catalog.recent(log, 0)
    assert catalog.recent(log_of(spark, [("a", f"q{i}") for i in range(150)]), 150).count() == 150
    assert [r["id"] for r in catalog.recent(log, 3).orderBy("rank").collect()] == ["004", "003", "002"]


def test_text_ratio_equals_the_plain_matcher():
    rng = np.random.default_rng(0)
    words = ["sales", "Straße", "by", "month", "region", "total", "the", "of"]
    new = [" ".join(rng.choice(words, 6)) for _ in range(200)]
    old = [" ".join(rng.choice(words, 6)) for _ in range(200)]
    got = kernels.text_ratio(pd.Series(new), pd.Series(old), 0.6)
    plain = [difflib.SequenceMatcher(None, a.casefold(), b.casefold()).ratio() for a, b in zip(new, old)]
    assert list(got) == [r if r > 0.6 else 0.0 for r in plain]
    assert (got > 0).any() and (got == 0).any()


def test_best_rows_break_ties_by_key():
    scores = np.array([[0.5, 0.9, 0.9, 0.9, -np.inf]])
    rows, cols = kernels.best_rows(scores, np.array(["e", "c", "a", "b", "0"]), 2)
    assert list(cols) == [2, 3]


def test_nearest_ignores_zero_vectors_and_keeps_k(spark):
    rows = [(f"c{i}", "d", [1.0, float(i)]) for i in range(10)] + [("zero", "d", [0.0, 0.0])]
    registry = spark.createDataFrame(rows, "column_name string, dataset_id string, embedding array<double>")
    found = vectors.nearest(registry, [1.0, 0.0], 11).orderBy("rank").collect()
    assert [r["item_id"] for r in found] == [f"c{i}" for i in range(10)]


def test_index_recall(spark, sf_dir):
    from facetwise.plans.search_queries import registry

    frame = registry(spark, sf_dir)
    vector = frame.where("column_name = 'v000007'").head()["embedding"]
    index, centres = vectors.build_index(frame, cells=4)
    exact = {r["item_id"] for r in vectors.nearest(frame, vector, 10).collect()}
    everything = {r["item_id"] for r in vectors.probe(index, centres, vector, 10, cells=4).collect()}
    some = {r["item_id"] for r in vectors.probe(index, centres, vector, 10, cells=2).collect()}
    assert everything == exact and len(exact & some) >= 5


def test_embeddings_are_unit_length_and_rank_alike_texts_first(spark):
    frame = spark.createDataFrame([("a", "retail price of a part"), ("b", "part retail price"), ("c", "nation key")], "id string, t string")
    rows = {r["id"]: np.array(r["embedding"]) for r in vectors.embed(frame, "t").collect()}
    assert all(len(v) == vectors.DIMENSIONS and np.linalg.norm(v) == pytest.approx(1.0, abs=1e-5) for v in rows.values())
    assert rows["a"] @ rows["b"] > rows["a"] @ rows["c"]


@pytest.mark.parametrize("relation", ["any", "same", "other"])
def test_blocks_give_the_same_matches(spark, sf_dir, relation, monkeypatch):
    from facetwise.plans.search_queries import registry

    frame = registry(spark, sf_dir)
    queries = frame.where("column_name < 'v000040'")
    queries = queries.select(F.col("column_name").alias("query_id"), F.col("dataset_id").alias("query_group"), "embedding")
    items = vectors._items(frame, "column_name", "dataset_id")

    def rows(**kwargs):
        found = vectors.best_matches(queries, items, 4, relation, **kwargs)
        return sorted((r["query_id"], r["rank"], r["item_id"], round(r["score"], 6)) for r in found.collect())

    sent = rows()
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vectors, "ITEM_BLOCK", 50)
    assert rows(limit=3) == sent and len(sent) >= 150


def test_running_best_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        rows = [(f"c{i:03d}", "d", [1.0, float((i * 37) % 200)]) for i in range(200)]
        registry = spark.createDataFrame(rows, "column_name string, dataset_id string, embedding array<double>").coalesce(1)
        found = vectors.nearest(registry, [1.0, 0.0], 5).orderBy("rank").collect()
        by_second = sorted(rows, key=lambda r: r[2][1])
        assert [r["item_id"] for r in found] == [r[0] for r in by_second[:5]]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plain_text(text):
    text = re.sub(r"[_\-]+", " ", (text or "").strip(" ").lower())
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", "", text))


def overlap(x, y):
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    if x in y or y in x:
        return 0.92
    xs, ys = [w for w in x.split(" ") if w], [w for w in y.split(" ") if w]
    return sum(w in set(xs) for w in ys) / max(len(xs), len(ys)) if xs and ys else 0.0


@pytest.mark.parametrize("accept", [0.34, 0.78, 1.0])
def test_overlap_over_the_whole_log(spark, accept):
    rng = random.Random(int(accept * 100))
    words = ["show", "sales", "by", "month", "a", "of", "the", "Region", "x-y", "to_tal", "is"]
    some = lambda: rng.choice(["", " ", "?", "--"]) + " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 5, 8]))) + rng.choice(["", "?", "s"])
    entries = [(f"{i:03d}", f"d{i % 3}", some()) for i in range(150)] + [("900", "d0", None), ("901", "d1", "--"), ("902", None, "sales by month")]
    log = spark.createDataFrame([(i, d, q, n) for n, (i, d, q) in enumerate(entries)], "id string, dataset_id string, question string, n int").withColumn(
        "created_at", F.expr("TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(n % 40)")
    )
    asked = [(f"q{i}", f"d{i % 4}", some()) for i in range(60)] + [("qa", "d1", "ale"), ("qb", "d1", "a"), ("qc", "d0", None), ("qd", "d2", "th ow"), ("qe", "d0", " - ")]
    asked += [("qf", "d0", entries[0][2]), ("qg", "d0", entries[0][2])]
    got = catalog.overlapping(log, spark.createDataFrame(asked, "question_id string, dataset_id string, question string"), accept).collect()
    want = {}
    for q, d, y in asked:
        scored = [(overlap(plain_text(x), plain_text(y)), n % 40, i) for n, (i, e, x) in enumerate(entries) if e == d]
        best = max(scored, default=(0.0,))
        if best[0] >= accept:
            want[q] = (best[2], pytest.approx(best[0]))
    assert {r["question_id"]: (r["id"], r["score"]) for r in got} == want and len(want) >= (20 if accept < 0.5 else 4)


def test_only_texts_that_can_reach_the_score_meet(spark):
    """A log of a template: no words but common ones are shared, so hardly any pairs come up."""
    texts = [(f"{i:04d}", "d", f"show w{i} of v{i * 7} by u{i * 3} and t{i} per s{i}") for i in range(400)]
    log = spark.createDataFrame(texts, "id string, dataset_id string, question string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    known = log.select("dataset_id", F.col("question").alias("x"), F.struct("created_at", "id").alias("newest")).withColumn("xs", F.split("x", " "))
    asked = known.select("dataset_id", F.col("x").alias("y"), F.col("xs").alias("ys"))
    assert catalog.overlap_candidates(asked, known, 0.78).count() <= 4 * 400  # each text meets itself, by each kind of key
    with pytest.raises(ValueError):
        catalog.overlapping(log, log, 0.0)


@pytest.mark.parametrize("k", [1, 3])
def test_text_search_equals_all_pairs(spark, k):
    rng = random.Random(k)
    words = ["sales", "Straße", "by", "month", "region", "total", "the", "of", "profit", "customer"]
    some = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))
    texts = [some() for _ in range(60)]
    change = lambda t: "".join(c for c in t if rng.random() > 0.04) + rng.choice(["", "?", " now"])
    log = log_of(spark, [(f"d{i % 2}", rng.choice(texts) if i % 3 else some()) for i in range(160)])
    asked = [(f"q{i}", f"d{i % 3}", change(rng.choice(texts)) if i % 4 else some().upper()) for i in range(50)] + [("qx", "d0", " "), ("qy", "d0", "a")]
    got = catalog.similar_text(log, spark.createDataFrame(asked, "question_id string, dataset_id string, question string"), k, 0.7).collect()
    want, entries = {}, log.collect()
    for q, d, y in asked:
        scored = []
        for r in entries:
            if r["dataset_id"] == d and y.strip():
                score = difflib.SequenceMatcher(None, y.strip().casefold(), r["question"].strip().casefold()).ratio()
                if score > 0.7:
                    scored.append((-score, -r["t"], r["id"]))
        for rank, (score, _, i) in enumerate(sorted(scored)[:k], 1):
            want[q, rank] = (i, pytest.approx(-score))
    assert {(r["question_id"], r["rank"]): (r["id"], r["score"]) for r in got} == want and len(want) > 15


def test_near_copies_meet_few_texts(spark):
    """Questions with a near copy in the log are scored against few texts, not against all of their length."""
    rng = random.Random(2)
    letters = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    texts = [" ".join(letters() for _ in range(12)) for _ in range(300)]
    known = spark.createDataFrame([("d", t) for t in texts], "dataset_id string, x string")
    asked = spark.createDataFrame([("d", t + "?") for t in texts], "dataset_id string, y string")
    entries = known.select("dataset_id", "x", F.lit("1").alias("id"), F.lit(1).alias("at"))
    assert catalog.text_pairs(asked, known, entries, 1, 0.75).count() < 0.01 * 300 * 300


def test_only_names_travel_to_every_task(spark, tmp_path):
    """Files are small against their rows: neither words nor questions may be broadcast."""
    questions = [(i, "d", f"total of Region {i % 7}, per region") for i in range(300)]
    spark.createDataFrame(questions, "question_id int, dataset_id string, question string").write.parquet(str(tmp_path / "q"))
    registry = spark.createDataFrame([("d", "region"), ("d", "month")], "dataset_id string, column_name string")
    found = catalog.mentions(spark.read.parquet(str(tmp_path / "q")), registry)
    plan = found._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert len(sent) == 1 and "BuildRight" in sent[0] and "SortMergeJoin" in plan
    assert [(r["column_name"], r["position"], r["rank"]) for r in found.where("question_id = 5").collect()] == [("region", 9, 1)]


def test_known_texts_meet_few_others(spark):
    """Texts that are in the log have the best score there is: only what can equal it is looked at, by numbers."""
    rng = random.Random(5)
    words = [f"w{i:02d}" for i in range(40)]
    texts = [("d", " ".join(rng.sample(words, 8))) for _ in range(300)]
    known = spark.createDataFrame(texts, "dataset_id string, x string").withColumn("xs", F.split("x", " "))
    known = known.withColumn("newest", F.struct(F.lit(1).alias("at"), F.col("x").alias("id")))
    asked = known.select("dataset_id", F.col("x").alias("y"), F.col("xs").alias("ys"))
    pairs = catalog.overlap_candidates(asked, known, 0.25)
    assert pairs.columns == ["y_id", "x_id"] and pairs.count() < 0.2 * 300 * 300


@pytest.mark.parametrize("relation", ["any", "same", "other"])
def test_blocks_hold_few_scores(monkeypatch, relation):
    """However large two blocks are, a task holds SCORE_CELLS scores at a time, and finds the same."""
    import pyarrow as pa

    rng = np.random.default_rng(3)

    def block(n, ident, group):
        vectors_ = pa.array([*rng.normal(size=(n, 4)).tolist()[:-1], [0.0] * 4], pa.list_(pa.float64()))
        return pa.table({ident: [f"{i:03d}" for i in range(n)], group: [(None, "a", "b")[i % 3] for i in range(n)], "embedding": vectors_})

    left, right = block(57, "query_id", "query_group"), block(90, "item_id", "item_group")
    whole = kernels.block_matcher(3, relation)(left, right)
    sizes, scored = [], kernels.similarity
    monkeypatch.setattr(kernels, "similarity", lambda *a: sizes.append((out := scored(*a)).size) or out)
    monkeypatch.setattr(kernels, "SCORE_CELLS", 1000)
    assert kernels.block_matcher(3, relation)(left, right).equals(whole.combine_chunks()) and whole.num_rows == 56 * 3
    assert len(sizes) == 6 and max(sizes) <= 1000
    assert kernels.block_matcher(3, relation)(left, right.slice(0, 0)).num_rows == 0


def test_runs_of_letters_carry_numbers(spark, monkeypatch):
    """Every run of letters is a row: it goes with the number of its text, not with the text."""
    written, write = {}, catalog.write_through
    monkeypatch.setattr(catalog, "write_through", lambda df, label: written.update({label: df.columns}) or write(df, label))
    known = spark.createDataFrame([("d", "sales by month and region"), ("d", "total profit of the north")], "dataset_id string, x string")
    asked = known.select("dataset_id", F.concat("x", F.lit("?")).alias("y"))
    entries = known.select("dataset_id", "x", F.lit("1").alias("id"), F.lit(1).alias("at"))
    assert {tuple(r) for r in catalog.text_pairs(asked, known, entries, 1, 0.75).distinct().collect()} == {("d", r["x"] + "?", r["x"]) for r in known.collect()}
    for label in ("known-runs", "asked-runs", "asked-bounds"):
        assert not {"x", "y"} & set(written[label])
