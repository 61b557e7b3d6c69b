"""The stored vector index: exact joins that skip cells, searches that read few of them, batches added later."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetwise.operators import cells, vectors

COLUMNS = "column_name string, dataset_id string, embedding array<double>"


def clustered(n=400, hubs=8, dims=12, seed=3):
    """Vectors close around a few directions, some equal, one without a direction."""
    rng = np.random.default_rng(seed)
    hub = rng.normal(size=(hubs, dims))
    rows = [(f"c{i:03d}", f"d{i % 5}", (hub[i % hubs] + 0.1 * rng.normal(size=dims)).tolist()) for i in range(n)]
    rows += [("copy", "d9", rows[7][2]), ("zero", "d0", [0.0] * dims), ("none", "d0", None)]
    return rows


def exact(rows, queries, k, relation, least=None):
    out = []
    for q, qg, qv in queries:
        scored = []
        for i, g, v in rows:
            if v is None or not any(v) or qv is None or not any(qv):
                continue
            if relation == "other" and g == qg or relation == "same" and g != qg:
                continue
            score = round(float(np.dot(qv, v) / np.linalg.norm(qv) / np.linalg.norm(v)), 9)
            if least is None or score >= least:
                scored.append((-score, i))
        out += [(q, r + 1, i) for r, (_, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "vectors")
    rows = clustered()
    cells.write_index(spark.createDataFrame(rows[:300], COLUMNS), path, cells=8)
    cells.add_to_index(spark.createDataFrame(rows[300:], COLUMNS), path, "late")
    return path, rows


def asked(spark, rows):
    return spark.createDataFrame(rows, "query_id string, query_group string, embedding array<double>")


@pytest.mark.parametrize("relation", ["any", "same", "other"])
@pytest.mark.parametrize("least", [None, 0.95])
def test_join_is_exact_and_skips_cells(spark, index, relation, least):
    path, rows = index
    queries = rows[::13] + [("zero", "d0", [0.0] * 12)]
    joined = cells.join_index(asked(spark, queries), path, 4, relation, least)
    found = sorted((r["query_id"], r["rank"], r["item_id"]) for r in joined.found.collect())
    assert found == exact(rows, queries, 4, relation, least)
    scored = joined.visits.agg(F.sum("n")).head()[0]
    assert scored < 0.5 * len(rows) * len(queries)


def test_small_cells_do_not_lose_rows(spark, index):
    """More rows wanted than the nearest cell holds: every cell is visited, none twice."""
    path, rows = index
    joined = cells.join_index(asked(spark, rows[:3]), path, 500)
    assert joined.found.groupBy("query_id").count().collect()[0]["count"] == len(rows) - 2
    assert joined.visits.count() == joined.visits.distinct().count()


def test_search_reads_folders_of_the_nearest_cells_only(spark, index):
    path, rows = index
    found = cells.search_index(spark, path, rows[7][2], 10, probes=2)
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [", 1)[1].split("]")[0]
    ids = [r["item_id"] for r in found.orderBy("rank").collect()]
    assert ids[:2] == ["c007", "copy"]
    everything = {r["item_id"] for r in cells.search_index(spark, path, rows[7][2], 10, probes=8).collect()}
    assert everything == {i for _, _, i in exact(rows, [rows[7]], 10, "any")}


def test_a_batch_counts_once_it_is_whole_and_replaces_itself(spark, index, tmp_path):
    rows = clustered(80, 4)
    path = str(tmp_path / "again")
    cells.write_index(spark.createDataFrame(rows, COLUMNS), path, cells=4)
    fresh = spark.createDataFrame([("new", "d1", rows[0][2])], COLUMNS)
    for _ in range(2):
        cells.add_to_index(fresh, path, "late")
    # Rows whose reach was never written, as after a lost job.
    fresh.selectExpr("'lost' AS item_id", "dataset_id AS item_group", "embedding", "0D AS angle", "0 AS cell").write.partitionBy("cell").parquet(f"{path}/rows/batch=broken")
    cells.add_to_index(fresh.limit(0), path, "empty")
    known = cells.read_cells(spark, path)
    stored = [r["item_id"] for r in cells.index_rows(spark, path, known).collect()]
    assert stored.count("new") == 1 and "lost" not in stored and len(stored) == 82 == known.counts.sum()


def test_probes_follow_from_the_sample(spark, index):
    path, rows = index
    queries = asked(spark, rows[:40])
    few, all_of_them = cells.probes_for(queries, path, 4, 0.9), cells.probes_for(queries, path, 400, 1.0)
    assert few <= 3 and all_of_them == sum(cells.read_cells(spark, path).counts > 0)


def test_recall_of_the_registered_search(spark):
    from facetwise.plans import search_queries as Q

    sf_dir = "/root/testdata/sf0.01"
    found = {(r["query_id"], r["item_id"]) for r in Q.index_probe(spark, sf_dir).collect()}
    items = vectors._items(Q.registry(spark, sf_dir), "column_name", "dataset_id")
    truth = {(r["query_id"], r["item_id"]) for r in vectors.best_matches(Q.hundredths(spark, sf_dir), items, 10).collect()}
    assert len(found & truth) >= 0.9 * len(truth)
