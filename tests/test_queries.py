"""Every registered query against its SQL in DuckDB, and the shape of the entry points."""

import check
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return check.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    verdict, _ = check.compare(spark, duck, sf_dir, name, QUERIES[name], ORACLES.get(name))
    assert verdict.startswith(("ok", "rows-only")), verdict


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_is_a_profile(spark):
    facts = entry.entry(spark)
    assert facts.columns == ["dataset", "section", "column_name", "metric", "value_double", "value_string"]
    assert {r["section"] for r in facts.select("section").distinct().collect()} >= {"shape", "duplicates", "flag", "numeric"}
