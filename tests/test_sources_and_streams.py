"""CSV inference, landing checks, exports and streaming jobs."""

import functools
import json
import os

import pytest
from pyspark.sql import functions as F

from facetwise.operators import catalog, profile
from facetwise.sources import tables
from facetwise.streaming import jobs


def write(path, text, mode="w"):
    with open(path, mode) as f:
        f.write(text)


def test_types_survive_missing_value_texts(spark, tmp_path):
    write(tmp_path / "t.csv", 'n,d,b,s,e,big\n1,1.5,True,x,,99999999999999999999\nNA,N/A,,"y, ""z""\n2nd line",null,1\n3,2e3,FALSE,1d,NaN,2\n')
    frame = tables.read_table(spark, str(tmp_path / "t.csv"))
    assert [f.dataType.simpleString() for f in frame.schema.fields] == ["bigint", "double", "boolean", "string", "double", "double"]
    rows = frame.collect()
    assert [r["n"] for r in rows] == [1, None, 3] and [r["d"] for r in rows] == [1.5, None, 2000.0]
    assert rows[1]["s"] == 'y, "z"\n2nd line' and all(r["e"] is None for r in rows)


def test_twenty_row_file(spark, tmp_path):
    write(tmp_path / "s.csv", "id,value\n" + "".join(f"{i},{10 * i}\n" for i in range(1, 21)))
    frame = tables.read_table(spark, str(tmp_path / "s.csv"))
    assert frame.dtypes == [("id", "bigint"), ("value", "bigint")]
    assert frame.agg(F.count("*"), F.sum("value")).head() == (20, 2100)


def test_schema_can_be_given(spark, tmp_path):
    write(tmp_path / "s.csv", "id,when\n1,2024-01-02\nNA,bad\n")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("when", T.DateType())])
    rows = tables.read_table(spark, str(tmp_path / "s.csv"), schema=schema).collect()
    assert rows[0]["id"] == 1 and str(rows[0]["when"]) == "2024-01-02" and rows[1]["when"] is None


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    write(folder / "good.csv", "a,b\n1,x\n2,y\n")
    write(folder / "empty.csv", "")
    write(folder / "notes.txt", "hello")
    write(folder / "oversize.csv", "a\n" + "1\n" * 300)
    write(folder / "broken.csv", b"a\n\xff\xfe\xfa\n", "wb")
    return folder


VERDICTS = {"good.csv": True, "empty.csv": False, "notes.txt": False, "oversize.csv": False, "broken.csv": False}


def test_landing_check(spark, landing):
    found = tables.check_landing(spark, str(landing), max_bytes=500).collect()
    assert {os.path.basename(r["path"]): r["accepted"] for r in found} == VERDICTS
    assert all((r["reason"] is None) == r["accepted"] for r in found)


def test_landing_stream_takes_each_file_once(spark, landing, tmp_path):
    root, mark = str(tmp_path / "root"), str(tmp_path / "mark")
    jobs.stream_ingest(spark, str(landing), root, mark, max_bytes=500).awaitTermination()
    write(landing / "later.csv", "q\n5\n6\n7\n")
    jobs.stream_ingest(spark, str(landing), root, mark, max_bytes=500).awaitTermination()
    rows = spark.read.parquet(f"{root}/catalog").collect()
    assert {(r["name"], r["row_count"], r["col_count"]) for r in rows} == {("good.csv", 2, 2), ("later.csv", 3, 1)}
    # Every file but the empty one, which a stream never sees.
    assert spark.read.parquet(f"{root}/landing").count() == 5
    later = next(r["dataset_id"] for r in rows if r["name"] == "later.csv")
    assert tables.load_table(spark, f"{root}/tables", later).agg(F.sum("q")).head()[0] == 18


def test_exports(spark, tmp_path):
    frame = spark.sql("SELECT 1 AS a, double('NaN') AS x, array(1, 2) AS l, 'say \"hi\", ok' AS s")
    tables.export(frame, str(tmp_path / "j"))
    line = next(open(tmp_path / "j" / f).read() for f in os.listdir(tmp_path / "j") if f.endswith(".json"))
    assert json.loads(line) == {"a": 1, "x": None, "l": [1, 2], "s": 'say "hi", ok'}
    tables.export(frame, str(tmp_path / "c"), "csv")
    back = tables.read_table(spark, str(tmp_path / "c")).head()
    assert back["s"] == 'say "hi", ok' and back["l"] == "[1,2]"
    with pytest.raises(ValueError):
        tables.export(frame, str(tmp_path / "x"), "xml")


def test_merged_batches_equal_the_whole(spark):
    frame = spark.range(1000).select(F.when(F.col("id") % 7 != 0, F.sqrt(F.col("id") + 1e6)).alias("x"), (F.col("id") % 13).alias("y"))
    parts = [frame.where(F.col("y") < 4), frame.where(F.col("y") >= 4), frame.where("y > 99")]
    facts = jobs.batch_facts(parts[0]).unionByName(jobs.batch_facts(parts[1])).unionByName(jobs.batch_facts(parts[2]))
    merged = {r["column_name"]: r for r in jobs.merge_facts(facts).collect()}
    whole = {r["column_name"]: r for r in jobs.merge_facts(jobs.batch_facts(frame)).collect()}
    exact = frame.agg(F.stddev_samp("x"), F.avg("x")).head()
    assert merged["x"]["std"] == pytest.approx(exact[0], rel=1e-9) and merged["x"]["mean"] == pytest.approx(exact[1])
    for name in ("x", "y"):
        assert merged[name]["rows"] == 1000 and merged[name]["missing"] == whole[name]["missing"]
        assert merged[name]["std"] == pytest.approx(whole[name]["std"])


def test_replayed_batch_is_not_counted_twice(spark, tmp_path):
    landing, root = str(tmp_path / "in"), str(tmp_path / "facts")
    spark.range(100).write.parquet(landing)
    stream = spark.readStream.schema("id bigint").parquet(landing)
    for mark in ("one", "two"):
        # A new checkpoint makes the stream start over.
        jobs.stream_profile(stream, root, str(tmp_path / mark)).awaitTermination()
    found = jobs.running_profile(spark, root).head()
    assert found["rows"] == 100 and found["distinct"] == pytest.approx(100, abs=1) and found["median"] in (49.0, 50.0)


def test_sketches_of_batches_keep_their_errors(spark):
    """Distinct values, medians and skews of many uneven batches against the whole table."""
    x = F.pow(F.col("id") % 7919, 2) + 1e6
    frame = spark.range(60_000).select(x.alias("x"), F.when(F.col("id") % 3 > 0, -x).alias("gaps"), (F.col("id") % 3 - 1).alias("few"))
    nothing = F.lit(None).cast("double")
    frame = frame.select("*", nothing.alias("none"), F.lit(0.0).alias("zero"))
    cuts = [0, 1e6, 1.0001e6, 5e6, 2e7, 1e9]
    batches = [jobs.batch_facts(frame.where((F.col("x") >= a) & (F.col("x") < b))) for a, b in zip(cuts, cuts[1:])]
    merged = {r["column_name"]: r for r in jobs.merge_facts(functools.reduce(lambda a, b: a.unionByName(b), batches)).collect()}
    whole = {r["column_name"]: r for r in profile.skews(frame).collect()}
    for name in ("x", "gaps", "few"):
        rows = frame.where(F.col(name).isNotNull())
        distinct, n = rows.select(F.count_distinct(name), F.count(name)).head()
        below, upto = rows.select(F.count_if(F.col(name) < merged[name]["median"]), F.count_if(F.col(name) <= merged[name]["median"])).head()
        assert merged[name]["distinct"] == pytest.approx(distinct, rel=0.05)
        assert below / n - 0.02 <= 0.5 <= upto / n + 0.02
        assert merged[name]["skew"] == pytest.approx(whole[name]["skew"], rel=1e-6, abs=1e-9)
    assert (merged["none"]["distinct"], merged["none"]["median"], merged["none"]["skew"]) == (0, None, None)
    assert (merged["zero"]["distinct"], merged["zero"]["median"], merged["zero"]["skew"]) == (1, 0.0, None)


def test_profile_of_empty_batches(spark):
    empty = spark.createDataFrame([], "x double")
    got = jobs.merge_facts(jobs.batch_facts(empty).unionByName(jobs.batch_facts(empty))).collect()
    assert [(r["rows"], r["distinct"], r["median"], r["skew"]) for r in got] == [(0, 0, None, None)]


def test_facts_replace_their_section(spark, tmp_path):
    schema = "dataset string, section string, column_name string, metric string, value_double double, value_string string"
    root = str(tmp_path / "facts")
    first = [("a", "shape", "", "rows", 1.0, None), ("a", "missing", "x", "count", 1.0, None), ("b", "shape", "", "rows", 5.0, None)]
    catalog.put_facts(spark.createDataFrame(first, schema), root)
    catalog.put_facts(spark.createDataFrame([("a", "shape", "", "rows", 2.0, None)], schema), root)
    got = {(r["dataset"], r["section"]): r["value_double"] for r in spark.read.parquet(root).collect()}
    assert got == {("a", "shape"): 2.0, ("a", "missing"): 1.0, ("b", "shape"): 5.0}
    # A whole profile replaces sections that have become empty too.
    catalog.put_facts(spark.createDataFrame([("a", "shape", "", "rows", 3.0, None)], schema), root, ["a"])
    got = {(r["dataset"], r["section"]): r["value_double"] for r in catalog.stored_facts(spark, root).collect()}
    assert got == {("a", "shape"): 3.0, ("b", "shape"): 5.0}


def test_cascade(spark):
    gone = spark.createDataFrame([("a",)], "dataset_id string")
    log = spark.createDataFrame([("a", 1), ("b", 2)], "dataset_id string, id int")
    assert [r["id"] for r in catalog.remove(log, gone).collect()] == [2]
