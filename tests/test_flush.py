import os

import pytest
from pyspark.sql import functions as F

from leadspark.operators import identity as ID
from leadspark.sources import sinks as K


def rows(spark, data, schema="client string, n bigint"):
    return spark.createDataFrame(data, schema)


def got(spark, root, table):
    df = K.stored(spark, root, table)
    return [] if df is None else sorted(map(tuple, df.select("client", "n").collect()))


def test_both_tables_are_visible_or_neither(spark, tmp_dir):
    root = os.path.join(tmp_dir, "store")
    a, b = rows(spark, [("A", 1), (None, 2)]), rows(spark, [("A", 10)])
    bad = b.withColumn("n", F.raise_error(F.lit("lost")).cast("bigint"))
    parts = {"one": ("client",), "two": ("client",)}
    with pytest.raises(Exception):
        K.flush(spark, root, "day1", {"one": a, "two": bad}, parts)
    assert os.path.exists(os.path.join(root, "one"))  # written, yet in no manifest
    assert got(spark, root, "one") == got(spark, root, "two") == [] and not K.is_flushed(spark, root, "day1")
    # the repeated run holds fewer tenants: nothing of the first attempt comes back
    assert K.flush(spark, root, "day1", {"one": rows(spark, [("A", 1)]), "two": b}, parts)
    assert got(spark, root, "one") == [("A", 1)] and got(spark, root, "two") == [("A", 10)]
    assert not K.flush(spark, root, "day1", {"one": a, "two": b}, parts)
    assert got(spark, root, "one") == [("A", 1)]
    assert K.flush(spark, root, "day2", {"one": rows(spark, [("A", 1), ("B", 3)])}, parts)
    assert got(spark, root, "one") == [("A", 1), ("A", 1), ("B", 3)]  # known by runs, not by the rows' keys
    with pytest.raises(K.SchemaMismatch):
        K.flush(spark, root, "day3", {"one": rows(spark, [("A",)], "client string")}, parts)


def test_only_finished_runs_are_read(spark, tmp_dir):
    root = os.path.join(tmp_dir, "store")
    for day in ("day1", "day2"):
        K.flush(spark, root, day, {"one": rows(spark, [("A", 1)])}, {"one": ("client",)})
    failed = os.path.join(root, "one", "client=A", "run=day3.lost")
    os.mkdir(failed)
    with open(os.path.join(failed, "part-0.parquet"), "w") as f:
        f.write("not a table")  # reading it would fail
    schema = rows(spark, []).schema
    stored = K.stored(spark, root, "one", schema)
    assert stored.count() == 2
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "day1." in plan.split("PartitionFilters:")[1].split("PushedFilters:")[0]


def test_a_flush_reads_nothing_stored(spark, tmp_dir):
    """An update rewrites partitions of its own run only; a flush adds files and touches none."""
    root = os.path.join(tmp_dir, "store")

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
                for d, _, names in os.walk(os.path.join(root, "one")) for f in names if f.endswith(".parquet")}

    K.flush(spark, root, "day1", {"one": rows(spark, [("A", 1), ("B", 2)])}, {"one": ("client",)})
    before = files()
    K.flush(spark, root, "day2", {"one": rows(spark, [("A", 3)])}, {"one": ("client",)})
    after = files()
    assert before.items() <= after.items() and len(after) == len(before) + 1


def test_dictionary_gives_each_key_one_number(spark, tmp_dir):
    root = os.path.join(tmp_dir, "store")
    key = ["client", "name"]
    schema = "client string, name string"
    first = rows(spark, [("A", "x"), ("A", "x"), ("A", None), (None, None), ("B", "x")], schema)
    ids = ID.extend(first, root, "people", key, floor=lambda: 100)
    one = {(r.client, r.name): r.id for r in ids.collect()}
    assert sorted(one.values()) == [101, 102, 103, 104] and set(one) == {("A", "x"), ("A", None), (None, None), ("B", "x")}
    again = ID.extend(first, root, "people", key, floor=lambda: 1 / 0)  # a floor is asked once
    assert {(r.client, r.name): r.id for r in again.collect()} == one
    more = ID.extend(rows(spark, [("A", "x"), ("C", "z"), (None, "x")], schema), root, "people", key)
    two = {(r.client, r.name): r.id for r in more.collect()}
    assert one.items() <= two.items() and sorted(two.values()) == list(range(101, 107))
    part = ID.extend(rows(spark, [("C", "z"), ("C", "y")], schema), root, "people", key, where=F.col("client") == "C")
    three = {(r.client, r.name): r.id for r in part.collect()}
    assert three == {("C", "z"): two["C", "z"], ("C", "y"): 107}
    seen = ID.attach(first.withColumn("n", F.lit(1)), more, key)
    assert seen.columns == ["client", "name", "n", "id"]
    assert sorted(r.id for r in seen.collect()) == sorted([one["A", "x"], *one.values()])


def test_an_empty_dictionary(spark, tmp_dir):
    root = os.path.join(tmp_dir, "store")
    none = rows(spark, [], "client string")
    assert ID.extend(none, root, "people", ["client"]).count() == 0
    assert [r.id for r in ID.extend(rows(spark, [("A",)], "client string"), root, "people", ["client"]).collect()] == [1]


def test_tables_without_rows(spark, tmp_dir):
    root = os.path.join(tmp_dir, "store")
    none = rows(spark, [])
    assert K.stored(spark, root, "one", none.schema).columns == ["client", "n", "run"]
    assert K.flush(spark, root, "day1", {"one": none, "two": rows(spark, [("A", 1)])}, {"one": ("client",)})
    assert got(spark, root, "one") == [] and got(spark, root, "two") == [("A", 1)]
    assert K.flush(spark, root, "day2", {"one": rows(spark, [("A", 1)])}, {"one": ("client",)})
    assert got(spark, root, "one") == [("A", 1)]
