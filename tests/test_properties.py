"""Property tests: the skew-safe ordering helpers equal plain windows on
random, heavily skewed groups (one group holds most rows)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from leadspark.operators import grouping as G

rows = st.lists(st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b"]),
                          st.integers(0, 20)), min_size=1, max_size=60)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=rows, k=st.integers(1, 7))
def test_top_k_equals_window(spark, data, k):
    df = spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate(data)], "g string, v bigint, id bigint")
    order = [F.col("v").desc(), F.col("id")]
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    top = G.top_k_per_group(df.repartition(4), ["g"], order, k, 7, rank_col="rn", salts=3)
    assert sorted(top.select("g", "id", "rn").collect()) == sorted(
        ref.filter(F.col("rn") <= k).select("g", "id", "rn").collect())


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=rows)
def test_numbering_and_previous_equal_windows(spark, data):
    df = spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate(data)], "g string, v bigint, id bigint")
    w = Window.partitionBy("g").orderBy("v", "id")
    num = G.row_number_per_group(df, ["g"], ["v", "id"], name="rn", partitions=3)
    assert sorted(num.select("id", "rn").collect()) == sorted(
        df.select("id", F.row_number().over(w).alias("rn")).collect())
    prev = G.previous_in_group(df, ["g"], ["v", "id"], "id", "prev")
    assert sorted(prev.select("id", "prev").collect()) == sorted(
        df.select("id", F.lag("id").over(w).alias("prev")).collect())
