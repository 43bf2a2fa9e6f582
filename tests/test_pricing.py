import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from leadspark import fixtures as fx
from leadspark.operators import pricing as P

D = dt.datetime


def _usage(spark, rows):
    return spark.createDataFrame(
        [("T", i, d, "search", m, c, a, b) for i, (m, d, a, b, c) in enumerate(rows)],
        "client string, usage_id bigint, search_date timestamp_ntz, function string, model string, "
        "search_calls bigint, input_tokens bigint, output_tokens bigint")


def test_price_asof_golden_rows(spark):
    rows = [("click", D(2024, 1, 10), 0, 0, 0), ("click", D(2024, 1, 10, 12), 0, 0, 0),
            ("click", D(2024, 1, 22), 0, 0, 0), ("view", D(2024, 1, 20), 0, 0, 0),
            ("purchase", D(2024, 1, 16), 0, 0, 0), ("purchase", D(2024, 1, 25), 0, 0, 0),
            ("purchase", D(2024, 1, 2), 0, 0, 0)]
    out = P.price_asof(_usage(spark, rows), fx.pricing(spark)).orderBy("usage_id").collect()
    assert [r.price_ord for r in out] == [1, 1, 2, 5, 7, 6, None]
    assert [r.price_valid for r in out][:2] == [True, False]


def test_cost_formula_and_missing_price(spark):
    prices = spark.createDataFrame(
        [(1, "m", D(2024, 1, 1), None, 2.0, 5.0, 0.01), (2, "n", D(2024, 1, 1), None, 2.0, None, 0.0)],
        fx.S.PRICING)
    u = _usage(spark, [("m", D(2024, 1, 2), 500000, 100000, 2), ("n", D(2024, 1, 2), 1000000, 5, 3),
                       ("x", D(2024, 1, 2), 1, 1, 1)])
    d = {r.usage_id: r for r in P.cost_detail(u, prices).collect()}
    assert float(d[0].money) == 1.52
    assert float(d[1].money) == 2.0 and d[1].price_missing
    assert float(d[2].money) == 0.0 and d[2].price_ord is None


def test_price_sequence_issues(spark):
    got = {(r.model, r.ord, r.issue) for r in P.price_sequence_issues(fx.pricing(spark)).collect()}
    assert got == {("click", 1, "gap"), ("click", 2, "gap"), ("view", 4, "open_ended")}


def test_price_lookup_is_broadcast_without_usage_shuffle(spark):
    u = _usage(spark, [("click", D(2024, 1, 5), 1, 1, 1)])
    plan = P.price_asof(u, fx.pricing(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_cost_is_additive_over_date_splits(spark):
    u = fx.consumption(spark, "/root/testdata/sf0.001")
    prices = fx.pricing(spark)
    total = P.cost_detail(u, prices).agg(F.sum("money")).first()[0]
    a = P.cost_detail(u, prices, date_to="2024-01-15 23:59:59.999999").agg(F.sum("money")).first()[0] or 0
    b = P.cost_detail(u, prices, date_from="2024-01-16").agg(F.sum("money")).first()[0] or 0
    assert total == a + b


def test_small_prices_and_large_measures_are_exact(spark):
    prices = spark.createDataFrame([(1, "m", D(2024, 1, 1), None, 0.0000004, 0.0, 0.000000001)], fx.S.PRICING)
    u = _usage(spark, [("m", D(2024, 1, 2), 5_000_000_000_000, 7, 3)])
    money = P.cost_detail(u, prices).first().money
    assert money == Decimal("2.000000003")


def test_timeline_equals_the_scan(spark):
    """Overlaps, touching and turned periods, open ends, shared starts, missing dates and models."""
    import random
    rng = random.Random(11)

    def day(k):
        return D(2024, 1, 1) + dt.timedelta(hours=12 * k)

    rows = []
    for i in range(700):
        start = rng.randrange(80)
        end = None if rng.random() < 0.03 and i < 300 else day(start + rng.choice([-1, 0, 1, 2, 3, 9]))
        rows.append((i, rng.choice("aaaab") if i % 50 else None, None if i % 41 == 0 else day(start), end, float(i), None, 0.5))
    rng.shuffle(rows)
    prices = spark.createDataFrame(rows, fx.S.PRICING)
    moments = [day(k) + dt.timedelta(microseconds=m) for k in range(-2, 95) for m in (-1, 0, 1)]
    usage = [(m, at, 1, 1, 1) for at in moments for m in "ab"] + [("a", None, 1, 1, 1), ("z", day(3), 1, 1, 1), (None, day(3), 1, 1, 1)]
    u = _usage(spark, usage)
    cols = ["usage_id", "price_ord", "price_valid", *P.PRICE_FIELDS]

    def found(**kw):
        out = P.price_asof(u, prices, **kw)
        assert out.columns == [*u.columns, "price_ord", "price_valid", *P.PRICE_FIELDS]
        return sorted(map(str, out.select(*cols).collect()))

    want = found(scan_rows=1000)
    assert len(want) == len(usage) and found() == want
    assert found(max_broadcast_rows=10) == want  # no broadcast
    old = P.PAGE
    try:
        P.PAGE = 8
        assert found() == want
    finally:
        P.PAGE = old


def test_a_long_list_is_looked_up_without_usage_shuffle(spark):
    prices = spark.range(1000).select(
        F.col("id").alias("ord"), F.lit("click").alias("model"),
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, CAST(id AS INT))").alias("start_date"),
        F.lit(None).cast("timestamp_ntz").alias("end_date"),
        *[F.lit(1.0).alias(f) for f in P.PRICE_FIELDS])
    u = fx.consumption(spark, "/root/testdata/sf0.001")
    plan = P.price_asof(u, prices)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 4 and "SortMergeJoin" not in plan
    assert P.price_asof(u, prices).filter("model = 'click' AND search_date >= '2024-01-01' AND price_ord IS NULL").isEmpty()


def test_timeline_holds_no_model_in_one_task(spark, monkeypatch):
    """One model alone: every table on the way is spread over tasks, and small chunks and groups give the scan's periods."""
    from pyspark.sql.classic.dataframe import DataFrame
    prices = spark.range(3000).select(
        F.col("id").alias("ord"), F.lit("click").alias("model"),
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, CAST(id * 7919 % 3000 AS INT))").alias("start_date"),
        F.expr("CASE WHEN id % 60 > 0 OR id < 2000 THEN timestamp_ntz'2024-01-01' + make_dt_interval(0, CAST(id * 7919 % 3000 + id % 90 AS INT)) END")
        .alias("end_date"), *[F.lit(1.0).alias(f) for f in P.PRICE_FIELDS])
    shares, checkpoint = [], DataFrame.checkpoint

    def watched(self, *args, **kw):
        out = checkpoint(self, *args, **kw)
        counts = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        if sum(counts) > 1000:
            shares.append(max(counts) / sum(counts))
        return out

    monkeypatch.setattr(P, "CHUNK", 128)
    monkeypatch.setattr(P, "SMALL_LEVELS", 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        monkeypatch.setattr(DataFrame, "checkpoint", watched)
        line = P.timeline(prices)
        monkeypatch.setattr(DataFrame, "checkpoint", checkpoint)
        assert len(shares) >= 4 and max(shares) < 0.5
        assert line.count() == prices.select(F.explode(F.array_compact(F.array(
            "start_date", F.expr("end_date + INTERVAL '0.000001' SECOND")))).alias("at")).distinct().count()
        u = _usage(spark, [("click", D(2024, 1, 1) + dt.timedelta(minutes=15 * k), 1, 1, 1) for k in range(0, 12400, 9)])
        want = P.price_asof(u, prices, scan_rows=5000).select("usage_id", "price_ord", "price_valid").collect()
        got = P.price_asof(u, prices).select("usage_id", "price_ord", "price_valid").collect()
        assert sorted(map(str, got)) == sorted(map(str, want))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
