import os

import pytest
from pyspark.sql import functions as F

from leadspark import schemas as S
from leadspark.sources import sinks as K
from leadspark.sources import tables as T


def test_append_conforms_and_rejects(spark, tmp_dir):
    path = os.path.join(tmp_dir, "usage")
    a = spark.createDataFrame([("X", 1, "f")], "client string, n bigint, f string")
    K.append(a, path)
    b = spark.createDataFrame([("2", "g", "X")], "n string, f string, client string")
    K.append(b, path)
    got = spark.read.parquet(path)
    assert dict(got.dtypes)["n"] == "bigint" and got.count() == 2
    with pytest.raises(K.SchemaMismatch):
        K.append(spark.createDataFrame([("X", 1)], "client string, n bigint"), path)
    assert spark.read.parquet(path).count() == 2  # nothing written on reject


def test_partitioned_overwrite_touches_only_given_tenants(spark, tmp_dir):
    path = os.path.join(tmp_dir, "h")
    K.write_partitioned(spark.createDataFrame([("A", 1), ("B", 2)], "client string, v bigint"), path)
    K.write_partitioned(spark.createDataFrame([("A", 9)], "client string, v bigint"), path)
    got = sorted(tuple(r) for r in spark.read.parquet(path).select("client", "v").collect())
    assert got == [("A", 9), ("B", 2)]
    assert T.read_table(spark, path, "v bigint, client string", client="B").count() == 1


def test_empty_history_and_prompts(spark, tmp_dir):
    h = T.load_or_create_history(spark, os.path.join(tmp_dir, "none"))
    assert h.count() == 0 and h.schema == S.HISTORY
    for client, name, body in [("A", "standard_query", "{a} x"), ("B", "email_template", "hi {b}")]:
        d = os.path.join(tmp_dir, "prompts", f"client={client}")
        os.makedirs(d, exist_ok=True)
        with open(os.path.join(d, name + ".txt"), "w") as f:
            f.write(body)
    p = T.load_prompts(spark, os.path.join(tmp_dir, "prompts", "*", "*.txt"))
    assert sorted(tuple(r) for r in p.collect()) == [("A", "standard_query", "{a} x"),
                                                     ("B", "email_template", "hi {b}")]
    names = spark.createDataFrame([("A", "standard_query"), ("B", "standard_query")], "client string, name string")
    d = spark.createDataFrame([("standard_query", "default")], "name string, body string")
    got = {r.client: (r.body, r.is_default) for r in T.prompt_for(names, p, d).collect()}
    assert got == {"A": ("{a} x", False), "B": ("default", True)}


def test_contacts_load_checks_columns(spark, tmp_dir):
    path = os.path.join(tmp_dir, "c")
    spark.createDataFrame([(" Ann ", "Lee", "Co", "Dev"), ("Ann", "Lee", "Co", "Dev"), ("Bo", None, "Co", None)],
                          "first_name string, last_name string, company string, position string") \
        .write.parquet(path)
    c = T.load_contacts(spark, path, client="T")
    assert [(r.first_name, r.last_name) for r in c.collect()] == [("Ann", "Lee")]
    spark.createDataFrame([("a", "b")], "first_name string, company string").write.parquet(path + "2")
    with pytest.raises(T.MissingColumns):
        T.load_contacts(spark, path + "2")
    df = spark.createDataFrame([("a", "b", "c")], "last_name string, first_name string, company string")
    assert T.require_columns(df, ["first_name", "last_name", "company"], ordered=True) == ["first_name", "last_name"]


def test_price_load_flags_bad_dates(spark, tmp_dir):
    path = os.path.join(tmp_dir, "p.csv")
    with open(path, "w") as f:
        f.write("ord,model,start_date,end_date,input_price,output_price,search_price\n"
                "1,m,2024-01-01,,1.0,2.0,0.1\n2,m,not a date,2024-02-01,1.0,2.0,0.1\n")
    prices, issues = T.load_prices(spark, path)
    assert [r.start_date is None for r in prices.orderBy("ord").collect()] == [False, True]
    assert [r.check for r in issues.collect()] == ["start_date_unparsed"]


def test_csv_export_sorted_per_tenant(spark, tmp_dir):
    path = os.path.join(tmp_dir, "csv")
    df = spark.createDataFrame([("A", 2), ("A", 1), ("B", 3)], "client string, v bigint")
    K.write_csv(df, path, sort_by=[F.col("v").desc()])
    back = spark.read.option("header", True).csv(path)
    assert sorted(tuple(r) for r in back.select("client", "v").collect()) == [("A", "1"), ("A", "2"), ("B", "3")]


def test_csv_of_a_large_tenant_keeps_its_order_over_files(spark, tmp_dir):
    path = os.path.join(tmp_dir, "csv2")
    df = spark.range(0, 5000, numPartitions=7).select(F.lit("A").alias("client"), (F.col("id") * 7919 % 5000).alias("v"))
    K.write_csv(df, path, sort_by=["v"], partitions=4)
    folder = os.path.join(path, "client=A")
    files = sorted(f for f in os.listdir(folder) if f.endswith(".csv"))
    values = []
    for f in files:
        with open(os.path.join(folder, f)) as lines:
            values += [int(x) for x in lines.read().split()[1:]]
    assert len(files) > 1 and values == list(range(5000))


def test_prices_in_file_order(spark, tmp_dir):
    path = os.path.join(tmp_dir, "p.csv")
    with open(path, "w") as f:
        f.write("model,start_date,end_date,input_price,output_price,search_price\n"
                "z,2024-01-03,,1.0,2.0,0.1\na,2024-01-01,,NaN,2.0,0.1\nm, ,,1.0,2.0,0.1\n")
    prices, issues = T.load_prices(spark, path)
    assert [r.model for r in prices.orderBy("ord").collect()] == ["z", "a", "m"]
    assert prices.filter("model = 'a'").first().input_price is None
    assert [r.check for r in issues.collect()] == ["start_date_blank"]


def test_first_row_of_a_person_wins_over_files(spark, tmp_dir):
    from leadspark.operators import contacts as CT
    path = os.path.join(tmp_dir, "two")
    for k, position in enumerate(("Dev", "Boss")):
        spark.createDataFrame([("Ann", "Lee", "Co", position)],
                              "first_name string, last_name string, company string, position string").coalesce(1) \
            .write.parquet(os.path.join(path, f"part={k}"))
    c = CT.one_per_person(T.load_contacts(spark, os.path.join(path, "*"), client="T"))
    assert [r.position for r in c.collect()] == ["Dev"]


def test_empty_subscriptions_are_reported(spark, tmp_dir):
    path = os.path.join(tmp_dir, "subs")
    spark.createDataFrame([], S.SUBSCRIPTIONS).write.parquet(path)
    subs = T.load_subscriptions(spark, path)
    assert [r.check for r in T.empty_source(subs, "subscriptions").collect()] == ["empty_source"]
    assert T.empty_source(spark.range(1), "x").count() == 0


def test_append_leaves_out_what_is_stored(spark, tmp_dir):
    path = os.path.join(tmp_dir, "keyed")
    for rows in ([("A", 1)], [("A", 1), ("A", 2)]):
        K.append(spark.createDataFrame(rows, "client string, id long"), path, key=["id"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2]


def test_a_cluster_session_must_name_its_checkpoint_folder(monkeypatch):
    from leadspark import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def setCheckpointDir(self, path):
            raise AssertionError("a scratch folder was chosen")

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())
    Session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())
