import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(df.columns) >= {"client", "day", "model", "cost"}
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_queries_run_small(spark):
    qs = E.queries()
    for name in ["p2_clean_contacts", "f4_search_period", "t4_corpus_search", "t7_novelty", "w4_weekly_shortlist"]:
        assert qs[name](spark, SF).count() > 0, name


def test_registry_loads_without_a_session():
    import subprocess
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as E; print(len(E.oracle_sql()), len(E.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr


def test_other_queries_stand_without_the_llm_libraries():
    import subprocess
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import sys; sys.modules['xxhash'] = None; sys.modules['public_tokenizers'] = None; "
            "import __spark_entry__ as E; print(len(E.queries()), sum(k.startswith('op') for k in E.queries()))")
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and out.stdout.split()[1] == "0" and int(out.stdout.split()[0]) >= 59, out.stderr
