import pytest
from cases import SCHEMA, edge_rows, repeated_rows


@pytest.fixture(scope="session")
def make(spark):
    def of(rows):
        return spark.createDataFrame(rows, SCHEMA).repartition(3) if rows else spark.createDataFrame([], SCHEMA)
    return of


@pytest.fixture(scope="session")
def edge(make):
    return make(edge_rows())


@pytest.fixture(scope="session")
def repeated(make):
    return make(repeated_rows())


@pytest.fixture(scope="session")
def empty(make):
    return make([])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
