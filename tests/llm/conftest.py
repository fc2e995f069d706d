import pytest

#: Extra columns with names that operators use inside.
EXTRA = "row long, digest string, spans string, label int, node long, score double, run int, k int"


@pytest.fixture(scope="session")
def table(spark):
    def make(rows, columns="doc_id long, text string"):
        n = len(columns.split(","))
        return spark.createDataFrame([(*r[:n], 1, "d", "s", 2, 3, 0.5, 4, 5) for r in rows], f"{columns}, {EXTRA}").repartition(3)

    return make


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
