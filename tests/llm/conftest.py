import pytest

from llm.corpora import corpus, frame


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from ledgerlens.plans.runtime import ship_package

    ship_package(spark)


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    return frame(spark, rows, tmp_path_factory.mktemp("docs"))


@pytest.fixture(scope="session")
def wide(spark, rows, tmp_path_factory):
    """The same rows with further columns named like the operators' own."""
    return frame(spark, rows, tmp_path_factory.mktemp("wide"), extra=True)


@pytest.fixture(scope="session")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    frame(spark, corpus(20)[:1], tmp_path_factory.mktemp("one")).where("false").write.parquet(path)
    return spark.read.parquet(path)
