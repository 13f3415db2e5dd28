import pytest

from nasty import documents


@pytest.fixture(scope="session")
def docs(spark):
    return documents(spark).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return documents(spark, [])
