import pytest

from samples import MESSY, documents


@pytest.fixture(scope="session")
def messy(spark):
    return documents(spark, MESSY)


@pytest.fixture(scope="session")
def nothing(spark):
    return documents(spark, [])
