import pytest

from gridloom.session import get_session


@pytest.fixture(scope="session")
def spark():
    return get_session("tests", **{"spark.sql.shuffle.partitions": "4", "spark.sql.execution.arrow.pyspark.enabled": "true"})
