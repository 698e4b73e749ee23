import pytest

from siftwell.session import session


@pytest.fixture(scope="session")
def spark():
    return session("tests", cpus=4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
