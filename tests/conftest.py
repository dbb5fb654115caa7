"""One local session for all tests."""

import pytest
from pyspark.sql import SparkSession

from obsidia.session import CONF


@pytest.fixture(scope="session")
def spark():
    conf = CONF | {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
