import os

os.environ.setdefault("TZ", "UTC")
import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(params=["small", "distributed"])
def plan(request, spark):
    """Both plans of a graph operator: the one for graphs of a checked small size and the one for all others."""
    from edgeloom.operators.small import CONF, LOCAL_EDGES

    spark.conf.set(CONF, str(LOCAL_EDGES if request.param == "small" else 0))
    yield request.param
    spark.conf.unset(CONF)
