import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (SparkSession.builder.master("local[8]").appName("worklake-tests")
               .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "8g")
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_pieces(spark):
    """Ordered scans are cut into pieces of a handful of rows."""
    from worklake.session import PIECE_ROWS

    spark.conf.set(PIECE_ROWS, "8")
    yield
    spark.conf.unset(PIECE_ROWS)
