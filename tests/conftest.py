import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lynceus.session import SETTINGS

    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config(map=SETTINGS | {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    connection = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def canonical(frame):
    """Rows as sorted tuples of strings, columns by name."""
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("NULL" if v is None or v != v else str(v) for v in row) for row in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def same():
    def check(left, right):
        assert sorted(left.columns) == sorted(right.columns)
        assert canonical(left) == canonical(right)

    return check
