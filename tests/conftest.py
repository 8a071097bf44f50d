import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
    builder = builder.config("spark.sql.session.timeZone", "UTC").config("spark.executorEnv.PYTHONPATH", str(ROOT)).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
    s = builder.config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint"))).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    d = Path("/root/testdata/sf0.001")
    if not d.exists():
        pytest.skip("no test data")
    return str(d)
