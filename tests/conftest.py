import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from hand_model import build_model  # noqa: E402
from tillscope.session import prepare  # noqa: E402
from tillscope.sources.generate import gen_model  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tillscope-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield prepare(session)
    session.stop()


@pytest.fixture(scope="session")
def standard(spark):
    """The generated data set at its standard size, kept in memory."""
    model = gen_model(spark)
    return model.with_tables(
        **{
            name: model.table(name).cache()
            for name in ("customers", "orders", "order_items", "products")
        }
    )


@pytest.fixture(scope="session")
def hand(spark):
    return build_model(spark)
