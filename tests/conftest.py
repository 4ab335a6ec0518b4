import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {
        "spark.sql.shuffle.partitions": "4",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tmp_path_factory.mktemp("shared").as_uri(),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    spark = SparkSession.builder.master("local[4]").appName("tests").config(map=conf).getOrCreate()
    spark.sparkContext.setCheckpointDir(conf["spark.checkpoint.dir"])
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
