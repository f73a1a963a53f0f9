import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scriptflow import session  # noqa: E402
from scriptflow.sources import storage  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session.build(
        "scriptflow-tests",
        "local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.sql.maxMetadataStringLength": "10000",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    storage.remove_scratch(spark)
    spark.stop()
