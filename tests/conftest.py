import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    os.environ["PYTHONPATH"] = str(Path(__file__).resolve().parents[1]) + ":" + os.environ.get("PYTHONPATH", "")
    return SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", f"{at}/ck").config("spark.sql.warehouse.dir", f"{at}/wh").config("spark.driver.memory", "4g").getOrCreate()
