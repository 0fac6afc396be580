from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from catalogspark.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = os.environ.get("SPARK_CHECKPOINT_DIR") or str(tmp_path_factory.mktemp("shared"))
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.checkpoint.dir", shared)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def values(spark):
    """Values of a column expression over literal inputs, in input order."""
    from pyspark.sql import functions as F

    def evaluate(build, inputs, type_name="string"):
        rows = [(i, v) for i, v in enumerate(inputs)]
        df = spark.createDataFrame(rows, f"i int, v {type_name}")
        return [r.out for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]

    return evaluate
