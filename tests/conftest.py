import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidekeep.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false")
               .config("spark.checkpoint.dir", str(folder)).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


@pytest.fixture
def values(spark):
    """Evaluates one column over literal rows."""
    def evaluate(rows, schema, column):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        indexed = [(i, *r) for i, r in enumerate(rows)]
        df = spark.createDataFrame(indexed, f"_i int, {schema}").select("_i", column.alias("_v"))
        return [r["_v"] for r in sorted(df.collect(), key=lambda r: r["_i"])]
    return evaluate
