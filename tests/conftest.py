import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ordermetrics.session import RECOMMENDED  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    builder = SparkSession.builder.master("local[4]").appName("tests")
    settings = {
        **RECOMMENDED, "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": str(folder / "warehouse"),
        "spark.checkpoint.dir": str(folder / "shared"),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def frame(spark):
    """Small frame from rows and a DDL schema; ``timestamp_ntz`` columns take text."""

    def build(rows, schema):
        text = schema.replace("timestamp_ntz", "string")
        df = spark.createDataFrame(rows, text)
        times = [part.split()[0] for part in schema.split(",") if part.strip().endswith("timestamp_ntz")]
        for name in times:
            df = df.withColumn(name, df[name].cast("timestamp_ntz"))
        return df

    return build


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


@pytest.fixture()
def rows():
    return rows_of
