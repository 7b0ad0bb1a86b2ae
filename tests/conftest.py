from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from docketry.session import session

    base = tmp_path_factory.mktemp("spark")
    spark = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(base / "warehouse"), "spark.default.parallelism": "4"})
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
