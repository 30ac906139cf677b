from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).parent.parent
sys.path.insert(0, str(ROOT))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    from netloom.session import session, ship_code

    s = session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    ship_code(s)
    return s


@pytest.fixture(scope="session")
def sf() -> str:
    return f"{DATA}/sf0.001"
