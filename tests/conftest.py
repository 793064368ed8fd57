from __future__ import annotations

import pytest

from lodestar import runtime


@pytest.fixture(scope="session")
def spark():
    s = runtime.session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
