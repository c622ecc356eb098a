import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for p in (ROOT, os.path.join(ROOT, "tests")):
    if p not in sys.path:
        sys.path.insert(0, p)


@pytest.fixture(scope="session")
def spark():
    from stepweave.session import spark_session

    s = spark_session("tests", **{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make_events(spark):
    """Events from short dicts; missing fields take the usual values."""
    from stepweave.schema import EVENT

    defaults = {"trace_id": "t", "ph": "X", "cat": "cpu_op", "name": "op", "pid": "0", "tid": "1", "ts_ns": 0}

    def make(rows):
        full = [{**defaults, "idx": i, **r} for i, r in enumerate(rows)]
        return spark.createDataFrame([tuple(r.get(f.name) for f in EVENT.fields) for r in full], EVENT)

    return make
