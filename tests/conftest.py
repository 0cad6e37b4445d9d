import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("TZ", "UTC")

from weftline.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session(
        "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.checkpoint.dir": f"file://{tempfile.mkdtemp(prefix='weftline-tests-')}", "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="weftline-warehouse-")}
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
