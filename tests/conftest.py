import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from prefengine.session import make_importable, session

    s = session("tests", 4, 4)
    make_importable(s)
    yield s
    s.stop()


@pytest.fixture
def rows(spark):
    """Makes a table of tuples with a DDL schema."""
    return lambda data, schema: spark.createDataFrame(data, schema)
